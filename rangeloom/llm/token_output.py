"""Token ids as Parquet list columns.

One row per document, in ascending id order: the ids as a list of 32-bit
integers, with metadata beside them, so that a reader may take either alone.
Row groups and pages are small and carry page indexes, which lets a filter on
doc_id skip pages; ids are dictionary-encoded, and delta-encoded (Parquet
version 2 pages) once a dictionary outgrows its page.

Texts are range-partitioned by id before they are encoded, as they are smaller
than their ids. A partition becomes one file; it counts its own tokens, and the
offsets of whole files are running sums over one row per file.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rangeloom.llm.workers import held
from rangeloom.operators.staging import shuffle_partitions, stage

ROW_GROUP_BYTES = 16 << 20
PAGE_BYTES = 64 << 10
DICTIONARY_BYTES = 1 << 20
_CACHE_ENTRIES = 400_000
#: Words of Latin letters, then marks: each of the two parts is one piece of the tokenizer's own split.
_SIMPLE = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,!?;:%#&*|$]*)")
#: Python splits words at these, the tokenizer's pattern does not.
_UNLIKE = re.compile("[\x1c-\x1f]")


def _byte_letters() -> list[str]:
    """The letter that byte-level BPE writes for each byte: itself if printable, else the next from 256 on."""
    shown = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class Encoder:
    """Whole texts to ids with a tokenizer file, each different word encoded once a process.

    With ``by_words`` (for tokenizers that drop white space, lower-case, and
    split before the model) a text is encoded word by word: a word of Latin
    letters and marks goes to the library's BPE model piece by piece, any other to its full
    ``encode``. The ids are those of encoding the whole text. The memo of words
    holds a fixed number of entries; further words are encoded each time.
    """

    def __init__(self, path: str, by_words: bool):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.by_words = by_words
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.letters = str.maketrans({chr(b): x for b, x in enumerate(_byte_letters())})

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _piece(self, piece: str) -> bytes:
        found = self.pieces.get(piece)
        if found is None:
            shown = piece.encode().decode("latin-1").translate(self.letters)
            found = np.array([t.id for t in self.model.tokenize(shown)], "<u4").tobytes()
            if len(self.pieces) < _CACHE_ENTRIES:
                self.pieces[piece] = found
        return found

    def _word(self, word: str) -> bytes:
        simple = _SIMPLE.fullmatch(word)
        if simple:
            found = self._piece(simple[1].lower()) + (self._piece(simple[2]) if simple[2] else b"")
        else:
            found = self._whole(word)
        if len(self.words) < _CACHE_ENTRIES:
            self.words[word] = found
        return found

    def encode(self, text: str | None) -> bytes:
        """Ids of ``text`` (null: empty) as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if not self.by_words or _UNLIKE.search(text):
            return self._whole(text)
        known, word = self.words.get, self._word
        return b"".join([known(w) or word(w) for w in text.split()])


def _encoder(path: str, by_words: bool) -> Encoder:
    return held(("encoder", path, by_words), lambda: Encoder(path, by_words))


def encode_documents(
    docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", by_words: bool = True, partitions: int | None = None
) -> DataFrame:
    """(doc_id, part, row, part_start, n_tokens, tokens) in ascending doc_id within and across partitions.

    ``part_start`` counts the ids before a document in its own partition. Every
    document ends with ``end_id``; a null or empty text is that id alone. Null ids sort
    first, dealt out by the first characters of their texts, and rows that repeat an id follow each other, by text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = _encoder(tokenizer, by_words), np.array([end_id], "<u4").tobytes()
        part, row, start = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            lo = 0
            sizes = np.array([len(c.as_buffer()) if c.is_valid else 0 for c in batch.column(1)], np.int64)
            while lo < batch.num_rows:
                n = max(1, int(np.searchsorted(np.cumsum(sizes[lo:]), 1 << 22, side="right")))
                piece = batch.slice(lo, n)
                coded = [encoder.encode(t) + end for t in piece.column(1).to_pylist()]
                counts = np.fromiter(map(len, coded), np.int64, len(coded)) // 4
                ends = np.concatenate(([0], np.cumsum(counts)))
                tokens = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(coded), "<i4"), pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), pa.array([part] * n, pa.int32()), pa.array(row + np.arange(n), pa.int64()), pa.array(start + ends[:-1], pa.int64()), pa.array(counts, pa.int64()), tokens],
                    ["doc_id", "part", "row", "part_start", "n_tokens", "tokens"],
                )
                row, start, lo = row + n, start + int(ends[-1]), lo + n

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ranged = picked.repartitionByRange(partitions or shuffle_partitions(docs.sparkSession), "doc_id", F.when(F.col("doc_id").isNull(), F.substring("text", 1, 32))).sortWithinPartitions("doc_id", "text")
    return ranged.mapInArrow(run, "doc_id long, part int, row long, part_start long, n_tokens long, tokens array<int>")


def write_tokens(tokens: DataFrame, path: str, row_group_bytes: int = ROW_GROUP_BYTES, page_bytes: int = PAGE_BYTES) -> None:
    """Write encoded documents as Parquet with the layout of this module.

    Sizes are looked at after every row, so a row group ends with the document that fills it; one document's ids are never split. An
    empty table gives a folder without rows.
    """
    (
        tokens.write.option("compression", "zstd")
        .option("parquet.writer.version", "PARQUET_2_0")
        .option("parquet.block.size", row_group_bytes)
        .option("parquet.page.size", page_bytes)
        .option("parquet.page.size.row.check.min", 1)
        .option("parquet.dictionary.page.size", DICTIONARY_BYTES)
        .parquet(path)
    )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The files' rows with ``start``, the ids of all documents before each, in place of the place in their file."""
    rows = spark.read.schema("doc_id long, part int, row long, part_start long, n_tokens long, tokens array<int>").parquet(path)
    files = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select(F.col("part").alias("_part"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))
    # Staged, so that its size is known and the token lists are not shuffled to meet a row per file.
    placed = rows.join(stage(files, "token-files"), F.col("part") == F.col("_part"))
    return placed.select("doc_id", (F.col("_base") + F.col("part_start")).alias("start"), "n_tokens", "tokens")


def token_digest(tokens: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of rows that have a list of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            ids, ends = lists.values.to_numpy(zero_copy_only=False).astype("<u4"), lists.offsets.to_numpy()
            raw = memoryview(ids.tobytes())
            sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(ends), pa.int64()), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.select("doc_id", "start", "tokens").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
