"""Fill-in-the-middle transformation with cuts at token boundaries.

A text is decomposed into chunks of ``chunk_bytes`` which overlap by one
character, so whether a character ends a token is told by two adjacent
characters of one chunk. Boundaries and characters are counted for all chunks of
a batch at once; running totals over a text's chunks name the chunk that holds
the boundary of each cut rank, and only these chunks are scanned again for its place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK_BYTES = 1 << 16
MARKS = ("<P>", "<S>", "<M>")
_BATCH_BYTES = 1 << 23
_CUT = "n long, cut_1 long, cut_2 long, prefix_chars long, middle_chars long"


def _space(raw: np.ndarray) -> np.ndarray:
    return (raw == 32) | ((raw >= 9) & (raw <= 13))


def _token_ends(raw: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Whether each byte ends a token, by itself and the byte after it (a space for the last one): a word ends before white space, white space at the end of the text is left to the caller."""
    return ~_space(raw) & _space(after)


def _chunks(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end) of every chunk of the texts that lie in ``raw``."""
    n = -(-(ends - starts) // size)
    text = np.repeat(np.arange(len(starts)), n)
    within = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    at = starts[text] + within * size
    return text, at, np.minimum(at + size, ends[text])


def cut_places(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, ranks, size: int = CHUNK_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens of each text, byte offset and character offset of each of its cuts) for UTF-8 texts that lie at starts..ends of ``raw``.

    ``ranks`` maps the texts' numbers of tokens to cut ranks, one row for each cut; rank r is the place after r tokens, 0 before the first.
    """
    text, at, to = _chunks(raw, starts, ends, size)
    # The overlap: the byte after each one, white space after the end of a text, whose last word ends there.
    after = np.append(raw[1:], np.uint8(32))
    full = ends > starts
    last = ends[full] - 1
    after[last] = 32
    bounds, letters = _token_ends(raw, after), (raw & 0xC0) != 0x80
    bounds[last] = True
    counted = [np.add.reduceat(x, np.ravel(np.column_stack([at, to]))[:-1], dtype=np.int64)[::2] if len(at) else np.zeros(0, np.int64) for x in (bounds, letters)]
    upto = [np.concatenate(([0], np.cumsum(c))) for c in counted]
    first = np.searchsorted(text, np.arange(len(starts)))
    until = np.searchsorted(text, np.arange(len(starts)), side="right")
    n = upto[0][until] - upto[0][first]
    places, chars = [], []
    for rank in ranks(n):
        goal = upto[0][first] + rank
        own = np.searchsorted(upto[0], goal) - 1  # the first chunk by whose end so many tokens have ended
        place, char = starts.copy(), np.zeros(len(starts), np.int64)
        for i in np.flatnonzero(rank > 0):
            c = own[i]
            within = np.flatnonzero(bounds[at[c] : to[c]])[goal[i] - upto[0][c] - 1] + 1
            place[i] = at[c] + within
            char[i] = upto[1][c] - upto[1][first[i]] + np.count_nonzero(letters[at[c] : at[c] + within])
        places.append(place - starts)
        chars.append(char)
    return n, np.array(places), np.array(chars)


def _cuts(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lo = 0
            column = batch.column(batch.num_columns - 3)
            sizes = np.array([len(c.as_buffer()) if c.is_valid else 0 for c in column], np.int64)
            while lo < batch.num_rows:
                m = max(1, int(np.searchsorted(np.cumsum(sizes[lo:]), _BATCH_BYTES, side="right")))
                piece = batch.slice(lo, m)
                joined = b"".join(c.as_buffer().to_pybytes() if c.is_valid else b"" for c in piece.column(batch.num_columns - 3))
                ends = np.cumsum(sizes[lo : lo + m])
                h1, h2 = (piece.column(batch.num_columns - i).to_numpy() for i in (2, 1))
                n, places, chars = cut_places(np.frombuffer(joined, np.uint8), ends - sizes[lo : lo + m], ends, lambda n, h1=h1, h2=h2: np.sort([h1 % (n + 1), h2 % (n + 1)], axis=0), size)
                out = [n, *places, chars[0], chars[1] - chars[0]]
                yield pa.RecordBatch.from_arrays([*[piece.column(i) for i in range(batch.num_columns - 2)], *[pa.array(v, pa.int64()) for v in out]], [*batch.schema.names[:-2], *[c.split()[0] for c in _CUT.split(", ")]])
                lo += m

    return run


def _draw(key: Column, i: int) -> Column:
    """The i-th group of eight hexadecimal digits of a hash as a number."""
    return F.conv(F.substring(key, 8 * i + 1, 8), 16, 10).cast("long")


def fill_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, share: int = 50, spm_share: int = 80, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row per document: (doc_id, n, form, prefix_chars, middle_chars, output).

    A token is white space followed by a word, or white space at the end. Two draws of the id's hash cut the text's n tokens in three.
    Form is plain for ``100 - share`` of 100 documents, for empty texts (null: empty), and for texts that hold one of ``MARKS``; of the others
    ``spm_share`` of 100 have the suffix first (spm), the rest the prefix (psm). Characters are null for plain. Rows without an id draw as
    if it were empty; rows that repeat an id share its draws; an empty table gives an empty result; other columns are ignored.
    """
    name = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"), F.sha2(F.concat(F.lit(f"{seed}:"), name), 256).alias("key"))
    marked = F.lit(False)
    for mark in MARKS:
        marked = marked | F.contains("text", F.lit(mark))
    plain = (F.col("text") == "") | marked | (_draw(F.col("key"), 2) % 100 >= share)
    form = F.when(plain, "plain").when(_draw(F.col("key"), 3) % 100 < spm_share, "spm").otherwise("psm")
    drawn = rows.select("doc_id", form.alias("form"), "text", _draw(F.col("key"), 0).alias("h1"), _draw(F.col("key"), 1).alias("h2"))
    cut = drawn.mapInArrow(_cuts(chunk_bytes), f"doc_id long, form string, text string, {_CUT}")
    raw = F.encode("text", "UTF-8")
    part = lambda lo, hi: F.decode(F.substring(raw, lo + 1, hi - lo), "UTF-8")
    one, two = F.col("cut_1").cast("int"), F.col("cut_2").cast("int")
    prefix, middle, suffix = part(F.lit(0), one), part(one, two), part(two, F.length(raw))
    p, s, m = (F.lit(x) for x in MARKS)
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, middle)).otherwise(F.concat(s, suffix, p, prefix, m, middle))
    shown = lambda c: F.when(F.col("form") != "plain", F.col(c))
    return cut.select("doc_id", "n", "form", shown("prefix_chars").alias("prefix_chars"), shown("middle_chars").alias("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text that ``fill_middle`` has turned into ``output``; no mark occurs in it unless the form is plain."""
    parts = F.split(output, "|".join(MARKS))
    return F.when(form == "plain", output).when(form == "psm", F.concat(parts[1], parts[3], parts[2])).otherwise(F.concat(parts[2], parts[3], parts[1]))
