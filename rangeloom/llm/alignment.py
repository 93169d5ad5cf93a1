"""Alignment of two tokenizers over the same bytes by elementary intervals.

The ends of a text's tokens under tokenizer A (byte-level BPE) and under B
(pieces, with bytes for what has no piece) are byte offsets. The union of both
end arrays cuts the text into elementary intervals; binary searches name the A
and the B token that own each, so an interval is one overlap of two tokens.
Where both owners end, a group closes, and the two owners are linked. All A-B
pairs of a group are the product of its sizes, which is counted and only expanded on request.

A token of either side never reaches over a single space between two characters
that are not white space, so such a space ends a group, and a text is the
sequence of its stretches between them. A worker aligns each different stretch
once, many in one pass over their joined end arrays, and keeps a memo with a fixed
number of entries; stretches beyond it are aligned again in each batch.

Counts of linked id pairs are summed per document, then over the corpus. Their
table is as large as the vocabularies allow, whatever the corpus, and it is
broadcast only where its counted rows are at most ``broadcast_pairs``; else it is
joined by shuffle, where adaptive execution splits frequent pairs.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator, Sequence
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rangeloom.llm.token_output import _byte_letters
from rangeloom.llm.workers import held
from rangeloom.operators.staging import release, stage

BROADCAST_PAIRS = 2_000_000
_MEMO_ENTRIES = 150_000
_JOINED = 1 << 15
_BAR = "\u2581"
#: Fixed value: how byte-level BPE splits a text before it merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_BATCH_BYTES = 1 << 22
#: Beside a space that may end a stretch there is none of these: white space in anyone's reading, controls, marks of no width.
_ODD = "\\s\x00-\x1f\x7f-\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u2064\u2581\u3000\ufeff"
_CUT = re.compile(f"(?<=[^{_ODD}]) (?=[^{_ODD}])")
_PLAIN = re.compile(f"[^{_ODD}](.*[^{_ODD}])?", re.DOTALL)
_COUNTED = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, n_overlaps long, n_products long, groups_sha256 string, links array<struct<pair:long,n:int>>"


def intervals(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(end, owner in A, owner in B, whether both end there) of every elementary interval of two rising end arrays with the same last end."""
    cuts = np.union1d(ends_a, ends_b)
    a, b = np.searchsorted(ends_a, cuts), np.searchsorted(ends_b, cuts)
    return cuts, a, b, (ends_a[a] == cuts) & (ends_b[b] == cuts)


def group_products(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every pair (place in A, place in B) of tokens of the same group, from the products of the groups' sizes."""
    shared = np.intersect1d(ends_a, ends_b)
    group_a, group_b = np.searchsorted(shared, ends_a), np.searchsorted(shared, ends_b)
    size_b = np.bincount(group_b, minlength=len(shared))
    times = size_b[group_a]
    first = (np.cumsum(size_b) - size_b)[group_a]
    within = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    return np.repeat(np.arange(len(ends_a)), times), np.repeat(first, times) + within


class Aligner:
    """Both tokenizers, the bytes of their tokens, and a memo of aligned stretches.

    A's vocabulary and the order of its merges come from the tokenizer's file; tiktoken applies them. ``memo`` stretches are kept,
    those of a batch beyond them only until its end.
    """

    def __init__(self, byte_file: str, piece_file: str, memo: int = _MEMO_ENTRIES):
        import sentencepiece
        import tiktoken

        byte_of = {x: b for b, x in enumerate(_byte_letters())}
        made = json.loads(Path(byte_file).read_text(encoding="utf-8"))
        plain = {bytes(byte_of[c] for c in token): i for token, i in made["model"]["vocab"].items() if i not in {t["id"] for t in made["added_tokens"]}}
        self.a = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=plain, special_tokens={})
        self.bytes_a = [b""] * (max(plain.values()) + 1)
        for token, i in plain.items():
            self.bytes_a[i] = token
        self.b = b = sentencepiece.SentencePieceProcessor(model_file=piece_file)
        pieces = [b.id_to_piece(i) for i in range(b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else b"" if b.is_control(i) else p.replace(_BAR, " ").encode() for i, p in enumerate(pieces)]
        self.size_a, self.size_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        self.cuts = not any(_BAR in p.lstrip(_BAR) for p in pieces)
        #: Each id as text, ended by what stands after it in a group: another of its side, the other side, the next group.
        most = max(len(self.bytes_a), len(self.bytes_b))
        self.shown = [f"{i}{end}" for end in ",|;" for i in range(most)]
        self.most, self.known = memo, {}
        self.text: list[bytes] = []
        self.numbers, self.pairs, self.bad = np.zeros((0, 6), np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def _coded(self, stretches: list[str], plain: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids of A, ids of B, byte sizes, whether bytes agree) of stretches; plain ones are encoded many at a time, joined by the spaces between which they may stand."""
        sizes = np.fromiter((len(s.encode()) + 1 for s in stretches), np.int64, len(stretches))
        if plain:
            cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(sizes) // _JOINED)) + 1).tolist(), len(stretches)]
            texts = [" ".join(stretches[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if a < b]
        else:
            texts = stretches
        coded_a, coded_b = [self.a.encode_ordinary(" " + t) for t in texts], self.b.encode(texts, num_threads=1)
        ids_a, ids_b = (np.fromiter(chain.from_iterable(c), np.int64) for c in (coded_a, coded_b))
        if b"".join(map(self.bytes_a.__getitem__, ids_a.tolist())) == b"".join([(" " + t).encode() for t in texts]) == b"".join(map(self.bytes_b.__getitem__, ids_b.tolist())):
            return ids_a, ids_b, sizes, np.ones(len(stretches), bool)
        if plain:
            return self._coded(stretches, False)
        same = [b"".join([self.bytes_a[i] for i in x]) == (" " + t).encode() == b"".join([self.bytes_b[i] for i in y]) for x, y, t in zip(coded_a, coded_b, texts, strict=True)]
        kept = [np.array([i for x, ok in zip(c, same, strict=True) if ok for i in x], np.int64) for c in (coded_a, coded_b)]
        return *kept, sizes, np.array(same)

    def _aligned(self, stretches: list[str], plain: bool) -> None:
        """Append the stretches to the memo: their group strings, numbers, linked pairs, and whether bytes differ."""
        ids_a, ids_b, sizes, same = self._coded(stretches, plain)
        ends_a, ends_b = np.cumsum(self.size_a[ids_a]), np.cumsum(self.size_b[ids_b])
        cuts, own_a, own_b, both = intervals(ends_a, ends_b) if len(ids_a) else (np.zeros(0, np.int64),) * 3 + (np.zeros(0, bool),)
        shared = cuts[both]
        # Where each stretch ends among tokens, intervals and groups.
        ends = np.cumsum(sizes * same)
        upto = [np.searchsorted(x, ends, side="right") for x in (ends_a, ends_b, shared, cuts)]
        last_a, last_b = own_a[both], own_b[both]
        size_a, size_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
        upto.append(np.concatenate(([0], np.cumsum(size_a * size_b)))[upto[2]])
        numbers = np.stack([np.diff(u, prepend=0) for u in upto], 1)
        # Tokens in the order of groups, A's before B's, each with what ends it.
        group_a, group_b = np.repeat(np.arange(len(shared)), size_a), np.repeat(np.arange(len(shared)), size_b)
        after = (np.zeros(len(ids_a), np.int64), np.zeros(len(ids_b), np.int64))
        after[0][last_a], after[1][last_b] = 1, 2
        half = len(self.shown) // 3
        line = np.empty(len(ids_a) + len(ids_b), np.int64)
        line[np.arange(len(ids_a)) + np.concatenate(([0], np.cumsum(size_b)))[group_a]] = ids_a + half * after[0]
        line[np.arange(len(ids_b)) + np.cumsum(size_a)[group_b]] = ids_b + half * after[1]
        names = list(map(self.shown.__getitem__, line.tolist()))
        tokens, first = (upto[0] + upto[1]).tolist(), 0
        for to in tokens:
            self.text.append("".join(names[first:to]).encode())
            first = to
        at = len(self.pairs) + upto[2] - numbers[:, 2]
        self.numbers = np.concatenate([self.numbers, np.concatenate([numbers, at[:, None]], 1)])
        self.pairs = np.concatenate([self.pairs, ids_a[last_a] << 32 | ids_b[last_b]])
        self.bad = np.concatenate([self.bad, ~same])

    def _stretches(self, text: str) -> tuple[list[str], list[str]]:
        """The text's stretches, and those of them that may not stand between any two others."""
        if not self.cuts:
            return [text], [text]
        clear = text.replace("\n", "").isprintable() and not any(x in text for x in ("  ", " \n", "\n ", _BAR)) and text[0] not in " \n" and text[-1] not in " \n"
        if clear:
            return text.split(" "), []
        parts = _CUT.split(text)
        return parts, [p for p in parts if _BAR in p or not _PLAIN.fullmatch(p)]

    def align(self, texts: Sequence[str | None]) -> list[tuple]:
        """(n_a, n_b, n_groups, n_links, n_overlaps, n_products, groups_sha256, pairs, times) of each text; zeros, no hash and no pairs for null, empty or differing ones."""
        cut, odd, new = [], set(), set()
        for t in texts:
            parts, some = self._stretches(t) if t else ([], [])
            cut.append(parts)
            odd.update(some)
            new.update(set(parts).difference(self.known))
        kept = len(self.known)
        mine, rest = sorted(new - odd), sorted(odd)
        for names, plain in ((mine, True), (rest, False)):
            if names:
                at = len(self.text)
                self._aligned(names, plain)
                self.known.update(zip(names, range(at, len(self.text)), strict=True))
        out = []
        none = np.zeros(0, np.int64)
        for parts in cut:
            at = np.fromiter(map(self.known.__getitem__, parts), np.int64, len(parts))
            if not parts or self.bad[at].any():
                out.append((0, 0, 0, 0, 0, 0, "", none, none))
                continue
            numbers = self.numbers[at]
            n_a, n_b, groups, overlaps, products, _ = numbers.sum(0).tolist()
            times, start = numbers[:, 2], numbers[:, 5]
            places = np.arange(groups) + np.repeat(start - (np.cumsum(times) - times), times)
            pairs, counts = np.unique(self.pairs[places], return_counts=True)
            shown = b"".join(map(self.text.__getitem__, at.tolist()))
            out.append((n_a, n_b, groups, groups, overlaps, products, hashlib.sha256(memoryview(shown)[:-1]).hexdigest(), pairs, counts))
        # Of the new stretches the memo keeps the first plain ones for which it has room.
        stay = kept + min(len(mine), max(0, self.most - kept))
        for s in chain(mine[stay - kept :], rest):
            del self.known[s]
        del self.text[stay:]
        last = int(self.numbers[stay, 5]) if stay < len(self.numbers) else len(self.pairs)
        self.numbers, self.pairs, self.bad = self.numbers[:stay], self.pairs[:last], self.bad[:stay]
        return out


def _aligner(byte_file: str, piece_file: str) -> Aligner:
    return held(("aligner", byte_file, piece_file, _MEMO_ENTRIES), lambda: Aligner(byte_file, piece_file, _MEMO_ENTRIES))


def _counted(byte_file: str, piece_file: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, row = _aligner(byte_file, piece_file), TaskContext.get().partitionId() << 40
        for batch in batches:
            sizes = np.array([len(c.as_buffer()) if c.is_valid else 0 for c in batch.column(1)], np.int64)
            lo = 0
            while lo < batch.num_rows:
                n = max(1, int(np.searchsorted(np.cumsum(sizes[lo:]), _BATCH_BYTES, side="right")))
                piece = batch.slice(lo, n)
                found = aligner.align(piece.column(1).to_pylist())
                ends = np.concatenate(([0], np.cumsum([len(f[7]) for f in found])))
                links = pa.StructArray.from_arrays([pa.array(np.concatenate([f[7] for f in found]), pa.int64()), pa.array(np.concatenate([f[8] for f in found]), pa.int32())], ["pair", "n"])
                numbers = [pa.array([f[i] for f in found], pa.int64()) for i in range(6)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row + np.arange(n), pa.int64()), piece.column(0), *numbers, pa.array([f[6] for f in found], pa.string()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), links)],
                    [c.split()[0] for c in _COUNTED.split(", ")],
                )
                row, lo = row + n, lo + n

    return run


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, count, best) of every linked id pair, A's id times 2^32 plus B's: how many links hold it, and whether no other pair of its B id has more."""
    counts = aligned.select(F.inline("links")).groupBy("pair").agg(F.sum("n").alias("count"))
    most = F.max("count").over(Window.partitionBy(F.col("pair").bitwiseAND(0xFFFFFFFF)))
    return counts.select("pair", "count", (F.col("count") == most).alias("best"))


def align_tokenizers(docs: DataFrame, byte_file: str, piece_file: str, id_col: str = "doc_id", text_col: str = "text", broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """One row per document: (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, n_overlaps, n_products).

    A encodes space and text, B the text, to which it adds a space itself; strings of special tokens are plain text. A link is a pair of
    tokens that end at the same byte; its count is the number of links of the whole corpus that hold the same two ids. n_best: links whose count
    is the highest of their B id, ties included; count_sum: the sum over the links. n_overlaps are the elementary intervals, n_products all
    pairs within groups. Texts that are null, empty or differ from the joined bytes of either side have zeros and no hash (''). Rows without
    an id or that repeat one are documents of their own, an empty table gives an empty result, other columns are ignored.
    """
    picked = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    aligned = stage(picked.mapInArrow(_counted(byte_file, piece_file), _COUNTED), "aligned")
    pairs = stage(pair_counts(aligned), "token-pairs")
    side = pairs.select(F.col("pair").alias("_pair"), "count", "best")
    if pairs.count() <= broadcast_pairs:
        side = F.broadcast(side)
    own = ("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_overlaps", "n_products")
    met = aligned.select(*own, F.inline_outer("links")).join(side, F.col("pair") == F.col("_pair"), "left")
    best, total = F.sum(F.when(F.col("best"), F.col("n"))), F.sum(F.col("n") * F.col("count"))
    sums = met.groupBy(*own).agg(F.coalesce(best, F.lit(0)).cast("long").alias("n_best"), F.coalesce(total, F.lit(0)).cast("long").alias("count_sum"))
    out = stage(sums.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_overlaps", "n_products"), "alignment")
    release(aligned, pairs)
    return out
