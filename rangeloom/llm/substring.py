"""Substring dedup with prefix-partitioned suffix trees.

A passage repeats where a suffix-tree node of depth ``window`` words or more has
two leaves. Subtrees are built by prefix, and only where the tree branches:

1. Of the suffixes that start in a window only the one with the least hash of
   its first ``prefix`` words stands for it; equal windows choose the same one, so no
   repeat is lost and a fraction of all suffixes travels. These prefixes are
   counted. A prefix with a single suffix is a leaf, its branch ends.
2. A prefix with more than ``group_rows`` suffixes would not fit in memory. It is
   lengthened: its windows are counted by more and more of their words, and each
   takes the shortest prefix that few enough share, at last the whole window.
3. Suffixes travel with the words of their windows to the group of their prefix.
   A group is a subtree: its suffixes are sorted word by word, the lengths of
   common prefixes between neighbours are its internal nodes, and those to the left
   extend them. Windows that share a node of full depth are a repeat, compared
   as words and never as hashes. All but the first in (document, start) order go.
4. Documents meet their repeated windows, and covered words leave.

Hashes only deal out work. Suffixes travel packed per group; a task first settles
those whose words it has seen before, so a passage that a third of all documents
share costs a row per task and not one per document. A task of the second
half holds one group, of about ``group_rows`` suffixes, at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rangeloom.llm.words import text_bytes
from rangeloom.llm.workers import held
from rangeloom.operators.staging import release, shuffle_partitions, stage

WINDOW = 20
PREFIX = 6
GROUP_ROWS = 100_000
#: About as many bytes of text have one suffix that stands for a window.
_BYTES_A_SUFFIX = 40
_SLICE = 1 << 21
_FLUSH = 1 << 20
_TEXT_FLUSH = 1 << 25
_ROWS = 1 << 12
_CHUNK = 1 << 16
_KNOWN_WORDS, _LONG_WORD = 1 << 18, 64
_LAST_ID = (1 << 63) - 1
_POSITION = (1 << 24) - 1
_MIX, _FIRST, _SECOND = (np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F))
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


class _Hashes(dict):
    """XXH64 of words; the memo holds a bounded number of short ones."""

    def __missing__(self, word: bytes) -> int:
        found = xxhash.xxh64_intdigest(word)
        if len(word) <= _LONG_WORD:
            if len(self) >= _KNOWN_WORDS:
                self.clear()
            self[word] = found
        return found


class _Codes(dict):
    """A number for each different word."""

    def __missing__(self, word: bytes) -> int:
        found = self[word] = len(self)
        return found


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


def word_hashes(buf: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and hash of the words in ``buf``."""
    gone = np.concatenate(([True], _SPACE[np.frombuffer(buf, np.uint8)], [True]))
    turn = np.flatnonzero(gone[1:] != gone[:-1])
    begin, end = turn[::2], turn[1::2]
    hashes, known = np.empty(len(begin), np.uint64), held("word-hashes", _Hashes)
    for lo in range(0, len(begin), _CHUNK):
        hi = min(lo + _CHUNK, len(begin))
        hashes[lo:hi] = np.fromiter(map(known.__getitem__, buf[begin[lo] : end[hi - 1]].split()), np.uint64, hi - lo)
    return begin, end, hashes


def _run_hash(words: np.ndarray, length: int, base: np.uint64) -> np.ndarray:
    """Polynomial hash of every run of ``length`` values."""
    out, done, part, size = None, 0, words, 1
    power = lambda n: np.uint64(pow(int(base), n, 1 << 64))
    rest = length
    while rest:
        if rest & 1:
            out = part if out is None else out[: len(part) - done] + part[done:] * power(done) if len(part) > done else out[:0]
            done += size
        rest >>= 1
        if rest:
            part = part[:-size] + part[size:] * power(size) if len(part) > size else part[:0]
            size *= 2
    return out[: max(0, len(words) - length + 1)]


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size, out = 1, x
    while size * 2 <= width:
        out, size = np.minimum(out[:-size], out[size:]), size * 2
    return np.minimum(out[: len(x) - width + 1], out[width - size :])


class Suffixes:
    """The suffixes that stand for the windows of a run of documents laid end to end.

    anchor: word position of each suffix in the run; lo, hi: first and last of the
    windows that it stands for, which lie side by side; doc: its document in the
    run; key: hash of its prefix; base: position of each document's first word.
    """

    def __init__(self, texts: list[bytes], window: int, prefix: int):
        self.raw, self.window = b"\n".join(texts), window
        self.begin, self.end, self.words = word_hashes(self.raw)
        first = np.concatenate(([0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)[:-1]))
        of = np.searchsorted(first, self.begin, side="right") - 1
        self.base = np.searchsorted(of, np.arange(len(texts)))
        self.anchor = self.lo = self.hi = self.doc = np.empty(0, np.int64)
        self.key = np.empty(0, np.uint64)
        if len(self.words) < window:
            return
        grams = _run_hash(self.words, prefix, _FIRST)
        step, width = _POSITION + 1 - window, window - prefix + 1
        chosen = np.empty(len(self.words) - window + 1, np.int64)
        for lo in range(0, len(chosen), step):
            part = grams[lo : lo + step + width - 1]
            key = (_mix(part) & ~np.uint64(_POSITION)) | np.arange(len(part), dtype=np.uint64)
            chosen[lo : lo + step] = lo + (_sliding_min(key, width) & np.uint64(_POSITION)).astype(np.int64)
        start = np.flatnonzero(of[: len(chosen)] == of[window - 1 :])
        if not len(start):
            return
        new = np.flatnonzero(np.concatenate(([True], np.diff(chosen[start]) != 0)))
        self.lo, self.hi = start[new], start[np.concatenate((new[1:], [len(start)])) - 1]
        self.anchor, self.doc = chosen[self.lo], of[self.lo]
        self.key = grams[self.anchor]

    def longer(self, pick: np.ndarray, lengths: Sequence[int]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """(suffix, start, keys): every window of the picked suffixes, with a key for each length of its own prefix."""
        n = self.hi[pick] - self.lo[pick] + 1
        of = np.repeat(pick, n)
        start = self.lo[of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        place = self.key[of] + (self.anchor[of] - start).astype(np.uint64) * _SECOND
        return of, start, [_mix(_mix(place) + _run_hash(self.words, d, _SECOND)[start]) + np.uint64(d) for d in lengths]


def _lengths(window: int, prefix: int) -> list[int]:
    """Three longer prefixes, the last of them the window."""
    return sorted({prefix + (window - prefix) * k // 3 for k in (1, 2)} | {window})


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in pieces of a few MB of text, or one document where it is longer."""
    for batch in batches:
        sizes = np.array([len(c.as_buffer()) if c.is_valid else 0 for c in batch.column(2)], np.int64)
        lo = 0
        while lo < len(sizes):
            n = max(1, int(np.searchsorted(np.cumsum(sizes[lo:]), _SLICE, side="right")))
            yield batch.slice(lo, n)
            lo += n


def _suffixes(batches: Iterator[pa.RecordBatch], window: int, prefix: int) -> Iterator[tuple[pa.RecordBatch, Suffixes, np.ndarray, np.ndarray]]:
    """Each run with its suffixes, and ids and tags of their documents."""
    for batch in _runs(batches):
        s = Suffixes([text_bytes(c) for c in batch.column(2)], window, prefix)
        yield batch, s, batch.column(0).to_numpy(zero_copy_only=False)[s.doc], batch.column(1).to_numpy(zero_copy_only=False)[s.doc]


_TEXT = pa.Codec("zstd", 1)
#: A row has the members of one bucket as packed columns. ``kind`` 1: runs of positions that a task has settled; 2: keys of large groups.
_ROW = "bucket int, kind int, key binary, id binary, tag binary, pos binary, n binary, more binary, text binary, long int"
_TYPES = (np.uint64, np.int64, np.int64, "<u4", "<u4", "<u4")
_NONE = np.empty(0, np.uint64)


def _pack(buckets: np.ndarray, kind: int, key, ids, tags, pos, n, more, texts: list[bytes] | None = None) -> pa.RecordBatch:
    """Members by bucket, each bucket's in the order of their documents and positions."""
    order = np.lexsort((pos, tags, ids, buckets))
    to = buckets[order]
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(to)) + 1, [len(to)])) if len(to) else np.zeros(1, np.int64)
    columns = [x[order].astype(t) if len(x) else np.empty(0, t) for x, t in zip((key, ids, tags, pos, n, more), _TYPES, strict=True)]
    rows: list[list] = [[] for _ in range(10)]
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        cells = [c[a:b] for c in columns]
        cells[1] = np.diff(cells[1], prepend=0)
        text = b" ".join([texts[i] for i in order[a:b]]) if texts else b""
        put = [int(to[a]), kind, *[c.tobytes() for c in cells], _TEXT.compress(text, asbytes=True) if text else b"", len(text)]
        for col, x in zip(rows, put, strict=True):
            col.append(x)
    kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 7, pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], [c.split()[0] for c in _ROW.split(", ")])


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[int, list]]:
    """The columns of one bucket after another, by kind, of rows that are sorted by bucket."""
    held: dict[int, list[list]] = {}
    now = None
    for batch in batches:
        for bucket, kind, *cells in zip(*batch.columns, strict=True):
            if held and bucket.as_py() != now:
                yield {k: _joined(rows) for k, rows in held.items()}
                held = {}
            now = bucket.as_py()
            got = [np.frombuffer(c.as_buffer(), t) for c, t in zip(cells, _TYPES, strict=False)]
            got[1] = np.cumsum(got[1])
            text, long = cells[6].as_buffer(), cells[7].as_py()
            held.setdefault(kind.as_py(), []).append([*got, _TEXT.decompress(text, long, asbytes=True) if long else b""])
    if held:
        yield {k: _joined(rows) for k, rows in held.items()}


def _joined(rows: list[list]) -> list:
    *columns, texts = zip(*rows, strict=True)
    return [*(np.concatenate(c).astype(np.int64 if i > 2 else c[0].dtype) for i, c in enumerate(columns)), b" ".join(texts)]


def _to_documents(ids: np.ndarray, tags: np.ndarray, pos: np.ndarray, n: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Runs of positions packed by bucket of their document; positions that follow each other are one run."""
    order = np.lexsort((pos, tags, ids))
    ids, tags, pos, n = ids[order], tags[order], pos[order], n[order]
    if len(ids):
        new = np.concatenate(([True], (np.diff(ids) != 0) | (np.diff(tags) != 0) | (pos[1:] > pos[:-1] + n[:-1])))
        at = np.flatnonzero(new)
        end = np.maximum.reduceat(pos + n, at)
        ids, tags, pos, n = ids[at], tags[at], pos[at], end - pos[at]
    to = (_mix(ids.view(np.uint64) ^ tags.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
    return _pack(to, 0, _NONE, ids, tags, pos, n, _NONE)


def _by_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, tag, runs): runs of positions of each document as packed pairs (first, length) of unsigned 32-bit integers."""
    for held in _buckets(batches):
        _, ids, tags, pos, n, _, _ = held[0]
        order = np.lexsort((pos, tags, ids))
        ids, tags = ids[order], tags[order]
        pairs = np.stack((pos[order], n[order]), axis=1).astype("<u4")
        new = np.flatnonzero(np.concatenate(([True], (np.diff(ids) != 0) | (np.diff(tags) != 0))))
        for lo in range(0, len(new), _ROWS):
            first = new[lo : lo + _ROWS]
            end = int(new[lo + _ROWS]) if lo + _ROWS < len(new) else len(ids)
            ends = (np.concatenate((first, [end])) - first[0]).astype(np.int32) * 8
            packed = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(pairs[first[0] : end].tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array(ids[first], pa.int64()), pa.array(tags[first], pa.int64()), packed], ["id", "tag", "runs"])


def _deal_prefixes(window: int, prefix: int, buckets: int):
    """Map side of step 1: every prefix once a task with its count; where that is several, the task knows that it branches."""

    def flush(parts: list[tuple]) -> Iterator[pa.RecordBatch]:
        key, ids, tags, pos = map(np.concatenate, zip(*parts, strict=True))
        order = np.lexsort((pos, tags, ids, key))
        first = np.flatnonzero(np.concatenate(([True], key[order][1:] != key[order][:-1])))
        count = np.diff(np.concatenate((first, [len(order)])))
        rep = order[first]
        yield _pack((key[rep] % np.uint64(buckets)).astype(np.int64), 0, key[rep], ids[rep], tags[rep], pos[rep], count, _NONE)
        mine = order[np.repeat(count > 1, count)]
        yield _pack(np.full(len(mine), TaskContext.get().partitionId() % buckets), 1, _NONE, ids[mine], tags[mine], pos[mine], np.ones(len(mine), np.int64), _NONE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for _, s, ids, tags in _suffixes(batches, window, prefix):
            parts.append((s.key, ids, tags, s.anchor - s.base[s.doc]))
            held += len(s.key)
            if held >= _FLUSH:
                yield from flush(parts)
                parts, held = [], 0
        if held:
            yield from flush(parts)

    return run


def _branching(buckets: int, group_rows: int):
    """Reduce side of step 1: suffixes whose prefix has another suffix, and the prefixes of too many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _buckets(batches):
            if 1 in held:
                _, ids, tags, pos, n, _, _ = held[1]
                yield _to_documents(ids, tags, pos, n, buckets)
            if 0 in held:
                key, ids, tags, pos, n, _, _ = held[0]
                names, of = np.unique(key, return_inverse=True)
                total = np.bincount(of, n)
                hit = np.flatnonzero((total[of] > 1) & (n == 1))
                yield _to_documents(ids[hit], tags[hit], pos[hit], n[hit], buckets)
                large = names[total > group_rows]
                if len(large):
                    zero = np.zeros(len(large), np.int64)
                    yield _pack(zero, 2, large, zero, zero, zero, zero, zero)

    return run


def _count_longer(window: int, prefix: int, large: np.ndarray):
    """Step 2: (key, n) of the longer prefixes of the windows whose prefix is too frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, s, _, _ in _suffixes(batches, window, prefix):
            pick = np.flatnonzero(np.isin(s.key, large))
            if len(pick):
                keys = s.longer(pick, _lengths(window, prefix)[:-1])[2]
                names, n = np.unique(np.concatenate(keys), return_counts=True) if keys else (_NONE, _NONE)
                yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(n.astype(np.int64))], ["key", "n"])

    return run


def _deal_suffixes(window: int, prefix: int, buckets: int, large: np.ndarray, larger: np.ndarray):
    """Map side of step 3: branching suffixes with the words of their windows, by group. Of those with the same words the first travels."""

    def flush(parts: list[tuple], texts: list[bytes]) -> Iterator[pa.RecordBatch]:
        key, ids, tags, lo, n, off = map(np.concatenate, zip(*parts, strict=True))
        codes = _Codes()
        code = np.fromiter(map(codes.__getitem__, texts), np.int64, len(texts))
        order = np.lexsort((lo, tags, ids, off, code))
        same = lambda x: x[order][1:] == x[order][:-1]
        first = np.flatnonzero(np.concatenate(([True], ~(same(code) & same(off)))))
        head = order[np.repeat(first, np.diff(np.concatenate((first, [len(order)]))))]
        rep = order[first]
        yield _pack((key[rep] % np.uint64(buckets)).astype(np.int64), 0, key[rep], ids[rep], tags[rep], lo[rep], n[rep], off[rep], [texts[i] for i in rep])
        late = order[(ids[order] != ids[head]) | (tags[order] != tags[head]) | (lo[order] != lo[head])]
        yield _pack(np.full(len(late), TaskContext.get().partitionId() % buckets), 1, _NONE, ids[late], tags[late], lo[late], n[late], _NONE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, texts, held = [], [], 0
        for batch, s, ids, tags in _suffixes(batches, window, prefix):
            marked = np.zeros(len(s.words) + 1, bool)
            for doc, at in enumerate(batch.column(3)):
                marked[s.base[doc] + _positions(at.as_buffer())] = True
            pick = np.flatnonzero(marked[s.anchor]) if len(s.anchor) else s.anchor
            split = np.isin(s.key[pick], large)
            whole, of = pick[~split], pick[split]
            key, lo, hi = s.key[whole], s.lo[whole], s.hi[whole]
            if len(of):
                of, start, keys = s.longer(of, _lengths(window, prefix))
                own = keys[-1]
                for shorter in keys[-2::-1]:
                    own = np.where(np.isin(shorter, larger), own, shorter)
                whole, key, lo, hi = np.concatenate((whole, of)), np.concatenate((key, own)), np.concatenate((lo, start)), np.concatenate((hi, start))
            if len(whole):
                parts.append((key, ids[whole], tags[whole], lo - s.base[s.doc[whole]], hi - lo + 1, s.anchor[whole] - lo))
                new = [s.raw[a:b] for a, b in zip(s.begin[lo].tolist(), s.end[hi + window - 1].tolist(), strict=True)]
                texts += new
                held += sum(map(len, new))
            if held >= _TEXT_FLUSH:
                yield from flush(parts, texts)
                parts, texts, held = [], [], 0
        if texts:
            yield from flush(parts, texts)

    return run


def _positions(runs) -> np.ndarray:
    """Every position of packed runs."""
    first, n = np.frombuffer(runs, "<u4").reshape(-1, 2).astype(np.int64).T
    return np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def _nodes(words: np.ndarray) -> np.ndarray:
    """The node of each row's first k words, for k from 0 to all (rows of the result), from the sorted rows' common prefixes."""
    n, width = words.shape
    order = np.lexsort(words.T[::-1])
    equal = words[order][1:] == words[order][:-1]
    common = np.where(equal.all(axis=1), width, equal.argmin(axis=1)) if width else np.zeros(max(0, n - 1), np.int64)
    out = np.zeros((width + 1, n), np.int32)
    for k in range(1, width + 1):
        out[k, order[1:]] = np.cumsum(common < k)
    return out


def repeats_of_group(ids: np.ndarray, tags: np.ndarray, lo: np.ndarray, n: np.ndarray, off: np.ndarray, text: bytes, window: int, prefix: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, tag, start) of the windows that a group's suffixes stand for and that occur earlier in the group.

    A suffix stands for ``n`` windows from position ``lo`` on and begins ``off`` words later; the text has the words of all windows, suffix after suffix.
    """
    codes = _Codes()
    words = np.fromiter(map(codes.__getitem__, text.split()), np.int32)
    held = n + window - 1
    row = np.repeat(np.arange(len(n)), held)
    left = window - prefix
    place = np.arange(len(row)) - np.repeat(np.cumsum(held) - held, held) + np.repeat(left - off, held)
    table = np.full((len(n), left + window), -1, np.int32)
    table[row, place] = words
    order = np.lexsort((lo + off, tags, ids))
    ids, tags, lo, n, off, table = ids[order], tags[order], lo[order], n[order], off[order], table[order]
    right, back = _nodes(table[:, left:]), _nodes(table[:, :left][:, ::-1])
    found = []
    for before in range(left + 1):
        own = np.flatnonzero((off >= before) & (off - before < n))
        node = back[before, own].astype(np.int64) * len(ids) + right[window - before, own]
        _, first, of = np.unique(node, return_index=True, return_inverse=True)
        head, start = own[first[of]], lo + off - before
        late = own[(ids[own] != ids[head]) | (tags[own] != tags[head]) | (start[own] != start[head])]
        found.append((ids[late], tags[late], start[late]))
    return tuple(map(np.concatenate, zip(*found, strict=True)))


def _repeated(window: int, prefix: int, buckets: int):
    """Reduce side of step 3: the repeated windows of one group after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _buckets(batches):
            if 1 in held:
                _, ids, tags, lo, n, _, _ = held[1]
                yield _to_documents(ids, tags, lo, n, buckets)
            if 0 in held:
                _, ids, tags, lo, n, off, text = held[0]
                ids, tags, start = repeats_of_group(ids, tags, lo, n, off, text, window, prefix)
                yield _to_documents(ids, tags, start, np.ones(len(start), np.int64), buckets)

    return run


def _documents(docs: DataFrame, id_col: str, text_col: str, keep: Sequence[str] = ()) -> DataFrame:
    """(doc_id, id, tag, text, rest): id and tag put a null id last and tell texts under one id apart, rest has the kept columns."""
    text = F.col(f"`{text_col}`").cast("string")
    doc = F.col(f"`{id_col}`").cast("long")
    rest = F.struct(F.lit(True).alias("_"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)])
    tag = F.shiftrightunsigned(F.xxhash64(text), 2) + F.when(doc.isNull(), F.lit(1 << 62)).otherwise(F.lit(0))
    return docs.select(doc.alias("doc_id"), F.coalesce(doc, F.lit(_LAST_ID)).alias("id"), tag.alias("tag"), text.alias("text"), rest.alias("rest"))


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, prefix: int = PREFIX, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(id, tag, runs): packed runs (first start, number) of the windows of each document whose words also start earlier.

    Only documents that have such windows come back. id is the document's id
    (the largest long for null), tag tells its text from others of that id. The prefixes that are
    lengthened reach the driver and the tasks: one of 8 bytes for ``group_rows`` suffixes at most.
    """
    if not 0 < prefix <= window:
        raise ValueError("prefix must be between 1 and window")
    parts = shuffle_partitions(docs.sparkSession)
    table = _documents(docs, id_col, text_col)
    size = table.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(parts, -(-size // (_BYTES_A_SUFFIX * group_rows)))

    def met(dealt: DataFrame) -> DataFrame:
        return dealt.repartition(parts, "bucket").sortWithinPartitions("bucket")

    def by_document(found: DataFrame) -> DataFrame:
        return met(found).mapInArrow(_by_document, "id long, tag long, runs binary")

    texts = table.select("id", "tag", "text")
    prefixes = texts.mapInArrow(_deal_prefixes(window, prefix, buckets), _ROW)
    found = stage(met(prefixes).mapInArrow(_branching(buckets, group_rows), _ROW), "prefixes")
    large = np.array([k for r in found.where("kind = 2").select("key").collect() for k in np.frombuffer(r["key"], np.uint64)], np.uint64)
    larger = _NONE
    if len(large):
        counted = texts.mapInArrow(_count_longer(window, prefix, large), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
        larger = np.array([r["key"] for r in counted.where(F.col("n") > group_rows).select("key").collect()], np.int64).view(np.uint64)
    branching = by_document(found.where("kind = 0")).select(F.col("id").alias("_i"), F.col("tag").alias("_t"), "runs")
    near = table.join(branching.hint("shuffle_hash"), (F.col("id") == F.col("_i")) & (F.col("tag") == F.col("_t"))).select("id", "tag", "text", "runs")
    dealt = near.mapInArrow(_deal_suffixes(window, prefix, buckets, large, larger), _ROW)
    out = stage(by_document(met(dealt).mapInArrow(_repeated(window, prefix, buckets), _ROW)), "repeats")
    release(found)
    return out


def _kept_words(text: bytes, runs: bytes | None, window: int) -> tuple[int, list[bytes]]:
    words = text.split()
    if runs is None:
        return len(words), words
    edge = np.zeros(len(words) + 1, np.int64)
    first, n = np.frombuffer(runs, "<u4").reshape(-1, 2).astype(np.int64).T
    np.add.at(edge, first, 1)
    np.add.at(edge, first + n - 1 + window, -1)
    keep = np.cumsum(edge[:-1]) == 0
    return len(words), [words[i] for i in np.flatnonzero(keep)]


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, prefix: int = PREFIX, keep: Sequence[str] = (), group_rows: int = GROUP_ROWS
) -> DataFrame:
    """One row per document: (doc_id, text, n_words, n_removed, kept_sha256), then the columns of ``keep`` as they are.

    A word goes if a window of ``window`` words that covers it starts earlier as
    well: in a document with a smaller id or earlier in its own. ``text`` is what
    stays, joined by one space, and unchanged (null included) where nothing
    goes. A null id sorts last; rows under one id are told apart by 62 bits of a hash of their text,
    and exact repeats of a row do not make each other go. Empty tables and texts
    shorter than a window come back as they are. Columns outside ``keep`` are
    ignored; those in it must not have the names of the new ones.
    """
    table = _documents(docs, id_col, text_col, keep)
    found = repeated_windows(docs, id_col, text_col, window, prefix, group_rows).select(F.col("id").alias("_i"), F.col("tag").alias("_t"), "runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _runs(batches):
            out: list[list] = [[], [], [], []]
            for text, runs in zip(batch.column(2), batch.column(3), strict=True):
                total, kept = _kept_words(text_bytes(text), runs.as_py(), window)
                joined = b" ".join(kept)
                same = len(kept) == total
                for col, x in zip(out, ((text.as_py() if same else joined.decode()), total, total - len(kept), hashlib.sha256(joined).hexdigest()), strict=True):
                    col.append(x)
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, k) for c, k in zip(out, kinds, strict=True)], batch.column(4)],
                ["doc_id", "text", "n_words", "n_removed", "kept_sha256", "rest"],
            )

    met = table.join(found.hint("shuffle_hash"), (F.col("id") == F.col("_i")) & (F.col("tag") == F.col("_t")), "left")
    rest = table.schema["rest"].dataType
    kinds = StructType.fromDDL("doc_id long, text string, n_words long, n_removed long, kept_sha256 string").add("rest", rest)
    done = met.select("doc_id", "tag", "text", "runs", "rest").mapInArrow(run, kinds)
    return done.select("doc_id", "text", "n_words", "n_removed", "kept_sha256", *[F.col(f"rest.c{i}").alias(c) for i, c in enumerate(keep)])
