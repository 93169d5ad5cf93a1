"""Variable-capacity best-fit packing of documents into training sequences.

Several sequence lengths are permitted at once. Documents stand in shards of
equally many rows, and each shard is packed on its own: pieces in falling order
go to the open bin with the least room that takes them; where none does, a bin
opens at the size that costs least for each word it can expect to hold, given the
pieces still to come. At the end every bin shrinks to the least permitted
length that holds its contents. A document longer than the longest sequence
fills whole sequences first, and its rest is packed.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rangeloom.llm.words import word_count
from rangeloom.operators.prefix import running_total
from rangeloom.operators.staging import stage

CAPACITIES = (512, 1024, 2048, 4096)
SHARD_ROWS = 20_000
_SHARD_BITS = 32
_OUT = "doc_id long, piece int, start long, n_words long, bin_id long, capacity int, bin_offset int"


def _cheapest(size: int, lengths: list[int], left: dict[int, int], capacities: Sequence[int], costs: Sequence[float]) -> int:
    """The capacity with the least cost per word when filled up greedily with pieces that are left; the larger one of equals."""
    best, choice = None, capacities[-1]
    for capacity, cost in zip(capacities, costs, strict=True):
        room = capacity - size
        if room < 0:
            continue
        at = bisect_right(lengths, room)
        while room and at:
            at -= 1
            room -= min(left[lengths[at]], room // lengths[at]) * lengths[at]
            at = min(at, bisect_right(lengths, room))
        price = cost / (capacity - room)
        if best is None or price <= best:
            best, choice = price, capacity
    return choice


def best_fit(sizes: Sequence[int], capacities: Sequence[int] = CAPACITIES, costs: Sequence[float] | None = None) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each piece in falling order of ``sizes``, and the final capacity of each bin.

    ``sizes`` are positive, falling, and at most the largest capacity; ``capacities`` rise.
    """
    costs = costs or capacities
    lengths: list[int] = []
    left: dict[int, int] = {}
    for s in reversed(sizes):
        if not lengths or lengths[-1] != s:
            lengths.append(s)
        left[s] = left.get(s, 0) + 1
    rooms: list[int] = []
    by_room: dict[int, list[int]] = {}
    bins, offsets, used, opened = [], [], [], []
    for s in sizes:
        left[s] -= 1
        if not left[s]:
            lengths.pop()
        at = bisect_left(rooms, s)
        if at < len(rooms):
            room = rooms[at]
            b = by_room[room].pop()
            if not by_room[room]:
                rooms.pop(at)
        else:
            b = len(used)
            room = _cheapest(s, lengths, left, capacities, costs)
            used.append(0)
            opened.append(room)
        bins.append(b)
        offsets.append(used[b])
        used[b] += s
        room -= s
        if room:
            if not by_room.get(room):
                insort(rooms, room)
                by_room[room] = []
            by_room[room].append(b)
    return bins, offsets, [capacities[bisect_left(capacities, u)] for u in used]


def pack_shard(shard: int, ids: pa.Array, sizes: np.ndarray, capacities: Sequence[int], costs: Sequence[float] | None) -> pa.RecordBatch:
    """Every piece of the shard's documents with its place."""
    longest = capacities[-1]
    whole, rest = sizes // longest, sizes % longest
    full = np.repeat(np.arange(len(sizes)), whole)
    nth = np.arange(len(full)) - np.repeat(np.cumsum(whole) - whole, whole)
    some = np.flatnonzero(rest)
    some = some[np.argsort(-rest[some], kind="stable")]
    bins, offsets, caps = best_fit(rest[some].tolist(), capacities, costs)
    none = np.flatnonzero(sizes == 0)
    caps = np.array(caps, np.int64)
    bins = np.array(bins, np.int64)
    zero = lambda n: np.zeros(n, np.int64)
    row = np.concatenate((full, some, none))
    piece = np.concatenate((nth, whole[some], zero(len(none))))
    n_words = np.concatenate((np.full(len(full), longest), rest[some], zero(len(none))))
    place = np.concatenate((len(caps) + np.arange(len(full)), bins, zero(len(none))))
    capacity = np.concatenate((np.full(len(full), longest), caps[bins] if len(bins) else zero(0), zero(len(none))))
    offset = np.concatenate((zero(len(full)), np.array(offsets, np.int64), zero(len(none))))
    unplaced = n_words == 0
    return pa.RecordBatch.from_arrays(
        [
            ids.take(pa.array(row)),
            pa.array(piece, pa.int32()),
            pa.array(piece * longest, pa.int64()),
            pa.array(n_words, pa.int64()),
            pa.array((shard << _SHARD_BITS) + place, pa.int64(), mask=unplaced),
            pa.array(capacity, pa.int32(), mask=unplaced),
            pa.array(offset, pa.int32(), mask=unplaced),
        ],
        [c.split()[0] for c in _OUT.split(", ")],
    )


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: Column | None = None,
    capacities: Sequence[int] = CAPACITIES,
    costs: Sequence[float] | None = None,
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """One row per piece: (doc_id, piece, start, n_words, bin_id, capacity, bin_offset).

    The piece is ``n_words`` words of the document from ``start`` on; it stands at
    ``bin_offset`` of sequence ``bin_id``, whose length is ``capacity``. ``size`` counts
    words unless given; ``costs`` are the capacities unless given. A document without
    words (null, empty) has one row with null bin. Each of several rows with one
    id is packed; null ids are packed like others. Shards take equally many
    rows in hashed id order, so no key makes a large one, and hold at most
    ``shard_rows``. An empty table gives an empty result; other columns are ignored.
    """
    capacities = tuple(sorted(set(capacities)))
    if not capacities or capacities[0] < 1 or (costs is not None and len(costs) != len(capacities)):
        raise ValueError("capacities must be positive, costs one for each of them")
    n = F.greatest(F.coalesce(size.cast("long"), F.lit(0)), F.lit(0)) if size is not None else word_count(text_col)
    sizes = docs.select(F.col(id_col).cast("long").alias("doc_id"), n.alias("n"), F.lit(1).alias("one"))
    # Words are counted once: a range partitioning reads its input twice.
    placed = running_total(stage(sizes, "sizes"), "one", [F.xxhash64("doc_id"), F.col("doc_id"), F.col("n")], "at")
    shards = placed.select(F.floor((F.col("at") - 1) / shard_rows).cast("long").alias("shard"), "doc_id", "n")

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        table = table.sort_by([("doc_id", "ascending"), ("n", "ascending")]).combine_chunks()
        ids = table.column("doc_id").combine_chunks()
        yield pack_shard(key[0].as_py(), ids, table.column("n").to_numpy().astype(np.int64), capacities, costs)

    return shards.groupBy("shard").applyInArrow(run, _OUT)


def sequences(pieces: DataFrame) -> DataFrame:
    """One row per sequence: (bin_id, capacity, n_words, doc_ids, starts, lengths) in order of offset."""
    part = F.struct("bin_offset", "doc_id", "start", "n_words")
    bins = pieces.where("bin_id is not null").groupBy("bin_id", "capacity").agg(F.sum("n_words").alias("n_words"), F.array_sort(F.collect_list(part)).alias("parts"))
    return bins.select(
        "bin_id", "capacity", "n_words", F.col("parts.doc_id").alias("doc_ids"), F.col("parts.start").alias("starts"), F.col("parts.n_words").alias("lengths")
    )
