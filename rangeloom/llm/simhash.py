"""SimHash near-duplicates found through pivot distance tables.

A fingerprint consists of blocks of bits. Its Hamming distances to many reference
fingerprints are computed once, block by block, and stored: the distances of a
block to all references fill one long. Two fingerprints that differ in at most
``max_bits`` bits agree on all but ``max_bits`` of the blocks, hence have equal
distances there; one table per choice of agreeing blocks turns that into an
equi-join on the stored distances. In the other blocks a distance to a reference moves by no more
than the bits that differ, so a pair is discarded when the largest coordinate
differences of its blocks add up to more than ``max_bits``, and survivors are verified
by their own Hamming distance. No pair within the limit is missed.

Buckets of every size go one way: each is dealt into blocks of ``bucket_rows``
fingerprints, every pair of blocks is a cell, and a cell returns an edge for each
fingerprint that has a link there, never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

from rangeloom.llm.words import text_bytes
from rangeloom.operators.components import connected_components
from rangeloom.operators.staging import shuffle_partitions, stage

BITS = 64
BLOCKS = 4
REFERENCES = 12
_WIDE = 5
_PAIRS = 1 << 20
_SLICE = 1 << 17


def reference_fingerprints(n: int = REFERENCES) -> list[int]:
    """``n`` fixed pseudo-random 64-bit patterns, as signed longs."""
    return [int(np.uint64(xxhash.xxh64_intdigest(f"reference {i}".encode())).astype(np.int64)) for i in range(n)]


def _fold(hashes: list[int], starts: list[int], owners: list[int], counts: np.ndarray) -> None:
    """Add the set bits of ``hashes``, in runs that begin at ``starts``, to their owners' counts."""
    bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    np.add.at(counts, owners, np.add.reduceat(bits, starts, axis=0, dtype=np.int64))


def fingerprints(texts: list[bytes], width: int = 3, seed: int = 42) -> np.ndarray:
    """Signed 64-bit SimHash of each text; bounded slices of a text's shingles are hashed at a time."""
    counts, totals = np.zeros((len(texts), BITS), np.int64), np.zeros(len(texts), np.int64)
    digest = xxhash.xxh64_intdigest
    hashes: list[int] = []
    starts: list[int] = []
    owners: list[int] = []
    for row, text in enumerate(texts):
        words = text.lower().split()
        if not words:
            continue
        span = min(width, len(words))
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        begin = np.concatenate(([0], ends[:-1] + 1))[: len(words) - span + 1].tolist()
        end = ends[span - 1 :].tolist()
        totals[row] = len(begin)
        for at in range(0, len(begin), _SLICE):
            starts.append(len(hashes))
            owners.append(row)
            hashes += [digest(joined[a:b], seed) for a, b in zip(begin[at : at + _SLICE], end[at : at + _SLICE], strict=True)]
            if len(hashes) >= _SLICE:
                _fold(hashes, starts, owners, counts)
                hashes, starts, owners = [], [], []
    if hashes:
        _fold(hashes, starts, owners, counts)
    set_bits = np.packbits(counts * 2 > totals[:, None], axis=1, bitorder="little")
    return np.ascontiguousarray(set_bits).view("<u8").ravel().astype(np.int64)


def with_fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """Rows (id, fp): the 64-bit fingerprint of every whole text.

    Texts are lower-cased for A-Z; shingles of ``width`` words count as often as
    they occur; a shorter text is one shingle, and one without words (null, empty) has
    fingerprint zero. One row comes out for each row that goes in.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = fingerprints([text_bytes(c) for c in batch.column(1)], width)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp, pa.int64())], ["id", "fp"])

    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(run, "id long, fp long")


def with_distances(nodes: DataFrame) -> DataFrame:
    """``nodes`` with ``d0`` to ``d3``: each block's distances to all references, ``_WIDE`` bits each, the first reference lowest."""
    width = BITS // BLOCKS
    out = {}
    for b in range(BLOCKS):
        mask = F.lit(((1 << width) - 1) << (width * b) if b < BLOCKS - 1 else -(1 << (width * b)))
        each = [F.shiftleft(F.bit_count(F.col("fp").bitwiseXOR(F.lit(p)).bitwiseAND(mask)).cast("long"), _WIDE * i) for i, p in enumerate(reference_fingerprints())]
        out[f"d{b}"] = reduce(Column.bitwiseOR, each)
    return nodes.withColumns(out)


def pivot_tables(nodes: DataFrame, max_bits: int) -> DataFrame:
    """(tab, key, node): each fingerprint once per table, keyed by the stored distances of the blocks that must agree."""
    tables = [
        F.struct(F.lit(t).cast("byte").alias("tab"), F.array(*[F.col(f"d{b}") for b in kept]).alias("key"))
        for t, kept in enumerate(combinations(range(BLOCKS), BLOCKS - max_bits))
    ]
    return nodes.select("node", F.explode(F.array(*tables)).alias("t")).select("t.tab", "t.key", "node")


def _pairs_of_cells(cell: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of all rows of one cell, for rows sorted by cell, a bounded number at a time."""
    ends = np.searchsorted(cell, cell, side="right")
    after = ends - np.arange(len(cell)) - 1
    lo = 0
    while lo < len(cell):
        n = max(1, int(np.searchsorted(np.cumsum(after[lo:]), _PAIRS, side="right")))
        one = np.repeat(np.arange(lo, lo + n), after[lo : lo + n])
        yield one, one + 1 + np.arange(len(one)) - np.repeat(np.cumsum(after[lo : lo + n]) - after[lo : lo + n], after[lo : lo + n])
        lo += n


def close_pairs(fp: np.ndarray, distances: list[np.ndarray], one: np.ndarray, two: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs within ``max_bits`` bits: those that the distances to the references leave, verified by the fingerprints."""
    most = np.zeros(len(one), np.int64)
    for d in distances:
        largest = np.zeros(len(one), np.int64)
        for i in range(REFERENCES):
            at = (d >> np.int64(_WIDE * i)) & np.int64((1 << _WIDE) - 1)
            np.maximum(largest, np.abs(at[one] - at[two]), out=largest)
        most += largest
    left = np.flatnonzero(most <= max_bits)
    one, two = one[left], two[left]
    near = np.bitwise_count(fp[one].view(np.uint64) ^ fp[two].view(np.uint64)) <= max_bits
    return one[near], two[near]


def _roots(n: int, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """The smallest index that each of ``n`` rows reaches over the pairs."""
    root = np.arange(n)
    while len(one):
        old = root.copy()
        low = np.minimum(root[one], root[two])
        np.minimum.at(root, one, low)
        np.minimum.at(root, two, low)
        root = root[root]
        if (root == old).all():
            break
    return root


def _cells(max_bits: int):
    """(src, dst) of the linked rows of each cell; a cell's rows follow each other, and whole cells are held in pieces of a batch or more."""

    def links(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        cell = np.cumsum(np.concatenate(([0], t.column(0).to_numpy()[1:] != t.column(0).to_numpy()[:-1])))
        side, node, fp, *distances = (t.column(i).to_numpy() for i in range(1, 4 + BLOCKS))
        found = []
        for one, two in _pairs_of_cells(cell):
            # A pair within one block of two is left to that block's own cell.
            own = (side[one] == 0) | (side[one] != side[two])
            found.append(close_pairs(fp, distances, one[own], two[own], max_bits))
        one, two = map(np.concatenate, zip(*found, strict=True))
        root = _roots(t.num_rows, one, two)
        at = np.flatnonzero(node[root] != node)
        return pa.RecordBatch.from_arrays([pa.array(node[root[at]]), pa.array(node[at])], ["src", "dst"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            cell = batch.column(0).to_numpy()
            cut = int(np.searchsorted(cell, cell[-1]))
            if cut:
                held.append(batch.slice(0, cut))
            if held and (cut or held[-1].column(0)[-1].as_py() != cell[-1]):
                yield links(held)
                held = []
            held.append(batch.slice(cut))
        if held:
            yield links(held)

    return run


def fingerprint_links(nodes: DataFrame, max_bits: int = 2, bucket_rows: int = 1024) -> DataFrame:
    """Edges (src, dst) whose components are those of all pairs within ``max_bits`` bits.

    ``nodes`` has different fingerprints ``fp`` with an id ``node`` each. ``max_bits`` is below the number of blocks.
    The result does not depend on ``bucket_rows``.
    """
    if not 0 <= max_bits < BLOCKS:
        raise ValueError(f"max_bits must be below {BLOCKS}")
    stored = stage(with_distances(nodes), "distances")
    entries = pivot_tables(stored, max_bits)
    sizes = stage(entries.groupBy("tab", "key").agg(F.count("*").alias("n")).where("n > 1").withColumn("bucket", F.monotonically_increasing_id()), "buckets")
    split = F.ceil(F.col("n") / bucket_rows).cast("int")
    dealt = entries.join(sizes, ["tab", "key"]).select("bucket", "node", split.alias("split"), F.pmod(F.xxhash64("node"), split).cast("int").alias("own"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("split") - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    side = F.when(low == high, 0).when(F.col("own") == low, 1).otherwise(2).cast("byte")
    cells = stage(dealt.select(F.struct("bucket", low.alias("i"), high.alias("j")).alias("cell"), side.alias("side"), "node"), "cells")
    numbered = stage(cells.groupBy("cell").agg(F.count("*").alias("n")).withColumn("number", F.monotonically_increasing_id()).select("cell", "number"), "cell-numbers")
    cells = cells.join(numbered, "cell").select("number", "side", "node").join(stored, "node")
    met = cells.select("number", "side", "node", "fp", *[f"d{b}" for b in range(BLOCKS)])
    met = met.repartition(shuffle_partitions(nodes.sparkSession), "number").sortWithinPartitions("number")
    return met.mapInArrow(_cells(max_bits), "src long, dst long")


def simhash_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, max_bits: int = 2, bucket_rows: int = 1024
) -> DataFrame:
    """One row per document: (doc_id, fingerprint, component_id).

    ``component_id`` is the smallest id reachable over links of at most
    ``max_bits`` differing bits, itself included. Equal fingerprints are one
    node, so copies are never paired. A row whose id is null has its fingerprint and
    a null component; rows that repeat an id each come back; an empty table
    gives an empty result. Other columns are ignored.
    """
    prints = stage(with_fingerprint(docs, id_col, text_col, width), "fingerprints")
    nodes = stage(prints.where("id is not null").groupBy("fp").agg(F.min("id").alias("node")), "nodes")
    found = connected_components(fingerprint_links(nodes, max_bits, bucket_rows))
    label = nodes.join(found, "node", "left").select(F.col("fp").alias("of"), F.coalesce("component", "node").alias("component_id"))
    label = stage(label, "labels")
    return prints.join(label, F.col("fp") == F.col("of"), "left").select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"),
    )


def orderable(kind: DataType) -> bool:
    """Whether Spark can sort by a type; it cannot by maps and variants, wherever they are nested."""
    if isinstance(kind, StructType):
        return all(orderable(f.dataType) for f in kind)
    return orderable(kind.elementType) if isinstance(kind, ArrayType) else kind.typeName() not in ("map", "variant")


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, max_bits: int = 2) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its group, one row for each id.

    Of rows that repeat such an id the first in the order of all orderable columns stays. Rows
    with a null id stay, as nothing can stand for them. Only ids that go or repeat are joined, which are fewer than those that stay.
    """
    groups = simhash_groups(docs, id_col, text_col, width, max_bits)
    stays = F.max((F.col("doc_id") == F.col("component_id")).cast("int"))
    odd = groups.where("doc_id is not null").groupBy("doc_id").agg(stays.alias("stays"), F.count("*").alias("n"))
    odd = stage(odd.where("stays = 0 or n > 1").select(F.col("doc_id").alias("id"), "stays"), "gone-or-repeated")
    doc = F.col(f"`{id_col}`").cast("long")
    packed = docs.select(doc.alias("id"), F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("row"))
    once = packed.join(odd.select("id"), "id", "left_anti").select("row")
    order = [i for i, f in enumerate(docs.schema) if orderable(f.dataType)]
    several = packed.join(odd.where("stays = 1").select("id"), "id", "left_semi")
    several = several.groupBy("id").agg(F.min_by("row", F.struct(*[F.col(f"row.c{i}") for i in order])).alias("row")).select("row")
    kept = once.unionByName(several)
    return kept.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)])
