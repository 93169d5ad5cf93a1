"""Near-duplicate vectors through Euclidean p-stable hashing.

Normalised vectors fall into buckets of ``tables`` hash tables, each keyed by
``hashes`` random Gaussian projections quantised to ``width``. Unit vectors at cosine
c are sqrt(2 - 2c) apart; with the defaults a pair at cosine 0.93 meets in some
table with a probability of 0.95 and one at 0.98 always but for 1 in 10^5, while
unrelated directions meet in one table of 10^5. Pairs that meet are verified by their cosine in double precision.

Equal vectors are one node with a count. A bucket is dealt into blocks of at most
``block`` vectors and every pair of blocks is one cell, compared by a matrix
product; a cell returns each vector's links and a spanning edge, never its pairs. A pair that
meets in several tables is counted in the first of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rangeloom.operators.components import connected_components
from rangeloom.operators.staging import shuffle_partitions, stage

COSINE = 0.93
TABLES, HASHES, WIDTH = 40, 16, 2.0
BLOCK = 256
_KEYED = "node long, label string, copies long, dim int, keys array<long>, raw binary"
_LINKED = "node long, links long, root long"


@lru_cache(maxsize=8)
def _projections(dim: int, tables: int, hashes: int, width: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64([dim, tables, hashes]))
    return rng.standard_normal((dim, tables * hashes)), rng.uniform(0, width, tables * hashes), rng.integers(1, 1 << 62, (tables, hashes), dtype=np.int64) | 1


def bucket_keys(unit: np.ndarray, tables: int = TABLES, hashes: int = HASHES, width: float = WIDTH) -> np.ndarray:
    """One signed 64-bit key per table for each row of unit vectors."""
    a, b, mix = _projections(unit.shape[1], tables, hashes, width)
    cell = np.floor((unit @ a + b) / width).astype(np.int64).reshape(len(unit), tables, hashes)
    return (cell * mix).sum(axis=2)


def _raw(v: list[float]) -> bytes:
    """A vector's components, as 32-bit floats where those are exact."""
    wide = np.array(v, np.float64)
    small = wide.astype(np.float32)
    return b"f" + small.tobytes() if (small == wide).all() else b"d" + wide.tobytes()


def _units(raw: list[bytes]) -> np.ndarray:
    """Unit vectors in double precision of packed ones of one dimension."""
    x = np.stack([np.frombuffer(v, "<f4" if v[:1] == b"f" else "<f8", offset=1).astype(np.float64) for v in raw])
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _keyed(tables: int, hashes: int, width: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(3).to_pylist()
            by_dim: dict[int, list[int]] = {}
            for i, v in enumerate(vectors):
                by_dim.setdefault(len(v), []).append(i)
            for dim, rows in by_dim.items():
                raw = [_raw(vectors[i]) for i in rows]
                keys = bucket_keys(_units(raw), tables, hashes, width)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * tables, pa.int32()), pa.array(keys.ravel(), pa.int64()))
                picked = batch.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([picked.column(0), picked.column(1), picked.column(2), pa.array([dim] * len(rows), pa.int32()), lists, pa.array(raw, pa.binary())], [c.split()[0] for c in _KEYED.split(", ")])

    return run


def _cell_links(nodes: np.ndarray, labels: np.ndarray, copies: np.ndarray, keys: np.ndarray, raw: list[bytes], dims: np.ndarray, blocks: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node, links, root) of the members of one cell that have links; ``keys`` are those of the tables before the cell's.

    A pair within one block of two is left to that block's own cell, and a pair that met in an earlier table is counted there.
    """
    links, root = np.zeros(len(nodes), np.int64), np.arange(len(nodes))
    hit = np.zeros(len(nodes), bool)
    for dim in np.unique(dims):
        rows = np.flatnonzero(dims == dim)
        x = _units([raw[i] for i in rows])
        same = (labels[rows][:, None] == labels[rows][None, :]) & (x @ x.T >= cosine)
        if blocks.max() != blocks.min():
            same &= blocks[rows][:, None] != blocks[rows][None, :]
        one, two = np.nonzero(np.triu(same, 1))
        if not len(one):
            continue
        one, two = rows[one], rows[two]
        first = ~(keys[one] == keys[two]).any(axis=1)
        np.add.at(links, one, np.where(first, copies[two], 0))
        np.add.at(links, two, np.where(first, copies[one], 0))
        hit[one] = hit[two] = True
        while True:
            low = np.minimum(root[one], root[two])
            old = root.copy()
            np.minimum.at(root, one, low)
            np.minimum.at(root, two, low)
            root = root[root]
            if (root == old).all():
                break
    at = np.flatnonzero(hit)
    return nodes[at], links[at], nodes[root[at]]


def _cells(cosine: float):
    """Cells of a partition sorted by cell; one cell is held at a time."""

    def finish(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        keys = t.column(6).flatten().to_numpy().reshape(t.num_rows, -1)
        labels = t.column(4).dictionary_encode().indices.to_numpy()
        found = _cell_links(t.column(3).to_numpy(), labels, t.column(5).to_numpy(), keys, t.column(7).to_pylist(), t.column(8).to_numpy(), t.column(9).to_numpy(), cosine)
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], ["node", "links", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cell = np.stack([batch.column(i).to_numpy() for i in range(3)])
            cuts = np.concatenate(([0], np.flatnonzero((cell[:, 1:] != cell[:, :-1]).any(axis=0)) + 1, [batch.num_rows]))
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                now = tuple(cell[:, lo])
                if held and now != last:
                    yield finish(held)
                    held = []
                held.append(batch.slice(lo, hi - lo))
                last = now
        if held:
            yield finish(held)

    return run


def _finite(v: str):
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(ok & F.exists(v, lambda x: x != 0), F.lit(False))


def vector_groups(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    cosine: float = COSINE,
    tables: int = TABLES,
    hashes: int = HASHES,
    width: float = WIDTH,
    block: int = BLOCK,
) -> DataFrame:
    """One row per vector: (vec_id, n_links, component_id, kept).

    Vectors link when their labels are equal as text and not null, their dimensions are
    equal and their cosine is at least ``cosine``. Null, empty and zero vectors and those
    with null or non-finite components link with nothing, and so do rows without an id,
    whose component is null and which are not kept. Rows that repeat an id are vectors of
    their own which share a component. An empty table gives an empty result; other columns are ignored.
    """
    v = F.col(f"`{vector_col}`").cast("array<double>")
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{label_col}`").cast("string").alias("label"), v.alias("v"))
    sound = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & _finite("v")
    rows = rows.select("vec_id", F.when(sound, F.col("label")).alias("label"), F.when(sound, F.col("v")).alias("v"))
    nodes = rows.where("v is not null").groupBy("label", "v").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"))
    nodes = stage(nodes, "vector-nodes")
    keyed = stage(nodes.select("node", "label", "copies", "v").mapInArrow(_keyed(tables, hashes, width), _KEYED), "vector-keys")
    entries = keyed.select("node", "label", "dim", F.posexplode("keys").alias("tab", "key"))
    entries = entries.select("node", "tab", F.xxhash64("label", "dim", "tab", "key").alias("bucket"))
    sizes = entries.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    live = entries.join(stage(sizes, "vector-buckets"), "bucket")
    split = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.xxhash64("node"), split).cast("int")
    dealt = live.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), split - 1)))
    dealt = dealt.select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "tab", "own")
    dealt = stage(dealt, "vector-cells")
    met = dealt.join(keyed.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"))
    met = met.select("bucket", "i", "j", "node", "label", "copies", F.slice("keys", F.lit(1), F.col("tab")).alias("keys"), "raw", "dim", "own")
    parts = shuffle_partitions(vectors.sparkSession)
    found = met.repartition(parts, "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j").mapInArrow(_cells(cosine), _LINKED)
    found = stage(found, "vector-links")
    groups = connected_components(found.select(F.col("node").alias("src"), F.col("root").alias("dst")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    known = nodes.join(links, "node", "left").join(groups.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left")
    known = stage(known.select(F.col("label").alias("_label"), F.col("v").alias("_v"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component")), "vector-classes")
    out = rows.join(known, (F.col("label") == F.col("_label")) & (F.col("v") == F.col("_v")), "left")
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("component", "vec_id"), F.lit(False)).alias("kept"),
    )
