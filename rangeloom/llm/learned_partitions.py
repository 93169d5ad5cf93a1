"""Approximate nearest neighbours by inner product through learned partitions.

A bounded sample is fitted: its exact neighbour graph is split into balanced parts
that cut few edges (halved again and again along the graph's slowest direction of diffusion, then
refined by moves and swaps), and two softmax classifiers learn the parts. One places
any vector, so every row is indexed; the other predicts over which parts the
neighbours of a query spread and routes it to its most probable parts, whose rows are compared exactly.

How many parts a query visits is calibrated: true neighbours of at most ``CALIBRATION``
rows, found by a search of all parts, tell the least number of visits that finds
the share ``recall`` of them. A query also visits as many parts as it takes to see k other rows.

The rows of a part are dealt into blocks of about ``block`` rows and its queries into
blocks of their own, so a part with a third of all rows is many cells. A cell holds one
block of rows and streams its queries; each query leaves a cell with k rows at most.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rangeloom.operators.staging import release, shuffle_partitions, stage

K = 20
SAMPLE_ROWS = 8192
#: Queries whose true neighbours set the number of visits.
CALIBRATION = 256
RECALL = 0.97
PART_ROWS, LEAST_PARTS, MOST_PARTS = 8192, 4, 256
BLOCK = 8192
EDGES = 12
_STREAM = 256
_PLACED = "row long, id long, vector binary, part int"
_ROUTED = "row long, id long, vector binary, part int, turn int"
_FOUND = "query_row long, query_id long, vec_id long, part int, score double"


@dataclass(frozen=True)
class Model:
    """Weights of both classifiers, (1 + dim + 1, parts) each: a constant, the unit vector, the scaled length."""

    placing: np.ndarray
    routing: np.ndarray
    length: float

    def features(self, x: np.ndarray) -> np.ndarray:
        size = np.linalg.norm(x, axis=1, keepdims=True)
        return np.concatenate([np.ones_like(size), x / size, size / self.length], axis=1)

    def part(self, x: np.ndarray) -> np.ndarray:
        return np.argmax(self.features(x) @ self.placing, axis=1)

    def order(self, x: np.ndarray) -> np.ndarray:
        """Parts from the most to the least probable, one row for each query."""
        return np.argsort(-(self.features(x) @ self.routing), axis=1, kind="stable")


def neighbour_graph(x: np.ndarray, k: int = EDGES, rows: int = 1024) -> np.ndarray:
    """Places of the k largest inner products with each row of ``x``, itself excluded."""
    k = min(k, len(x) - 1)
    out = np.zeros((len(x), k), np.int64)
    for lo in range(0, len(x), rows):
        score = x[lo : lo + rows] @ x.T
        score[np.arange(len(score)), lo + np.arange(len(score))] = -np.inf
        out[lo : lo + rows] = np.argpartition(-score, k - 1, axis=1)[:, :k] if k else out[lo : lo + rows]
    return out


def _halved(nodes: np.ndarray, src: np.ndarray, dst: np.ndarray, rng: np.random.Generator, rounds: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """Two equal halves of ``nodes``, split at the median of the second eigenvector of the graph's random walk, by power iteration."""
    inside = np.full(max(src.max(initial=0), dst.max(initial=0), nodes.max()) + 1, -1)
    inside[nodes] = np.arange(len(nodes))
    a, b = inside[src], inside[dst]
    a, b = a[(a >= 0) & (b >= 0)], b[(a >= 0) & (b >= 0)]
    degree = np.bincount(a, minlength=len(nodes)) + 1.0
    v = rng.standard_normal(len(nodes))
    for _ in range(rounds):
        v -= (v * degree).sum() / degree.sum()
        v = (v + (np.bincount(a, v[b], len(nodes)) + v) / degree) / 2
        v /= np.linalg.norm(v) or 1.0
    order = np.argsort(v, kind="stable")
    half = len(nodes) // 2
    return nodes[order[:half]], nodes[order[half:]]


def balanced_parts(graph: np.ndarray, parts: int, slack: float = 0.05, rounds: int = 6, seed: int = 42) -> np.ndarray:
    """Part of each node, sizes within ``slack`` of equal: recursive halving, then moves of single nodes to the part of most of their neighbours where it has room, and swaps where not."""
    n, rng = len(graph), np.random.Generator(np.random.PCG64(seed))
    src, dst = np.repeat(np.arange(n), graph.shape[1]), graph.ravel()
    src, dst = np.concatenate([src, dst]), np.concatenate([dst, src])
    groups = [np.arange(n)]
    while len(groups) < parts:
        groups = [half for g in groups for half in _halved(g, src, dst, rng)]
    part = np.zeros(n, np.int64)
    for i, g in enumerate(groups):
        part[g] = i
    most = int(np.ceil(n / parts * (1 + slack)))
    for _ in range(rounds):
        weight = np.zeros((n, parts))
        np.add.at(weight, (src, part[dst]), 1)
        gain = weight - weight[np.arange(n), part][:, None]
        best = np.argmax(gain, axis=1)
        wish = np.flatnonzero(gain[np.arange(n), best] > 0)
        wish = wish[np.argsort(-gain[wish, best[wish]], kind="stable")]
        size = np.bincount(part, minlength=parts)
        waiting: dict[tuple[int, int], list[int]] = {}
        moved = 0
        for i in wish.tolist():
            here, there = int(part[i]), int(best[i])
            other = waiting.get((there, here))
            if size[there] < most and size[here] > 1:
                part[i], size[here], size[there], moved = there, size[here] - 1, size[there] + 1, moved + 1
            elif other:
                part[i], part[other.pop()], moved = there, here, moved + 2
            else:
                waiting.setdefault((here, there), []).append(i)
        if not moved:
            break
    return part


def softmax_fit(features: np.ndarray, wanted: np.ndarray, steps: int = 150, rate: float = 0.05, decay: float = 1e-5) -> np.ndarray:
    """Weights of a softmax regression to distributions ``wanted``, by Adam over all rows."""
    w = np.zeros((features.shape[1], wanted.shape[1]))
    first, second = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        z = features @ w
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        slope = features.T @ (p - wanted) / len(features) + decay * w
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope * slope
        w -= rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-9)
    return w


def fit(sample: np.ndarray, parts: int) -> Model:
    """Both classifiers from the balanced parts of the sample's neighbour graph."""
    graph = neighbour_graph(sample)
    part = balanced_parts(graph, parts) if parts > 1 else np.zeros(len(sample), np.int64)
    length = float(np.linalg.norm(sample, axis=1).max())
    model = Model(np.zeros((sample.shape[1] + 2, parts)), np.zeros((sample.shape[1] + 2, parts)), length)
    own = np.zeros((len(sample), parts))
    own[np.arange(len(sample)), part] = 1
    spread = np.zeros_like(own)
    np.add.at(spread, (np.repeat(np.arange(len(sample)), graph.shape[1]), part[graph.ravel()]), 1)
    total = spread.sum(axis=1, keepdims=True)
    features = model.features(sample)
    return Model(softmax_fit(features, own), softmax_fit(features, np.divide(spread, total, out=own.copy(), where=total > 0)), length)


def _wide(raw: list[bytes], dim: int) -> np.ndarray:
    """Packed vectors in double precision, shorter ones with zeros at their end."""
    out = np.zeros((len(raw), dim))
    for i, v in enumerate(raw):
        out[i, : len(v) // 8] = np.frombuffer(v, "<f8")
    return out


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(1)
        flat, ends = lists.flatten().to_numpy(zero_copy_only=False).astype("<f8").tobytes(), np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)))) * 8
        raw = [flat[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary()), pa.array(np.diff(ends) // 8, pa.int32())], ["id", "vector", "dim"])


def sound_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, vector, dim) of the rows that take part, packed as little-endian doubles: with an id, finite and not all zero."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), v.alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = rows.where(F.col("id").isNotNull() & F.coalesce(finite & F.exists("v", lambda x: x != 0), F.lit(False)))
    return rows.mapInArrow(_packed, "id long, vector binary, dim int")


def _placed(model: Model, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                part = model.part(_wide(batch.column(2).to_pylist(), dim)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(part)], [c.split()[0] for c in _PLACED.split(", ")])

    return run


def _routed(model: Model, dim: int, visits: int, enough: np.ndarray, k: int):
    """The parts that each query visits: the first ``visits``, and more until ``enough`` (rows by part) come to more than k."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            order = model.order(_wide(batch.column(2).to_pylist(), dim))
            seen = np.cumsum(enough[order], axis=1) - enough[order]
            take = (np.arange(order.shape[1]) < visits) | (seen <= k)
            row, turn = np.nonzero(take)
            picked = batch.take(pa.array(row))
            yield pa.RecordBatch.from_arrays([picked.column(0), picked.column(1), picked.column(2), pa.array(order[row, turn].astype(np.int32)), pa.array(turn.astype(np.int32))], [c.split()[0] for c in _ROUTED.split(", ")])

    return run


def _best(score: np.ndarray, ids: np.ndarray, x: np.ndarray, q: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of the k best rows for each query. The product only chooses; equal vectors get equal scores, summed each by itself."""
    score[own[:, None] == ids[None, :]] = -np.inf
    k = min(k, score.shape[1])
    least = np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k]
    near = 1e-12 * np.linalg.norm(q, axis=1) * np.linalg.norm(x, axis=1).max()
    one, two = np.nonzero((score >= (least - near)[:, None]) & np.isfinite(score))
    exact = np.concatenate([(q[one[i : i + 65536]] * x[two[i : i + 65536]]).sum(axis=1) for i in range(0, len(one), 65536)] or [np.zeros(0)])
    order = np.lexsort((ids[two], -exact, one))
    one, two, exact = one[order], two[order], exact[order]
    starts = np.searchsorted(one, np.arange(len(q)))
    kept = np.arange(len(one)) - starts[one] < k
    return one[kept], two[kept], exact[kept]


def _cells(dim: int, k: int):
    """Cells of a partition sorted by cell, rows before queries; one block of rows is held, queries come in short batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, x, ids, part = None, [], None, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            at = np.stack([batch.column(i).to_numpy() for i in range(4)])
            cuts = np.concatenate(([0], np.flatnonzero((at[:, 1:] != at[:, :-1]).any(axis=0)) + 1, [batch.num_rows]))
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                cell, asks = tuple(at[:3, lo].tolist()), bool(at[3, lo])
                if cell != last:
                    last, held, x = cell, [], None
                if not asks:
                    held.append(batch.slice(lo, hi - lo))
                    continue
                if not held:
                    continue
                if x is None:
                    x = _wide([v for b in held for v in b.column(6).to_pylist()], dim)
                    ids, part = np.concatenate([b.column(5).to_numpy() for b in held]), cell[0]
                for a in range(lo, hi, _STREAM):
                    piece = batch.slice(a, min(_STREAM, hi - a))
                    q, own = _wide(piece.column(6).to_pylist(), dim), piece.column(5).to_numpy()
                    one, two, score = _best(q @ x.T, ids, x, q, own, k)
                    yield pa.RecordBatch.from_arrays([pa.array(piece.column(4).to_numpy()[one]), pa.array(own[one]), pa.array(ids[two]), pa.array(np.full(len(one), part, np.int32)), pa.array(score)], [c.split()[0] for c in _FOUND.split(", ")])

    return run


def search_parts(placed: DataFrame, asked: DataFrame, sizes: dict[int, int], dim: int, k: int, block: int) -> DataFrame:
    """(query_row, query_id, vec_id, part, score, rank) of the k best rows that each query meets in the parts of ``asked``, ranks from 1, ties to smaller ids."""
    spark = placed.sparkSession
    table = spark.createDataFrame([(p, -(-n // block)) for p, n in sizes.items()], "_part int, blocks int")
    visits = asked.groupBy(F.col("part").alias("_asked")).agg(F.ceil(F.count("*") / block).cast("int").alias("turns"))
    shape = stage(table.join(visits, F.col("_part") == F.col("_asked")).select("_part", "blocks", "turns"), "part-shapes")
    own = lambda of: F.pmod(F.xxhash64("row"), F.col(of)).cast("int")
    every = lambda of, name: F.explode(F.sequence(F.lit(0), F.col(of) - 1)).alias(name)
    rows = placed.join(shape, F.col("part") == F.col("_part")).select("part", own("blocks").alias("i"), every("turns", "j"), F.lit(0).alias("asks"), "row", "id", "vector")
    queries = asked.join(shape, F.col("part") == F.col("_part")).select("part", every("blocks", "i"), own("turns").alias("j"), F.lit(1).alias("asks"), "row", "id", "vector")
    cells = rows.unionByName(queries).repartition(shuffle_partitions(spark), "part", "i", "j").sortWithinPartitions("part", "i", "j", "asks")
    found = stage(cells.mapInArrow(_cells(dim, k), _FOUND), "found")
    place = F.row_number().over(Window.partitionBy("query_row").orderBy(F.col("score").desc(), "vec_id"))
    best = found.withColumn("rank", place).where(F.col("rank") <= k)
    return best


def nearest_by_partitions(
    vectors: DataFrame,
    queries: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = K,
    recall: float = RECALL,
    sample_rows: int = SAMPLE_ROWS,
    part_rows: int = PART_ROWS,
    block: int = BLOCK,
) -> DataFrame:
    """(query_id, rank, vec_id, score, visits): for each row whose id fulfils ``queries`` (a condition on ``id``) its k nearest found, by inner product.

    Candidates are all rows but those with the query's own id; ties go to the smaller id, and a query with fewer than k candidates gets all.
    Null, empty and zero vectors, those with null or non-finite components and rows without an id take no part; a shorter vector counts as
    having zeros at its end. Rows that repeat an id are candidates each, and queries each. The score is the inner product of the
    original vectors in double precision; ``visits`` is the number of parts that queries were routed to. An empty table gives an
    empty result; other columns are ignored.
    """
    spark = vectors.sparkSession
    packed = stage(sound_vectors(vectors, id_col, vector_col).select(F.monotonically_increasing_id().alias("row"), "id", "vector", "dim"), "packed")
    total, dim = packed.agg(F.count("*"), F.max("dim")).first()
    if not total:
        release(packed)
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double, visits int")
    parts = 1 << int(np.clip(round(np.log2(total / part_rows)), np.log2(LEAST_PARTS), np.log2(MOST_PARTS)))
    drawn = F.pmod(F.xxhash64("row", F.lit("sample")), F.lit(1 << 40))
    share = lambda n: drawn < F.lit(int(min(1.0, n / total) * (1 << 40)))
    # Tables of up to ``sample_rows`` rows are their own sample.
    sample = packed.where(share(sample_rows)).select("vector").distinct().limit(2 * sample_rows).collect()
    parts = min(parts, 1 << (len(sample).bit_length() - 1))
    model = fit(_wide(sorted(bytes(r.vector) for r in sample), dim), parts)
    rows = stage(packed.select("row", "id", "vector").mapInArrow(_placed(model, dim), _PLACED), "placed")
    release(packed)
    sizes = {r.part: r.n for r in rows.groupBy("part").agg(F.count("*").alias("n")).collect()}
    filled = np.array([sizes.get(p, 0) for p in range(parts)])
    route = lambda q, visits: stage(q.select("row", "id", "vector", "part").mapInArrow(_routed(model, dim, visits, filled, k), _ROUTED), "routed")
    tried = route(rows.where(share(CALIBRATION)).limit(2 * CALIBRATION), parts)
    truth = search_parts(rows, tried, sizes, dim, k, block)
    met = truth.join(tried.select(F.col("row").alias("_row"), F.col("part").alias("_part"), "turn"), (F.col("query_row") == F.col("_row")) & (F.col("part") == F.col("_part")))
    turns = {r.turn: r.n for r in met.groupBy("turn").agg(F.count("*").alias("n")).collect()}
    upto = np.cumsum([turns.get(t, 0) for t in range(parts)])
    visits = int(np.searchsorted(upto, recall * upto[-1])) + 1 if upto[-1] else parts
    asked = route(rows.where(queries), visits)
    best = search_parts(rows, asked, sizes, dim, k, block)
    out = stage(best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score", F.lit(visits).alias("visits")), "nearest-found")
    release(rows, tried, asked)
    return out
