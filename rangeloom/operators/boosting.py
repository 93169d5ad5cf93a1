"""Multi-class gradient boosting with a softmax loss, many training runs in the same jobs.

Features are cut into bins once. Each round grows a tree for every class of every run, level by level: tasks sum
gradients and Hessians of their rows by run, class, node, feature and bin, a grouped aggregation adds
the tasks' sums up, and running sums over the bins give the best split of each node. A run is a key of these histograms: dropped features, left-out
classes and held-out files are masks over the same binned rows, so a sweep takes as many jobs as its largest run.

The driver holds trees and one row for each node of the level that is grown; margins are written with the rows
every ``KEPT_ROUNDS`` rounds, so that a lost executor costs a pass and not the training.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from rangeloom.operators.names import fresh
from rangeloom.operators.staging import release, stage

BINS = 32
KEPT_ROUNDS = 2
_BINNED = "bins binary, label int, file int, weight double, margins binary"
_SUMS = "run int, class int, node int, feature int, bin int, g double, h double"


@dataclass(frozen=True)
class Run:
    """Settings of one training run. ``features`` are all where None; rows of ``without_classes`` and ``without_files`` are not learned from."""

    name: str
    rounds: int = 100
    depth: int = 4
    rate: float = 0.3
    least_gain: float = 0.5
    ridge: float = 1.0
    least_weight: float = 1.0
    features: tuple[str, ...] | None = None
    without_classes: tuple[int, ...] = ()
    without_files: tuple = ()


@dataclass
class Tree:
    """Nodes in heap order: the feature that splits (-1 in a leaf), the last bin that goes left, the value of a leaf, the split's gain."""

    feature: np.ndarray
    last: np.ndarray
    value: np.ndarray
    gain: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> Tree:
        n = 2 ** (depth + 1) - 1
        return cls(np.full(n, -1), np.zeros(n, np.int64), np.zeros(n), np.zeros(n))

    def node(self, bins: np.ndarray, levels: int) -> np.ndarray:
        """Where each row stands after so many levels; a leaf is not left."""
        at = np.zeros(len(bins), np.int64)
        for _ in range(levels):
            f = self.feature[at]
            at = np.where(f >= 0, 2 * at + 1 + (bins[np.arange(len(bins)), np.maximum(f, 0)] > self.last[at]), at)
        return at


@dataclass
class Boosted:
    """Trees of all runs: ``rounds[t][run, class]``."""

    features: tuple[str, ...]
    edges: list[np.ndarray]
    classes: tuple[int, ...]
    runs: tuple[Run, ...]
    rounds: list[dict[tuple[int, int], Tree]] = field(default_factory=list)

    def add(self, margins: np.ndarray, bins: np.ndarray, first: int, last: int) -> np.ndarray:
        """Margins (rows, runs, classes) with the trees of some rounds."""
        for t in range(first, last):
            for (r, k), tree in self.rounds[t].items():
                margins[:, r, k] += tree.value[tree.node(bins, self.runs[r].depth)]
        return margins

    def since(self, first: int) -> Boosted:
        """The model with its rounds from ``first`` on and without edges, for tasks that need no more."""
        return Boosted(self.features, [], self.classes, self.runs, self.rounds[first:])

    def allowed(self, r: int) -> np.ndarray:
        """Places of the classes that a run knows."""
        return np.array([i for i, c in enumerate(self.classes) if c not in self.runs[r].without_classes])

    def told(self, margins: np.ndarray, r: int) -> np.ndarray:
        """Class of each row, the first of equals."""
        allowed = self.allowed(r)
        return np.array(self.classes)[allowed[np.argmax(margins[:, r, allowed], axis=1)]]


def bin_edges(table: DataFrame, features: Sequence[str], bins: int = BINS) -> list[np.ndarray]:
    """Upper ends of each feature's bins but the last, at most ``bins - 1``: at equal shares of the rows, halfway from a value to the next one, from one aggregate."""
    if not 2 <= bins <= 255:
        raise ValueError("bins must be between 2 and 255")
    rows = max(1, table.count())
    shares = [min(1.0, i / bins + more) for more in (0.0, 1 / rows) for i in range(1, bins)]
    value = lambda c: F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double"))
    row = table.agg(*[F.percentile_approx(value(c), shares, 10_000).alias(f"e{i}") for i, c in enumerate(features)]).first()
    found = [np.array(row[f"e{i}"] or [], float).reshape(2, -1) for i in range(len(features))]
    return [np.unique((low + high) / 2) for low, high in found]


def bin_numbers(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Bin of each value, from 1 on; 0 for a missing one, which so counts as less than all."""
    return np.where(np.isnan(values), 0, np.searchsorted(edges, values, side="left") + 1).astype(np.uint8)


def _columns(batch: pa.RecordBatch, first: int, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([bin_numbers(batch.column(first + i).to_numpy(zero_copy_only=False).astype(float), e) for i, e in enumerate(edges)], 1) if edges else np.zeros((batch.num_rows, 0), np.uint8)


def _packed(rows: np.ndarray) -> pa.Array:
    """Each row of an array as bytes."""
    width = rows.dtype.itemsize * int(np.prod(rows.shape[1:], dtype=np.int64))
    ends = np.arange(len(rows) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


def _unpacked(column: pa.Array, kind, shape: tuple[int, ...]) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), *shape)


def _numeric(table: DataFrame, features: Sequence[str]) -> list:
    return [F.col(f"`{c}`").cast("double").alias(f"f{i}") for i, c in enumerate(features)]


def _code(table: DataFrame, column: str, known: Sequence):
    """Place of a column's value among a few known ones, -1 for others and null."""
    if not known:
        return F.lit(-1)
    kind = table.schema[column].dataType
    values = F.array(*[F.lit(x).cast(kind) for x in known])
    return F.coalesce(F.array_position(values, F.col(f"`{column}`")).cast("int") - 1, F.lit(-1))


def _binned(table: DataFrame, model: Boosted, label: str, weight: str | None, file_col: str | None, files: Sequence) -> DataFrame:
    shape = (len(model.runs), len(model.classes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            margins = np.zeros((batch.num_rows, *shape))
            yield pa.RecordBatch.from_arrays([_packed(_columns(batch, 3, model.edges)), *[batch.column(i) for i in range(3)], _packed(margins)], [c.split()[0] for c in _BINNED.split(", ")])

    own = [_code(table, label, model.classes).alias("label"), (_code(table, file_col, files) if file_col else F.lit(-1)).alias("file"), (F.col(f"`{weight}`").cast("double") if weight else F.lit(1.0)).alias("weight")]
    return table.select(*own, *_numeric(table, model.features)).where("label >= 0 and weight > 0").mapInArrow(run, _BINNED)


def gradients(margins: np.ndarray, codes: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the softmax loss, (rows, classes) each."""
    p = np.exp(margins - margins.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    y = np.zeros_like(p)
    y[np.arange(len(codes)), codes] = 1
    return (p - y) * weight[:, None], np.maximum(2 * p * (1 - p), 1e-16) * weight[:, None]


def _histograms(model: Boosted, growing: dict[tuple[int, int], Tree], level: int, first: int, files: Sequence):
    """Sums of a task's rows at one level of the trees that grow; the trees from round ``first`` on are not in the margins yet."""
    shape, width = (len(model.runs), len(model.classes)), len(model.features)
    bins_most = max([len(e) for e in model.edges], default=0) + 2
    wanted = [[i for i, c in enumerate(model.features) if c in (run.features or model.features)] for run in model.runs]
    model = model.since(first)
    runs = sorted({r for r, _ in growing})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes = 2**level
        sums = {key: np.zeros((2, width, nodes * bins_most)) for key in growing}
        for batch in batches:
            if not batch.num_rows:
                continue
            bins = _unpacked(batch.column(0), np.uint8, (width,))
            label, file, weight = (batch.column(i).to_numpy() for i in (1, 2, 3))
            margins = model.add(_unpacked(batch.column(4), np.float64, shape).copy(), bins, 0, len(model.rounds))
            for r in runs:
                allowed = model.allowed(r)
                place = np.full(shape[1], -1)
                place[allowed] = np.arange(len(allowed))
                out = [i for i, f in enumerate(files) if f in model.runs[r].without_files]
                rows = np.flatnonzero((place[label] >= 0) & ~np.isin(file, out))
                if not len(rows):
                    continue
                g, h = gradients(margins[rows][:, r, allowed], place[label[rows]], weight[rows])
                own = bins[rows]
                columns = own.T.astype(np.int64)
                for j, k in enumerate(allowed.tolist()):
                    if (r, k) not in growing:
                        continue
                    node = growing[r, k].node(own, level) - (nodes - 1)
                    here = np.flatnonzero(node >= 0)
                    first_bin, v = node[here] * bins_most, (g[here, j], h[here, j])
                    for f in wanted[r]:
                        at = first_bin + columns[f][here]
                        for s, x in zip(sums[r, k], v, strict=True):
                            s[f] += np.bincount(at, x, nodes * bins_most)
        for (r, k), (g, h) in sums.items():
            feature, at = np.nonzero(h)
            g, h = g[feature, at], h[feature, at]
            cells = [np.full(len(at), r), np.full(len(at), k), at // bins_most, feature, at % bins_most]
            yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int32()) for c in cells], pa.array(g), pa.array(h)], [c.split()[0] for c in _SUMS.split(", ")])

    return run


def best_splits(sums: DataFrame, runs: Sequence[Run]) -> DataFrame:
    """(run, class, node, g, h, split): each node's sums and its split (gain, feature, bin, left_g, left_h), null where none gains enough.

    Of equal gains the first feature's first bin counts.
    """
    of = lambda name: F.element_at(F.array(*[F.lit(float(getattr(r, name))) for r in runs]), F.col("run") + 1)
    cells = sums.groupBy("run", "class", "node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
    whole = Window.partitionBy("run", "class", "node", "feature")
    upto = whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    cells = cells.select("run", "class", "node", "feature", "bin", F.sum("g").over(upto).alias("left_g"), F.sum("h").over(upto).alias("left_h"), F.sum("g").over(whole).alias("all_g"), F.sum("h").over(whole).alias("all_h"))
    score = lambda g, h: g * g / (h + of("ridge"))
    right_g, right_h = F.col("all_g") - F.col("left_g"), F.col("all_h") - F.col("left_h")
    gain = score(F.col("left_g"), F.col("left_h")) + score(right_g, right_h) - score(F.col("all_g"), F.col("all_h"))
    fits = (F.col("left_h") >= of("least_weight")) & (right_h >= of("least_weight")) & (gain > 1e-6) & (gain >= of("least_gain"))
    split = F.when(fits, F.struct(gain.alias("gain"), (-F.col("feature")).alias("feature"), (-F.col("bin")).alias("bin"), "left_g", "left_h"))
    best = cells.groupBy("run", "class", "node").agg(F.min_by("all_g", "feature").alias("g"), F.min_by("all_h", "feature").alias("h"), F.max(split).alias("split"))
    return best.select("run", "class", "node", "g", "h", "split")


def _grow(growing: dict[tuple[int, int], Tree], level: int, found: Iterable, runs: Sequence[Run]) -> None:
    """Enter the splits of a level, and leaf values of its nodes and their children."""
    for x in found:
        tree, run, at = growing[x["run"], x["class"]], runs[x["run"]], x["node"] + 2**level - 1
        value = lambda g, h, run=run: -run.rate * g / (h + run.ridge)
        split = x["split"]
        tree.value[at] = value(x["g"], x["h"])
        if split is not None:
            tree.feature[at], tree.last[at], tree.gain[at] = -split["feature"], -split["bin"], split["gain"]
            tree.value[2 * at + 1], tree.value[2 * at + 2] = value(split["left_g"], split["left_h"]), value(x["g"] - split["left_g"], x["h"] - split["left_h"])


def fit_boosted(
    table: DataFrame, features: Sequence[str], runs: Sequence[Run], label: str = "label", weight: str | None = None, file_col: str | None = None, bins: int = BINS, classes: Sequence[int] | None = None
) -> Boosted:
    """Models of all ``runs`` over the rows of ``table``.

    ``label`` is an integer class; rows with a null label or without a positive ``weight`` (1 where None) teach nothing. Missing values are the least ones. ``file_col`` is what
    ``without_files`` of a run names. Classes are those that occur, a few, or ``classes``; an empty table gives models without trees that name the first class. Extra columns are ignored.
    """
    if classes is None:
        classes = sorted(r[0] for r in table.select(F.col(f"`{label}`").cast("int")).where(F.col(label).isNotNull()).distinct().collect())
    files = sorted({f for r in runs for f in r.without_files})
    model = Boosted(tuple(features), bin_edges(table, features, bins), tuple(classes) or (0,), tuple(runs))
    rows = stage(_binned(table, model, label, weight, file_col, files), "binned")
    kept = 0
    for t in range(max(r.rounds for r in runs)):
        growing = {(r, k): Tree.empty(run.depth) for r, run in enumerate(runs) if t < run.rounds for k in model.allowed(r).tolist()}
        for level in range(max(runs[r].depth for r, _ in growing)):
            now = {key: tree for key, tree in growing.items() if level < runs[key[0]].depth}
            sums = rows.mapInArrow(_histograms(model, now, level, kept, files), _SUMS)
            found = best_splits(sums, runs).collect()
            _grow(growing, level, found, runs)
            if all(x["split"] is None for x in found):
                break
        model.rounds.append(growing)
        if len(model.rounds) - kept == KEPT_ROUNDS:
            before, rows = rows, stage(_with_margins(rows, model, kept), "margins")
            release(before)
            kept = len(model.rounds)
    release(rows)
    return model


def _with_margins(rows: DataFrame, model: Boosted, first: int) -> DataFrame:
    shape, model = (len(model.runs), len(model.classes)), model.since(first)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = _unpacked(batch.column(0), np.uint8, (len(model.features),))
            margins = model.add(_unpacked(batch.column(4), np.float64, shape).copy(), bins, 0, len(model.rounds))
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(4)], _packed(margins)], batch.schema.names)

    return rows.mapInArrow(run, _BINNED)


def predict_boosted(model: Boosted, table: DataFrame, run: int = 0, out: str = "predicted") -> DataFrame:
    """``table`` with the class that one run names."""
    kept = [c for c in table.columns if c.lower() != out.lower()]
    extra = fresh(table.columns, *[f"f{i}" for i in range(len(model.features))])
    shape = (len(model.runs), len(model.classes))

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            margins = model.add(np.zeros((batch.num_rows, *shape)), _columns(batch, len(kept), model.edges), 0, len(model.rounds))
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(kept))], pa.array(model.told(margins, run), pa.int32())], [*kept, out])

    made = [v.alias(n) for v, n in zip(_numeric(table, model.features), extra, strict=True)]
    return table.select(*[F.col(f"`{c}`") for c in kept], *made).mapInArrow(told, StructType([*[table.schema[c] for c in kept], StructField(out, IntegerType())]))


def run_counts(model: Boosted, table: DataFrame, label: str = "label", file_col: str | None = None, rounds: Sequence[int] = (), tested: Sequence[Sequence | None] | None = None) -> DataFrame:
    """(run, rounds, label, pred, n): how often each run names each class, from one pass over ``table``.

    With ``rounds`` each run is also asked as it was after so many of its rounds. ``tested`` has for each run the files that it is tested on, all where None. Rows of classes that a run has left out are not
    asked of it, nor rows without a known label.
    """
    files = sorted({f for fs in tested or () if fs is not None for f in fs})
    shape = (len(model.runs), len(model.classes))
    stops = [sorted({min(t, run.rounds) for t in rounds} | ({run.rounds} if not rounds else set())) for run in model.runs]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {(r, t): np.zeros((shape[1], shape[1]), np.int64) for r in range(shape[0]) for t in stops[r]}
        place = {c: i for i, c in enumerate(model.classes)}
        for batch in batches:
            label_at, file = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            bins, margins, done = _columns(batch, 2, model.edges), np.zeros((batch.num_rows, *shape)), 0
            for t in sorted({t for s in stops for t in s}):
                margins, done = model.add(margins, bins, done, min(t, len(model.rounds))), min(t, len(model.rounds))
                for r in range(shape[0]):
                    if t in stops[r]:
                        asked = np.isin(label_at, model.allowed(r))
                        if tested and tested[r] is not None:
                            asked &= np.isin(file, [files.index(f) for f in tested[r]])
                        pred = np.array([place[c] for c in model.told(margins[asked], r).tolist()], np.int64)
                        np.add.at(held[r, t], (label_at[asked], pred), 1)
        rows = [(r, t, model.classes[i], model.classes[j], int(n[i, j])) for (r, t), n in held.items() for i, j in zip(*np.nonzero(n), strict=True)]
        columns = list(zip(*rows, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int32()) for c in columns[:4]], pa.array(columns[4], pa.int64())], ["run", "rounds", "label", "pred", "n"])

    rows = table.select(_code(table, label, model.classes).alias("label"), (_code(table, file_col, files) if file_col else F.lit(-1)).alias("file"), *_numeric(table, model.features))
    counts = rows.where("label >= 0").mapInArrow(count, "run int, rounds int, label int, pred int, n long")
    return counts.groupBy("run", "rounds", "label", "pred").agg(F.sum("n").alias("n"))


def gain_importances(model: Boosted, run: int = 0) -> DataFrame:
    """(feature, importance, place): each feature's share of the mean gain of its splits, the largest first; 0 for one that splits nothing."""
    total, n = np.zeros(len(model.features)), np.zeros(len(model.features))
    for trees in model.rounds:
        for (r, _), tree in trees.items():
            if r == run:
                at = tree.feature >= 0
                np.add.at(total, tree.feature[at], tree.gain[at])
                np.add.at(n, tree.feature[at], 1)
    mean = np.divide(total, n, out=np.zeros_like(total), where=n > 0)
    share = mean / mean.sum() if mean.sum() else mean
    ranked = sorted(zip(model.features, share.tolist(), strict=True), key=lambda x: (-x[1], x[0]))
    return SparkSession.active().createDataFrame([(f, v, i) for i, (f, v) in enumerate(ranked, 1)], "feature string, importance double, place int")
