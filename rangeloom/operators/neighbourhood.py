"""Scanline neighbourhoods of a width that each point sets itself.

Points are dealt out by scanline and sorted along it, so a point's neighbours are rows before and
after it: pairs are gathered by place from arrays that hold whole scanlines, a
bounded number of pairs at a time, and no pair is ever a row of Spark's. Several
widths are served by the same pass.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from rangeloom.operators.names import fresh

_PAIRS = 1 << 19
_SHAPES = ("slope", "slope_lstsq", "roughness")


def neighbour_counts(expected: Column, multiplier: float = 2.0) -> Column:
    """Half width of a neighbourhood: wider where points are expected close together; a missing expectation counts as the least width."""
    least = F.greatest(F.lit(3.0), F.ceil(F.sqrt(1 / F.nullif(expected, F.lit(0.0)))))
    return F.bround(F.coalesce(least, F.lit(3.0)) * multiplier).cast("int")


def _reflected(j: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Places mirrored at both ends of a line of n."""
    j = np.abs(j)
    return np.where(j >= n, 2 * (n - 1) - j, j)


def _shapes(at: dict[str, np.ndarray], start: np.ndarray, n: np.ndarray, k: np.ndarray) -> list[np.ndarray]:
    """slope, slope_lstsq and roughness of each row; ``start`` and ``n`` are the first row and the size of its line, k its half width below n."""
    out = [np.zeros(len(k)) for _ in _SHAPES]
    live = np.flatnonzero(k > 0)
    ends = np.cumsum(k[live])
    lo = 0
    while lo < len(live):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + _PAIRS, side="right")))
        rows = live[lo:hi]
        width = k[rows]
        first = np.cumsum(width) - width
        of = np.repeat(np.arange(len(rows)), width)
        i = (rows - start[rows])[of]
        t = np.arange(len(of)) - first[of]
        a, b = (start[rows][of] + _reflected(j, n[rows][of]) for j in (i - width[of] + t, i + 1 + t))
        d = {c: at[c][b] - at[c][a] for c in "xyz"}
        q = {c: at[c][rows][of] - at[c][a] for c in "xyz"}
        square = d["x"] * d["x"] + d["y"] * d["y"] + d["z"] * d["z"]
        along = q["x"] * d["x"] + q["y"] * d["y"] + q["z"] * d["z"]
        share = np.divide(along, square, out=np.full(len(of), np.nan), where=square != 0)
        off = np.nan_to_num(np.sqrt(sum((q[c] - share * d[c]) ** 2 for c in "xyz")))
        rise = np.degrees(np.arctan2(d["z"], np.sqrt(square)))
        order = np.lexsort((rise, of))  # NaN comes last
        known = np.bincount(of, ~np.isnan(rise), len(rows)).astype(np.int64)
        middle = [rise[order[first + np.maximum(m, 0)]] for m in ((known - 1) // 2, known // 2)]
        # Far along a scan the terms below cancel, and the last bit of a sum shows in the angle: pairs are added one after the other, the farthest end first, as SQL's joins do.
        by = np.argsort(of * (int(n[rows].max()) + 1) - (b - start[rows][of]), kind="stable")
        sums = lambda v: np.bincount(of, np.nan_to_num(v)[by], len(rows))
        phi, rho, turn = at["horiz_angle"], at["rho"], at["turn"]
        m = 2.0 * width
        sx, sy = sums(phi[a] + phi[b]), sums(rho[a] + rho[b])
        sxx, sxy = sums(turn[a] + turn[b]), sums(phi[a] * rho[a] + phi[b] * rho[b])
        spread, mean = m * sxx - sx * sx, sx / m
        flat = mean * sy / m / (np.float_power(mean, 2.0) + 1)
        beta = np.where(np.abs(spread) > 1e-9, (m * sxy - sx * sy) / np.where(np.abs(spread) > 1e-9, spread, 1.0), flat)
        for v, found in zip(out, (np.where(known > 0, (middle[0] + middle[1]) / 2, 0.0), np.degrees(np.arctan(beta)), sums(off) / width), strict=True):
            v[rows] = found
        lo = hi
    return out


def _gathered(widths: int, names: list[str]):
    """Whole lines of a partition sorted along them; the last columns are x, y, z, rho, horiz_angle, the widths, and a number that changes with the line."""

    def shaped(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = len(names) - 3 * widths
        value = lambda i: batch.column(own + i).to_numpy(zero_copy_only=False).astype(float)
        at = {c: value(i) for i, c in enumerate(("x", "y", "z", "rho", "horiz_angle"))}
        # The power of the C library, as SQL's: some squares differ from products by a last bit.
        at["turn"] = np.float_power(at["horiz_angle"], 2.0)
        line = batch.column(batch.num_columns - 1).to_numpy()
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(line)) + 1, [len(line)]))
        size = np.repeat(np.diff(cuts), np.diff(cuts))
        start = np.repeat(cuts[:-1], np.diff(cuts))
        found = [v for w in range(widths) for v in _shapes(at, start, size, np.minimum(np.nan_to_num(value(5 + w)).astype(np.int64), size - 1))]
        return pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(own)], *[pa.array(v) for v in found]], names)

    def joined(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0] if len(held) > 1 else held[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            line = batch.column(batch.num_columns - 1).to_numpy()
            turns = np.flatnonzero(np.diff(line))
            if held and held[-1].column(batch.num_columns - 1)[-1].as_py() != line[0]:
                yield shaped(joined(held))
                held = []
            if len(turns):
                last = int(turns[-1]) + 1
                yield shaped(joined([*held, batch.slice(0, last)]))
                held, batch = [], batch.slice(last)
            held.append(batch)
        if held:
            yield shaped(joined(held))

    return run


def with_scanline_features(points: DataFrame, widths: Mapping[str, Column]) -> DataFrame:
    """``points`` with slope, slope_lstsq and roughness for each width, their names ended by the width's.

    Pair t of a point at place i of its line joins the points at places i-k+t and i+1+t, t below k, on the line reflected at both ends. slope is the
    median angle of rise over distance of the pairs, slope_lstsq the angle of the regression of range on phi over the 2k points,
    roughness the mean distance from the point to the pairs' lines. k is at most one less than the line's points; a single point has zeros. With
    constant phi the regression is the least-norm one. Pairs with a missing coordinate count for the mean as 0 and not for the median.
    One scanline, which a scanner's sweep bounds, is held at a time; an empty table gives an empty result.
    """
    new = [f"{v}{name}" for name in widths for v in _SHAPES]
    kept = [c for c in points.columns if c.lower() not in {n.lower() for n in new}]
    extra = fresh(points.columns, "_x", "_y", "_z", "_rho", "_phi", *[f"_k{i}" for i in range(len(widths))], "_line")
    made = [*[F.col(c).cast("double") for c in ("x", "y", "z", "rho", "horiz_angle")], *[w.cast("double") for w in widths.values()], F.xxhash64("scan_id", "scanline_id")]
    wide = points.select(*[F.col(f"`{c}`") for c in kept], *[v.alias(n) for v, n in zip(made, extra, strict=True)])
    lines = wide.repartition("scan_id", "scanline_id").sortWithinPartitions("scan_id", "scanline_id", "vert_angle", "point_counter")
    schema = StructType([*[points.schema[c] for c in kept], *[StructField(n, DoubleType()) for n in new]])
    return lines.mapInArrow(_gathered(len(widths), [*kept, *new]), schema)


def scanline_features(points: DataFrame, width: Column) -> DataFrame:
    """(scan_id, point_counter, slope, slope_lstsq, roughness) of ``with_scanline_features`` for one width."""
    return with_scanline_features(points, {"": width}).select("scan_id", "point_counter", *_SHAPES)
