"""Statistics of groups of points."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rangeloom.operators.columns import side_by_side
from rangeloom.operators.names import fresh
from rangeloom.operators.staging import stage

STATISTICS = ("std", "perc2nd", "perc98th", "perc25th", "perc75th", "skewness")
_SHARES = {"perc2nd": 0.02, "perc98th": 0.98, "perc25th": 0.25, "perc75th": 0.75, "median": 0.5}


def _known(value: str) -> Column:
    """A column as double, null where it is NaN."""
    return F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double"))


def statistic(value: str, name: str) -> Column:
    """Population statistic of a column, without nulls and NaN; skewness is 0 for a constant."""
    v = _known(value)
    if name in _SHARES:
        return F.percentile(v, _SHARES[name])
    if name == "skewness":
        return F.coalesce(F.skewness(v), F.lit(0.0))
    return {"mean": F.avg, "var": F.var_pop, "std": F.stddev_pop}[name](v)


def _between_ranks(values: Column, share: float) -> Column:
    """``F.percentile`` of an array of sorted values, null for an empty one."""
    at = (F.size(values) - 1) * F.lit(share)
    low, high = F.floor(at).cast("int"), F.ceil(at).cast("int")
    below, above = F.get(values, low), F.get(values, high)
    return F.when(below == above, below).otherwise((high - at) * below + (at - low) * above)


def segment_statistics(points: DataFrame, attributes: Sequence[str], statistics: Sequence[str] = STATISTICS, keys: Sequence[str] = ("scan_id", "segment_id")) -> DataFrame:
    """One row per segment: keys, n, and ``attribute_statistic`` columns; a repeated attribute counts once.

    A segment's values of an attribute are gathered and sorted once for all its percentiles.
    """
    named = {f"{a}_{s}": (a, s) for a in dict.fromkeys(attributes) for s in statistics}
    ranked = list(dict.fromkeys(a for a, s in named.values() if s in _SHARES))
    lists = dict(zip(ranked, fresh([*keys, "n", *named], *[f"_values{i}" for i in range(len(ranked))]), strict=True))
    plain = [statistic(a, s).alias(c) for c, (a, s) in named.items() if s not in _SHARES]
    held = points.groupBy(*keys).agg(F.count("*").alias("n"), *plain, *[F.sort_array(F.collect_list(_known(a))).alias(c) for a, c in lists.items()])
    return held.select(*keys, "n", *[_between_ranks(F.col(lists[a]), _SHARES[s]).alias(c) if s in _SHARES else F.col(c) for c, (a, s) in named.items()])


def label_shares(points: DataFrame, label: str = "label", keys: Sequence[str] = ("scan_id", "segment_id")) -> DataFrame:
    """(keys, n, mode_label, gini): most frequent label, the smaller of equals, and impurity to 4 places."""
    return shares_of_counts(points.groupBy(*keys, F.col(label).alias("label")).agg(F.count("*").alias("c")), keys)


def shares_of_counts(counts: DataFrame, keys: Sequence[str] = ("scan_id", "segment_id")) -> DataFrame:
    """``label_shares`` from counts (keys, label, c)."""
    n, label = F.sum("c"), "label"
    return counts.groupBy(*keys).agg(
        n.alias("n"), F.min_by(label, F.struct(-F.col("c"), F.col(label))).alias("mode_label"), F.round(1 - F.sum(F.col("c") * F.col("c")) / (n * n), 4).alias("gini")
    )


def representatives(points: DataFrame, keys: Sequence[str] = ("scan_id", "segment_id")) -> DataFrame:
    """Each segment's own point nearest to its component-wise median, 2nd and 98th percentile: {x,y,z}_{target}_nn."""
    targets = {"median": 0.5, "perc2nd": 0.02, "perc98th": 0.98}
    aim = points.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(*[F.percentile(c, p).alias(f"_{c}_{t}") for t, p in targets.items() for c in "xyz"])
    same = [F.col(k) == F.col(f"_{k}") for k in keys]
    met = points.join(aim, same[0] if len(same) == 1 else same[0] & same[1])
    best = []
    for t in targets:
        square = sum((F.col(c) - F.col(f"_{c}_{t}")) * (F.col(c) - F.col(f"_{c}_{t}")) for c in "xyz")
        best.append(F.min_by(F.struct("x", "y", "z"), F.struct(square, F.col("point_counter"))).alias(t))
    return met.groupBy(*keys).agg(*best).select(*keys, *[F.col(f"{t}.{c}").alias(f"{c}_{t}_nn") for t in targets for c in "xyz"])


def segment_table(points: DataFrame, attributes: Sequence[str], statistics: Sequence[str] = STATISTICS) -> DataFrame:
    """One wide row per segment: nearest points, statistics, mode label, impurity and count; z counts from the lowest point of the scan, save in coordinates."""
    low = stage(points.groupBy(F.col("scan_id").alias("_scan")).agg(F.min("z").alias("_low")), "lowest")
    raised = points.join(low, F.col("scan_id") == F.col("_scan")).withColumn("z", F.col("z") - F.col("_low")).drop("_scan", "_low")
    keys = ("scan_id", "segment_id")
    table = side_by_side(representatives(points), segment_statistics(raised, attributes, statistics).drop("n"), keys)
    return side_by_side(table, label_shares(points), keys)
