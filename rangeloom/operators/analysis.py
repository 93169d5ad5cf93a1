"""Tables about runs and groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rangeloom.operators.quantiles import quantiles, with_quantiles


def describe(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, n, mean, std, low, high, q25, q50, q75): count, mean, sample std, least, largest and quartiles of each group, which may be large."""
    table = rows.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("low"), F.max(value).alias("high"))
    found = quantiles(rows, keys, [value], {f"q{p}": p / 100 for p in (25, 50, 75)})
    return with_quantiles(table, found.select(*keys, *[F.col(f"{value}_q{p}").alias(f"q{p}") for p in (25, 50, 75)]), keys)


def pivot_with_margins(rows: DataFrame, row: str, column: str, value: str, columns: Sequence[str]) -> DataFrame:
    """Mean of ``value`` by row and column, the sum of each row, and a last row ``total`` of sums."""
    table = rows.groupBy(F.col(row).cast("string").alias("name")).pivot(column, list(columns)).agg(F.avg(value))
    table = table.withColumn("row_sum", sum(F.coalesce(F.col(c), F.lit(0.0)) for c in columns))
    return table.unionByName(table.agg(F.lit("total").alias("name"), *[F.sum(c).alias(c) for c in (*columns, "row_sum")]))


def importance(runs: DataFrame, group: Sequence[str], dropped: str, metric: str, baseline: str = "none") -> DataFrame:
    """(dropped, n, importance): metric of a group's baseline run less that of the run, averaged by what was dropped."""
    base = F.max(F.when(F.col(dropped) == baseline, F.col(metric))).over(Window.partitionBy(*group))
    return runs.withColumn("_base", base).where(F.col(dropped) != baseline).groupBy(dropped).agg(F.count("*").alias("n"), F.avg(F.col("_base") - F.col(metric)).alias("importance"))


def linear_fit(rows: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Slope, intercept, R² and correlation of y on x for each group."""
    return rows.groupBy(*keys).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), F.corr(y, x).alias("corr"))


def impurity_report(segments: DataFrame, keys: Sequence[str] = ("scan_id",)) -> DataFrame:
    """One row per key about its segments (n, gini): counts, small segments and spread of impurity, which has four places and so 10,001 values at most."""
    g = "gini"
    share = lambda most: F.round(100 * F.count_if(F.col("n") < most) / F.count("*"), 4)
    return segments.groupBy(*keys).agg(
        F.count("*").alias("segments"), F.count_if(F.col("n") < 5).alias("below_5"), F.count_if(F.col("n") < 10).alias("below_10"), share(5).alias("below_5_pct"), share(10).alias("below_10_pct"),
        (F.sum(F.round(F.col(g) * 10_000).cast("long")) / F.count("*") / 10_000).alias("mean"), F.stddev_samp(g).alias("std"), F.var_samp(g).alias("var"), (F.max(g) - F.min(g)).alias("ptp"), F.percentile(g, 0.02).alias("p2"), F.percentile(g, 0.98).alias("p98"),
    )


def impurity_report_of(kinds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``impurity_report`` of counted segments (keys, n, gini, c): c segments each of n points and that impurity, which has four places."""
    places = F.round(F.col("gini") * 10_000).cast("long")
    values = kinds.groupBy(*keys, "gini").agg(F.sum("c").alias("c"), *[F.sum(F.when(F.col("n") < most, F.col("c")).otherwise(0)).alias(f"_below{most}") for most in (5, 10)])
    whole = lambda v: v.cast("decimal(38,0)")
    held = values.groupBy(*keys).agg(
        F.sum("c").alias("segments"), F.sum("_below5").alias("below_5"), F.sum("_below10").alias("below_10"), F.sum(places * F.col("c")).alias("_one"), whole(F.sum(whole(places * places * F.col("c")))).alias("_two"),
        (F.max("gini") - F.min("gini")).alias("ptp"), F.percentile("gini", 0.02, F.col("c")).alias("p2"), F.percentile("gini", 0.98, F.col("c")).alias("p98"),
    )
    n, share = F.col("segments"), lambda c: F.round(100 * F.col(c) / F.col("segments"), 4)
    # Sums of whole numbers, so nothing is lost where all values are near each other.
    off = (whole(n) * F.col("_two") - whole(F.col("_one")) * whole(F.col("_one"))).cast("double")
    var = F.when(n > 1, off / n / (n - 1) / 1e8)
    return held.select(*keys, "segments", "below_5", "below_10", share("below_5").alias("below_5_pct"), share("below_10").alias("below_10_pct"), (F.col("_one") / n / 10_000).alias("mean"), F.sqrt(var).alias("std"), var.alias("var"), "ptp", "p2", "p98")


def closest_by_scaled_difference(runs: DataFrame, a: str, b: str, most: int, tie: str) -> DataFrame:
    """The ``most`` runs where two columns, each scaled to 0..1, differ least."""
    ends = runs.agg(*[f(c).alias(f"{n}_{c}") for c in (a, b) for f, n in ((F.min, "lo"), (F.max, "hi"))])
    scaled = {c: (F.col(c) - F.col(f"lo_{c}")) / F.nullif(F.col(f"hi_{c}") - F.col(f"lo_{c}"), F.lit(0)) for c in (a, b)}
    return runs.crossJoin(F.broadcast(ends)).withColumn("gap", F.abs(scaled[a] - scaled[b])).orderBy("gap", tie).limit(most).select(*runs.columns, "gap")


def correlations(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(a, b, corr) of every pair of columns, each with itself too, in one pass."""
    pairs = [(a, b) for a in columns for b in columns]
    cells = rows.agg(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(a, b).alias("corr")) for a, b in pairs]).alias("cells"))
    return cells.select(F.explode("cells").alias("c")).select("c.a", "c.b", "c.corr")


def ranking(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, mean, place): groups by falling mean, place 1 first, equal means by key."""
    means = rows.groupBy(key).agg(F.avg(value).alias("mean"))
    return means.withColumn("place", F.row_number().over(Window.orderBy(F.col("mean").desc_nulls_last(), key)).cast("long"))
