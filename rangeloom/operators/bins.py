"""Range profiles: what distance between points to expect at each range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rangeloom.operators.staging import stage


def range_bin(rho: str | Column, size: float) -> Column:
    """Bins from 1 on, each closed below."""
    rho = F.col(rho) if isinstance(rho, str) else rho
    return (F.floor(rho / size) + 1).cast("long")


def range_profile(points: DataFrame, value: str, size: float = 0.5, aligned: bool = False) -> DataFrame:
    """(scan_id, bin, profile_max, profile_std) that a point of each bin reads.

    Bins hold the largest value and the population deviation; zeros and empty bins are holes, filled
    by linear interpolation and flat beyond the first and last known bin. A point reads the
    bin to the left of its own unless ``aligned``. The farthest bin is not filled by points.
    """
    top = points.groupBy(F.col("scan_id").alias("_scan")).agg(F.greatest(F.ceil(F.max("rho") / size), F.lit(1)).cast("long").alias("top"))
    # Spark's deviation of equal values in several tasks may be 1e-14, which would be no hole.
    spread = F.when(F.min(value) == F.max(value), F.lit(0.0)).otherwise(F.stddev_pop(value))
    stats = points.groupBy(F.col("scan_id").alias("_s"), range_bin("rho", size).alias("_b")).agg(F.max(value).alias("_max"), spread.alias("_std"))
    grid = top.select(F.col("_scan").alias("scan_id"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("top") - 1)).alias("b"))
    met = grid.join(stats, (F.col("scan_id") == F.col("_s")) & (F.col("b") == F.col("_b")) & (F.col("b") > 0), "left")
    before = Window.partitionBy("scan_id").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy("scan_id").orderBy("b").rowsBetween(0, Window.unboundedFollowing)
    out = []
    for c in ("max", "std"):
        v = F.nullif(f"_{c}", F.lit(0.0))
        at = F.when(v.isNotNull(), F.col("b"))
        lo, lo_at, hi, hi_at = F.last(v, True).over(before), F.last(at, True).over(before), F.first(v, True).over(after), F.first(at, True).over(after)
        between = lo + (hi - lo) * (F.col("b") - lo_at) / F.greatest(hi_at - lo_at, F.lit(1))
        out.append(F.when(v.isNotNull(), v).when(lo.isNull(), hi).when(hi.isNull(), lo).otherwise(between).alias(f"profile_{c}"))
    return met.select("scan_id", (F.col("b") + (0 if aligned else 1)).alias("bin"), *out)


def expected_values(points: DataFrame, value: str, size: float = 0.5) -> DataFrame:
    """``points`` with (expected_value, expected_value_std) of their range; null where the profile has none."""
    profile = stage(range_profile(points, value, size), "profile").select(F.col("scan_id").alias("_scan"), F.col("bin").alias("_bin"), F.col("profile_max").alias("expected_value"), F.col("profile_std").alias("expected_value_std"))
    return points.join(profile, (F.col("scan_id") == F.col("_scan")) & (range_bin("rho", size) == F.col("_bin")), "left").drop("_scan", "_bin")
