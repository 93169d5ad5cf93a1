"""The driver's tables read as a labelled point cloud, and its first stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rangeloom.operators import ordered

BREAK = 40.0


def cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table read as a labelled point cloud of four scans."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    mod = lambda by, m, d: ((F.col("event_id") * by) % m).cast("double") / d
    return e.select(
        F.col("event_id").alias("point_counter"), (F.col("user_id") % 4).alias("scan_id"), (F.col("user_id") % 6).cast("int").alias("label"),
        F.when(F.col("event_id") % 7 == 0, (F.col("user_id") + 1) % 6).otherwise(F.col("user_id") % 6).cast("int").alias("pred"),
        mod(7919, 2001, 100.0).alias("x"), mod(104729, 2003, 100.0).alias("y"), mod(1299709, 997, 100.0).alias("z"),
        (F.col("event_id").cast("double") / 50.0).alias("horiz_angle"), mod(29, 1800, 10.0).alias("vert_angle"), F.col("value").alias("rho"),
        ((F.col("event_id") * 31) % 256).cast("int").alias("red"), ((F.col("event_id") * 37) % 256).cast("int").alias("green"),
    )


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles to ``places``, integers to long, for comparison across engines."""
    plain = {"double": lambda c: F.round(c, places) + F.lit(0.0), "int": lambda c: F.col(c).cast("long")}
    return df.select(*[plain[k](c).alias(c) if k in plain else F.col(c) for c, k in df.dtypes])


def scanlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.rho_differences(ordered.scanline_ids(cloud(spark, sf_dir)))


def segmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.segment_ids(scanlines(spark, sf_dir), F.col("rho_diff") > BREAK)
