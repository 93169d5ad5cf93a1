"""Queries that write files in the layouts and read them back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rangeloom.operators import labels, metrics, segments
from rangeloom.operators.staging import scratch_path, stage
from rangeloom.plans.cloud import cloud, rounded, segmented
from rangeloom.sources import layouts


def _full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cloud with every column that a layout may ask for."""
    points = segmented(spark, sf_dir).withColumns({"intensity": F.col("red") / 255.0, "blue": F.lit(7), "predicted": F.col("pred")})
    known = set(points.columns)
    every = (*layouts.ALL22, *layouts.POINT26)
    return points.withColumns({c: F.lit(0.0) for c in dict.fromkeys(every) if c not in known})


def layout_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(layout, n, x, z, intensity, label): every layout written as text and read again, summed up."""
    points, out = stage(_full(spark, sf_dir), "full"), []
    for name in ("RAW11", "ALL12", "ALL22", "LABELED12", "SCANLINE15", "POINT26", "CLASSIFIED13", "CLASSIFIED5"):
        names, path = getattr(layouts, name), scratch_path(spark, name.lower())
        layouts.write_points(points, path, names, compression="gzip" if name == "POINT26" else "none")
        back = layouts.read_points(spark, path, names)
        total = lambda c, back=back: F.sum(c) if c in back.columns else F.lit(0)
        out.append(back.agg(F.lit(name).alias("layout"), F.count("*").alias("n"), F.sum("x").alias("x"), F.sum("z").alias("z"), total("intensity").cast("double").alias("intensity"), total("label").cast("long").alias("label")))
    return rounded(stage(reduce(DataFrame.unionByName, out), "layouts"), 3)


def segment_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segment statistics through a headerless file with its header beside it."""
    table = rounded(segments.segment_statistics(segmented(spark, sf_dir), ["z", "rho"]), 4)
    path, header = scratch_path(spark, "segments"), scratch_path(spark, "segments-header")
    layouts.write_points(table, path, table.columns)
    layouts.write_header(spark, table.columns, header)
    back = layouts.read_points(spark, path, layouts.read_header(spark, header)).drop("path")
    return back.select(*[F.col(c).cast("long").alias(c) if c in ("scan_id", "n") else F.col(c) for c in back.columns])


def parameter_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(params, n, gini): impurity tables of each scan in a folder of its own, the parameters of its run in a file of the same name."""
    shares = segments.label_shares(segmented(spark, sf_dir)).withColumn("scan", F.concat(F.lit("scan"), F.col("scan_id").cast("string")))
    tables, params = scratch_path(spark, "gini"), scratch_path(spark, "params")
    shares.select("scan", "n", "gini").write.partitionBy("scan").csv(tables, header=True)
    runs = spark.range(4).select(F.concat(F.lit("scan"), "id").alias("scan"), (25 + F.col("id")).alias("std_multiplier"), F.lit(30).cast("long").alias("curvature_threshold"), F.lit(2).cast("long").alias("neighborhood_multiplier"))
    names = ("std_multiplier", "curvature_threshold", "neighborhood_multiplier")
    layouts.write_report(runs.where("scan < 'scan2'"), params)
    layouts.write_report(runs.where("scan >= 'scan2'"), params, append=True)
    # Spark names its files itself, so the run's name stands for the file's.
    named = lambda df: df.withColumn("path", F.concat(F.lit("/gini/"), "scan", F.lit(".txt")))
    rows = named(spark.read.schema("n long, gini double, scan string").option("header", True).csv(tables))
    own = named(layouts.read_table(spark, params, "scan string, std_multiplier long, curvature_threshold long, neighborhood_multiplier long"))
    return rounded(layouts.with_parameters(rows, own, names).groupBy("params").agg(F.sum("n").alias("n"), F.avg("gini").alias("gini")))


def partner_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each labelled file with its segmentation file, by the first three parts of their names."""
    scans = cloud(spark, sf_dir).select("scan_id").distinct()
    name = lambda top, end: F.concat(F.lit(f"{top}/Site_A_"), F.col("scan_id").cast("string"), F.lit(end)).alias("path")
    segmentations = scans.where("scan_id <> 3").select(name("/seg", "_b.txt")).union(scans.select(name("/seg", "_c.txt")).where("path not like '%_3_%'"))
    return layouts.partners(scans.select(name("/lab", "_labelled.asc")), segmentations)


def confusion_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum of the confusion matrices that a folder holds, one file for each scan."""
    path = scratch_path(spark, "confusions")
    points = cloud(spark, sf_dir)
    layouts.write_confusion(metrics.confusion(points, by=["scan_id"]), path, by=["scan_id"])
    return rounded(metrics.summed(layouts.read_confusions(spark, path)))


def classified_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points with the prediction of their segment, through files of the classified layout."""
    points = _full(spark, sf_dir).drop("predicted")
    named = segments.label_shares(points).select("scan_id", "segment_id", F.col("mode_label").alias("predicted"))
    path = scratch_path(spark, "classified")
    layouts.write_points(labels.unfold(points, named), path, layouts.CLASSIFIED13)
    return rounded(layouts.read_points(spark, path, layouts.CLASSIFIED13).select("point_counter", "x", "label", "predicted"), 4)


def file_point_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of the lines of files without a counter, over the files in name order; a point is known again by its angle."""
    points = cloud(spark, sf_dir).withColumns({"intensity": F.lit(0.5), "blue": F.lit(7)})
    path = scratch_path(spark, "raw10")
    layouts.write_points(points.repartitionByRange("scan_id", "point_counter").sortWithinPartitions("scan_id", "point_counter"), path, layouts.RAW10)
    return layouts.numbered_points(spark, path, layouts.RAW10).select(F.round(F.col("horiz_angle") * 50).cast("long").alias("point_counter"), "point_id")


QUERIES = {f.__name__: f for f in (layout_scans, segment_file, parameter_join, partner_files, confusion_files, classified_points, file_point_ids)}
