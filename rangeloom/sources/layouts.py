"""Point-cloud and report files: layouts, readers and writers."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from rangeloom.operators.names import fresh
from rangeloom.operators.staging import stage

_KINDS = {**dict.fromkeys(("red", "green", "blue", "label", "predicted"), IntegerType()), **dict.fromkeys(("point_counter", "scanline_id", "segment_id"), LongType())}
# Columns of the layouts and print formats.
RAW10 = ("x", "y", "z", "intensity", "red", "green", "blue", "rho", "horiz_angle", "vert_angle")
RAW11 = (*RAW10, "point_counter")
ALL12 = ("x", "y", "z", "red", "green", "blue", "intensity", "rho", "horiz_angle", "vert_angle", "point_counter", "label")
ALL22 = ("x", "y", "z", "red", "green", "blue", "intensity", *(f"blank{i}" for i in range(1, 15)), "label")
LABELED12 = (*RAW11, "label")
SCANLINE15 = (*LABELED12, "expected_value", "expected_value_std", "scanline_id")
POINT26 = (*SCANLINE15, "rho_diff", "slope", "curvature", "roughness", "segment_id", "nx_xyz", "ny_xyz", "nz_xyz", "nx", "ny", "nz")
CLASSIFIED13 = (*LABELED12, "predicted")
CLASSIFIED5 = ("x", "y", "z", "label", "predicted")
DECIMALS = {"intensity": 6, "horiz_angle": 6, "vert_angle": 6, "roughness": 8}
LABEL_NAMES = {0: "unclassified", 1: "man-made objects", 2: "ground", 3: "tree trunk/branches", 4: "leaves", 5: "low vegetation"}


def layout_schema(columns: Sequence[str]) -> StructType:
    """Ids, labels and colours as integers, everything else double."""
    return StructType([StructField(c, _KINDS.get(c, DoubleType())) for c in columns])


def read_points(spark: SparkSession, path: str, columns: Sequence[str], sep: str = " ", more: Mapping[str, Column] | None = None) -> DataFrame:
    """Headerless text in a layout, file or folder, with the path of each row's file and ``more`` columns that are known in the scan; NaN becomes null and blanks are left out."""
    raw = spark.read.schema(layout_schema(columns)).option("sep", sep).option("nanValue", "nan").csv(path)
    kept = [F.nanvl(c, F.lit(None).cast("double")).alias(c) if raw.schema[c].dataType == DoubleType() else F.col(c) for c in columns if not c.startswith("blank")]
    return raw.select(*kept, F.col("_metadata.file_path").alias("path"), *[v.alias(c) for c, v in (more or {}).items()])


def numbered_points(spark: SparkSession, path: str, columns: Sequence[str], sep: str = " ", out: str = "point_id") -> DataFrame:
    """``read_points`` with the number of each row from 0 over all files in the order of their paths and lines, for files that hold no counter.

    Files may be cut into any number of splits. A split's rows come in order, so a row's number is its place in the split and the rows of the splits
    before, of which there is one row each; no row of points is shuffled or sorted. Blank lines have no number.
    """
    block, at, first, base = fresh(columns, "_block", "_at", "_first", "_base")
    raw = read_points(spark, path, columns, sep, {block: F.col("_metadata.file_block_start"), at: F.monotonically_increasing_id()})
    # Written once: numbers within a split must be those of the scan that counted it.
    rows = stage(raw, "numbered")
    splits = rows.groupBy("path", block).agg(F.count("*").alias("n"), F.min(at).alias(first))
    before = Window.orderBy("path", block).rowsBetween(Window.unboundedPreceding, -1)
    names = fresh([*rows.columns, first, base], "_path", "_split")
    splits = stage(splits.select(F.col("path").alias(names[0]), F.col(block).alias(names[1]), first, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(base)), "splits")
    met = rows.join(splits, (F.col("path") == F.col(names[0])) & (F.col(block) == F.col(names[1])))
    return met.select(*[F.col(c) for c in rows.columns if c not in (block, at, out)], (F.col(base) + F.col(at) - F.col(first)).alias(out))


def read_table(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Comma-separated text with a header."""
    return spark.read.schema(schema).option("header", True).csv(path)


def write_points(points: DataFrame, path: str, columns: Sequence[str], compression: str = "none") -> None:
    """Text in a layout, every column in its print format."""
    shown = [F.format_string(f"%.{DECIMALS.get(c, 4)}f", c) if points.schema[c].dataType == DoubleType() else F.col(c).cast("string") for c in columns]
    points.select(F.concat_ws(" ", *shown).alias("value")).write.option("compression", compression).text(path)


def write_report(report: DataFrame, path: str, append: bool = False) -> None:
    """Comma-separated report with a header in each file; ``append`` adds files to a folder of reports."""
    report.write.mode("append" if append else "errorifexists").option("header", True).csv(path)


def write_header(spark: SparkSession, columns: Sequence[str], path: str) -> None:
    """Column names of a headerless file, one JSON string a line in order, in a folder beside it."""
    spark.createDataFrame([(json.dumps(c),) for c in columns], "value string").coalesce(1).write.text(path)


def read_header(spark: SparkSession, path: str) -> list[str]:
    """Column names that ``write_header`` has left; a header is a few hundred names."""
    return [json.loads(r.value) for r in spark.read.text(path).collect()]


def stem(path: Column) -> Column:
    """File name without folder and ending."""
    return F.regexp_extract(path, r"([^/]*?)(?:\.[^./]*)?$", 1)


def name_prefix(path: Column, tokens: int = 3) -> Column:
    """The first tokens of a file's name between underscores."""
    return F.array_join(F.slice(F.split(stem(path), "_"), 1, tokens), "_")


def partners(files: DataFrame, others: DataFrame, tokens: int = 3) -> DataFrame:
    """(path, partner): for each file the first of ``others``, by path, whose name begins with the same tokens; null without one."""
    first = others.groupBy(name_prefix(F.col("path"), tokens).alias("_prefix")).agg(F.min("path").alias("partner"))
    return files.join(first, name_prefix(F.col("path"), tokens) == F.col("_prefix"), "left").select("path", "partner")


def with_parameters(rows: DataFrame, parameters: DataFrame, names: Sequence[str]) -> DataFrame:
    """``rows``, which have a path, with the parameters of the file of the same name (the least row where it has several), and ``params``, which names them all."""
    own = parameters.groupBy(stem(F.col("path")).alias("_stem")).agg(F.min(F.struct(*names)).alias("_own"))
    met = rows.join(own, stem(F.col("path")) == F.col("_stem"), "left")
    parts = [x for n in names for x in (F.lit(("_" if n != names[0] else "") + "".join(w[0] for w in n.split("_")).upper()), F.col(f"_own.{n}").cast("string"))]
    return met.select(*rows.columns, *[F.col(f"_own.{n}").alias(n) for n in names], F.concat(*parts).alias("params"))


def write_confusion(confusion: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    """Confusion counts (truth, pred, n) as comma-separated lines, truths down and predictions across in order, a folder of files for each key."""
    lines = confusion.groupBy(*by, "truth").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pred", "n"))), lambda c: c["n"].cast("string")), ",").alias("line"))
    files = lines.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("truth", "line"))), lambda r: r["line"]), "\n").alias("value"))
    files.write.partitionBy(*by).text(path) if by else files.write.text(path)


def read_confusions(spark: SparkSession, path: str) -> DataFrame:
    """(path, truth, pred, n) of every file below a folder, classes numbered from 0."""
    files = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    rows = files.select("path", F.posexplode(F.split(F.trim(F.regexp_replace("value", r"\n+$", "")), "\n")).alias("truth", "line"))
    return rows.select("path", "truth", F.posexplode(F.split("line", ",")).alias("pred", "n")).withColumn("n", F.col("n").cast("long"))
