"""Ordered operators along a scan: scanlines, differences, gradients and segments.

Every window is keyed by scan and ends its order with ``point_counter``, so ties
cannot reorder rows. What runs over a whole scan (scanline and segment ids) goes by range
partitions, so a long scan is not one task; other windows hold one scanline.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rangeloom.operators.prefix import ranged, running_total, running_totals, with_neighbours
from rangeloom.operators.staging import stage


def adjust_angles(points: DataFrame) -> DataFrame:
    """Second half of each turn folded onto the first: theta mirrored, phi moved by half a turn."""
    t = F.lit(360.0) - F.col("vert_angle")
    return points.withColumns({"vert_angle": F.when(t > 180, F.lit(360.0) - t).otherwise(t), "horiz_angle": F.when(t > 180, F.col("horiz_angle") - 180).otherwise(F.col("horiz_angle"))})


def neighbour_difference(value: str, keys: list[str], order: list[str]) -> Column:
    """|next - this| along the order; the last row repeats the difference before it; null for a single row."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return F.coalesce(F.abs(F.lead(value).over(w) - F.col(value)), F.abs(F.col(value) - F.lag(value).over(w)))


def _breaks_before(points: DataFrame, flag: Column, order: list[str], out: str) -> DataFrame:
    """1 + number of flagged rows of the scan that come before each row."""
    marked = points.withColumn("_flag", F.coalesce(flag.cast("int"), F.lit(0)))
    total = running_total(marked, "_flag", [F.col(c) for c in order], "_upto", by=["scan_id"])
    return total.withColumn(out, (F.col("_upto") - F.col("_flag") + 1).cast("long")).drop("_flag", "_upto")


def scanline_ids(points: DataFrame, threshold: float = 80.0) -> DataFrame:
    """A jump of theta in phi order ends a scanline; the row of the jump still belongs to it."""
    order = ["horiz_angle", "point_counter"]
    met = with_neighbours(ranged(points, [F.col(c) for c in order], ["scan_id"]), "vert_angle", order, "_prior", "_next", ["scan_id"])
    jump = F.coalesce(F.abs(F.col("_next") - F.col("vert_angle")), F.abs(F.col("vert_angle") - F.col("_prior")))
    flagged = stage(met.withColumn("_flag", F.coalesce((jump > threshold).cast("int"), F.lit(0))).drop("_prior", "_next"), "flagged")
    total = running_total(flagged, "_flag", [F.col(c) for c in order], "_upto", by=["scan_id"], slot="_slot")
    return total.withColumn("scanline_id", (F.col("_upto") - F.col("_flag") + 1).cast("long")).drop("_flag", "_upto")


def rho_differences(points: DataFrame) -> DataFrame:
    """Range difference to the next point of the scanline; 0 for a scanline of one point."""
    diff = neighbour_difference("rho", ["scan_id", "scanline_id"], ["vert_angle", "point_counter"])
    return points.withColumn("rho_diff", F.coalesce(diff, F.lit(0.0)))


def gradient(points: DataFrame, value: str, out: str) -> DataFrame:
    """Half the difference of the neighbours along the scanline, 0 at both ends."""
    w = Window.partitionBy("scan_id", "scanline_id").orderBy("vert_angle", "point_counter")
    return points.withColumn(out, F.coalesce((F.lead(value).over(w) - F.lag(value).over(w)) / 2, F.lit(0.0)))


def segment_ids(points: DataFrame, flag: Column) -> DataFrame:
    """Breaks counted over the whole scan in scanline order, so a segment may go on into the next scanline."""
    return _breaks_before(points, flag, ["scanline_id", "vert_angle", "point_counter"], "segment_id")


def range_jump(std_multiplier: float) -> Column:
    """A range jump beyond what is expected there, null where nothing is."""
    return F.col("rho_diff") > F.col("expected_value") + F.col("expected_value_std") * std_multiplier


def break_flag(std_multiplier: float = 25.0, curvature_threshold: float = 30.0) -> Column:
    """A range jump beyond what is expected there, or a sharp bend."""
    return F.coalesce(range_jump(std_multiplier), F.lit(False)) | F.coalesce(F.abs("curvature_lstsq") > curvature_threshold, F.lit(False))


def running_point_ids(points: DataFrame, file_col: str, order: list[str]) -> DataFrame:
    """Ids from 0 over files in name order and rows in ``order``."""
    numbered = running_total(points.withColumn("_one", F.lit(1)), "_one", [F.col(c) for c in (file_col, *order)], "_n")
    return numbered.withColumn("point_id", (F.col("_n") - 1).cast("long")).drop("_one", "_n")


def every_nth(rows: DataFrame, n: int, order: list[str]) -> DataFrame:
    """The first of every ``n`` rows in ``order``."""
    numbered = running_total(rows.withColumn("_one", F.lit(1)), "_one", [F.col(c) for c in order], "_n")
    return numbered.where((F.col("_n") - 1) % n == 0).drop("_one", "_n")


#: The parameters of the segmentation sweep.
SWEEP_CURVATURE = (20.0, 30.0, 40.0, 50.0, 60.0, 70.0)
SWEEP_STD = (1.0, 15.0, 25.0, 35.0, 50.0, 65.0, 75.0, 85.0, 100.0)
SWEEP_NEIGHBOURHOOD = (1.0, 1.25, 1.5, 1.75, 2.0)


def segment_counts(bent: DataFrame, stds: Sequence[float] = SWEEP_STD, curvatures: Sequence[float] = SWEEP_CURVATURE, keys: Sequence[str] = ("scan_id",)) -> DataFrame:
    """(keys, std_multiplier, curvature_threshold, segments) of every pair of thresholds, from one pass over points with their curvature."""
    place = F.struct("scanline_id", "vert_angle", "point_counter")
    cells = []
    for s, c in product(stds, curvatures):
        flag = break_flag(s, c).cast("long")
        # The break of the last row begins no segment.
        cells.append(F.struct(F.lit(s).alias("std_multiplier"), F.lit(c).alias("curvature_threshold"), (1 + F.sum(flag) - F.max_by(flag, place)).alias("segments")))
    return bent.groupBy(*keys).agg(F.array(*cells).alias("_cells")).select(*keys, F.explode("_cells").alias("_c")).select(*keys, "_c.*")


def sweep_label_counts(bent: DataFrame, stds: Sequence[float] = SWEEP_STD, curvatures: Sequence[float] = SWEEP_CURVATURE, keys: Sequence[str] = ("scan_id",), label: str = "label") -> DataFrame:
    """(keys, std_multiplier, curvature_threshold, segment_id, label, c): points of each label in every segment of every pair of thresholds.

    The segment ids of all pairs are running totals of one range sort, a counter for each pair. Points become a row for each pair only
    to be counted, which tasks do before anything is shuffled.
    """
    runs = list(product(stds, curvatures))
    place = ["scanline_id", "vert_angle", "point_counter"]
    used = bent.select(*keys, *place, label, *[break_flag(s, c).cast("long").alias(f"flag{i}") for i, (s, c) in enumerate(runs)])
    total = running_totals(used, {f"upto{i}": f"flag{i}" for i in range(len(runs))}, [F.col(c) for c in place], by=keys)
    cells = [F.struct(F.lit(s).alias("std_multiplier"), F.lit(c).alias("curvature_threshold"), (F.col(f"upto{i}") - F.col(f"flag{i}") + 1).alias("segment_id")) for i, (s, c) in enumerate(runs)]
    each = total.select(*keys, label, F.explode(F.array(*cells)).alias("_run")).select(*keys, "_run.*", F.col(label).alias("label"))
    return each.groupBy(*keys, "std_multiplier", "curvature_threshold", "segment_id", "label").agg(F.count("*").alias("c"))
