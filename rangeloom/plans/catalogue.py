"""Query catalogue over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rangeloom.operators import analysis, bins, columns, labels, metrics, neighbourhood, ordered, segments, spatial, sweeps, vicinity
from rangeloom.operators.staging import shuffled, stage
from rangeloom.plans import files, oracles, training
from rangeloom.plans.cloud import cloud, rounded as _rounded, scanlines, segmented
from rangeloom.sources.layouts import LABEL_NAMES

RADIUS = 1.0
KNN = 16


def angle_adjust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ordered.adjust_angles(cloud(spark, sf_dir).withColumn("vert_angle", F.col("vert_angle") * 2)).select("point_counter", "vert_angle", "horiz_angle"))


def scanline_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanlines(spark, sf_dir).groupBy("scan_id", "scanline_id").agg(F.count("*").alias("n"), F.min("point_counter").alias("first_point"))


def rho_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(scanlines(spark, sf_dir).select("point_counter", "scanline_id", "rho_diff"))


def gradient_curvature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ordered.gradient(scanlines(spark, sf_dir), "rho", "curvature").select("point_counter", "curvature"))


def segment_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(segments.segment_statistics(segmented(spark, sf_dir), ["z", "rho"]))


def segment_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(segments.label_shares(segmented(spark, sf_dir)))


def segment_representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(segments.representatives(segmented(spark, sf_dir)))


def range_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(bins.range_profile(scanlines(spark, sf_dir), "rho_diff", 5.0))


def expected_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(bins.expected_values(scanlines(spark, sf_dir), "rho_diff", 5.0).select("point_counter", "expected_value", "expected_value_std"))


def scanline_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(neighbourhood.scanline_features(scanlines(spark, sf_dir), F.lit(3)), 4)


def break_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scanline flow with variable neighbourhoods and two-fold break test; expected distances are those of ``rho_diff``, not the reference's."""
    return _broken(bins.expected_values(scanlines(spark, sf_dir), "rho_diff", 5.0))


def knn_break_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole scanline flow, its expected distances those of each point's mean distance to its nearest neighbours, as in the reference."""
    return _broken(bins.expected_values(with_mean_distance(scanlines(spark, sf_dir)), "mean_dist"))


def with_mean_distance(points: DataFrame) -> DataFrame:
    """``points`` with the mean distance to the nearest ``KNN`` points of their scan, less the point itself."""
    near = spatial.nearest_described(points, points, KNN).select(F.col("scan_id").alias("_s"), F.col("src").alias("_p"), "mean_dist")
    return points.join(shuffled(near), (F.col("scan_id") == F.col("_s")) & (F.col("point_counter") == F.col("_p")), "left").drop("_s", "_p")


def _bent(points: DataFrame, multiplier: float = 2.0) -> DataFrame:
    """``points`` with slopes, roughness and both curvatures from neighbourhoods as wide as their expected distance asks for."""
    met = neighbourhood.with_scanline_features(points, {"": neighbourhood.neighbour_counts(F.col("expected_value") / 1000.0, multiplier)})
    return ordered.gradient(ordered.gradient(met, "slope_lstsq", "curvature_lstsq"), "slope", "curvature")


def _bends(points: DataFrame, multipliers: Sequence[float]) -> tuple[DataFrame, dict[float, str]]:
    """``points`` with curvature_lstsq for each multiplier, and the columns' names."""
    widths = {str(i): neighbourhood.neighbour_counts(F.col("expected_value") / 1000.0, m) for i, m in enumerate(multipliers)}
    met = neighbourhood.with_scanline_features(points, widths)
    for i in widths:
        met = ordered.gradient(met, f"slope_lstsq{i}", f"bend{i}")
    return met, {m: f"bend{i}" for i, m in enumerate(multipliers)}


def _bent_at(points: DataFrame, multipliers: Sequence[float]) -> DataFrame:
    """``points`` once for each multiplier, with curvature_lstsq; one gathering of neighbours serves all."""
    met, bends = _bends(points, multipliers)
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("neighborhood_multiplier"), F.col(c).alias("curvature_lstsq")) for m, c in bends.items()]))
    return met.select(*points.columns, each.alias("_each")).select(*points.columns, "_each.*")


def _broken(points: DataFrame) -> DataFrame:
    out = ordered.segment_ids(_bent(points), ordered.break_flag(1.0, 30.0))
    return _rounded(out.select("point_counter", "segment_id", "slope", "curvature", "roughness"), 4)


def segmentation_sweep(spark: SparkSession, sf_dir: str, multipliers: Sequence[float] = ordered.SWEEP_NEIGHBOURHOOD) -> DataFrame:
    """Number of segments of each scan for every combination of the three parameters; only the neighbourhoods are computed once a multiplier."""
    points = bins.expected_values(scanlines(spark, sf_dir), "rho_diff", 5.0)
    return _rounded(ordered.segment_counts(_bent_at(points, multipliers), keys=("scan_id", "neighborhood_multiplier")))


def impurity_sweep(spark: SparkSession, sf_dir: str, multipliers: Sequence[float] = ordered.SWEEP_NEIGHBOURHOOD) -> DataFrame:
    """The whole sweep over the mean distances to the nearest points: for each scan and combination of the three parameters the number of segments, of small ones, and the spread of their impurity."""
    points = bins.expected_values(stage(with_mean_distance(stage(scanlines(spark, sf_dir), "scanlines")), "mean-distances"), "mean_dist")
    bent, names = _bends(points, multipliers)
    bends = {m: [F.abs(c) > t for t in ordered.SWEEP_CURVATURE] for m, c in names.items()}
    kinds, runs = sweeps.segment_kinds(bent, [ordered.range_jump(s) for s in ordered.SWEEP_STD], bends, ["scanline_id", "vert_angle", "point_counter"])
    keys = ("scan_id", "neighborhood_multiplier", "std_multiplier", "curvature_threshold")
    of = F.element_at(F.array(*[F.struct(F.lit(m).alias("m"), F.lit(ordered.SWEEP_STD[s]).alias("s"), F.lit(ordered.SWEEP_CURVATURE[c]).alias("c")) for s, m, c in runs]), F.col("run") + 1)
    gini = F.round(1 - F.col("squares") / (F.col("n") * F.col("n")), 4)
    named = kinds.withColumn("_of", of).select("scan_id", *[F.col(f"_of.{x}").alias(k) for x, k in zip("msc", keys[1:], strict=True)], "n", gini.alias("gini"), F.col("c"))
    return _rounded(analysis.impurity_report_of(named, keys))


def radius_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = cloud(spark, sf_dir)
    return _rounded(vicinity.around(points, points, RADIUS).groupBy("src").agg(F.sum("n").alias("n"), (F.sum("total") / F.sum("n")).alias("mean_dist")))


def radius_counts_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours nearer than the radius; coordinates are on a grid, so some lie just at it."""
    points = cloud(spark, sf_dir)
    return vicinity.around(points, points, 0.5, strict=True).groupBy("src").agg(F.sum("n").alias("n"))


def knn_mean_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = cloud(spark, sf_dir)
    near = spatial.nearest(points, points, KNN).where("rank > 0")
    return _rounded(near.groupBy("src").agg(F.avg("dist").alias("mean_dist"), F.max("dist").alias("kth_dist")))


def voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(spatial.voxel_means(cloud(spark, sf_dir), 2.0))


def voxel_pyramid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of voxels of four sizes; the cloud is ten times as wide spaced as a scan, and so are the sizes."""
    return _rounded(spatial.voxel_pyramid(cloud(spark, sf_dir), [10 * e for e in spatial.VOXEL_SIZES]))


def voxel_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(edge, scan_id, voxels, points, snapped, ids): occupied voxels of each of four sizes and the points that stand for them, their different ids counted and all summed."""
    snapped = spatial.snapped_voxels(cloud(spark, sf_dir), [10 * e for e in spatial.VOXEL_SIZES])
    return snapped.groupBy("edge", "scan_id").agg(F.count("*").alias("voxels"), F.sum("n").alias("points"), F.count_distinct("point_counter").alias("snapped"), F.sum("point_counter").alias("ids"))


def voxel_snap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.snap_to_points(cloud(spark, sf_dir), 2.0)


def neighbour_covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = cloud(spark, sf_dir)
    return _rounded(vicinity.around(points, points, RADIUS, moments=True).drop("scan_id", "total"), 9)


def neighbour_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    points, names = cloud(spark, sf_dir), ("z", "red", "green", "vert_angle", "rho")
    return _rounded(vicinity.around(points, points, RADIUS, attributes=names).drop("scan_id", "total"))


def pca_normals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surface of each point's neighbours within a radius."""
    points = cloud(spark, sf_dir)
    return _rounded(spatial.surface_of(points, vicinity.around(points, points, RADIUS, moments=True)).drop("scan_id"), 4)


def knn_normals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surface of each point's nearest neighbours, itself included."""
    points = cloud(spark, sf_dir)
    return _rounded(spatial.surface_of(points, spatial.nearest_described(points, points, KNN, moments=True).drop("mean_dist", "kth_dist")).drop("scan_id"), 4)


def radius_curvature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least eigenvalue's share of each point's neighbours within a radius, from two neighbours on."""
    points = cloud(spark, sf_dir)
    cov = vicinity.around(points, points, RADIUS, moments=True)
    return _rounded(spatial.principal_axes(cov, few=1).select("src", "n", "curvature"))


def surroundings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ten attributes' statistics around each point, those of the surface included."""
    return _rounded(spatial.surroundings(cloud(spark, sf_dir), RADIUS).drop("scan_id"), 5)


def roughness_at_radii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roughness at several radii of every thirtieth point."""
    return _rounded(spatial.roughness_at_radii(ordered.every_nth(cloud(spark, sf_dir), 30, ["point_counter"]), (1.0, 2.5, 5.0, 10.0)).drop("scan_id"), 4)


def centred_by_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points relative to their scan's median, the scanner half a unit above it, with their range."""
    return _rounded(spatial.centred(cloud(spark, sf_dir), "median", 0.5).select("point_counter", "x", "y", "z", spatial.distance_from_origin().alias("rho")))


def nearest_result_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of a thinned cloud's own predictions and of those of the nearest points in the full cloud, which it does not share ids with."""
    full = cloud(spark, sf_dir)
    snapped = spatial.snap_to_points(full, 2.0).select(F.col("scan_id").alias("_s"), F.col("point_counter").alias("_p"))
    three = full.join(shuffled(snapped), (F.col("scan_id") == F.col("_s")) & (F.col("point_counter") == F.col("_p"))).drop("_s", "_p", "pred")
    three = three.withColumn("pred", ((F.col("label") + (F.col("point_counter") % 5 == 0).cast("int")) % 6).cast("int"))
    two = spatial.nearest_values(full.withColumn("point_counter", F.col("point_counter") + 1_000_000_000), three, ["label", "pred"])
    return _rounded(metrics.reports_of({"3d": three, "2d": two}, "id"))


def view_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(spatial.view_vectors(cloud(spark, sf_dir)).drop("scan_id"))


def label_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = cloud(spark, sf_dir)
    keys = ("x", "y", "z")
    return _rounded(labels.attach_labels(points.select("point_counter", *keys), points.where("red < 128").select(*keys, "point_counter", "label"), keys).select("point_counter", "label"))


def label_unfold(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = segmented(spark, sf_dir)
    named = segments.label_shares(points).where("n > 1").select("scan_id", "segment_id", F.col("mode_label").alias("predicted"))
    return _rounded(labels.unfold(points.select("scan_id", "segment_id", "point_counter"), named).select("point_counter", "predicted"))


def drop_class_recode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(labels.drop_class(cloud(spark, sf_dir), 2).groupBy("label", "code").agg(F.count("*").alias("n")))


def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(labels.class_weights(cloud(spark, sf_dir)))


def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.stratified_sample(cloud(spark, sf_dir), ["scan_id", "label"], 300, F.col("point_counter")).select("point_counter")


def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.confusion(cloud(spark, sf_dir)))


def classification_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.report(cloud(spark, sf_dir)))


def impurity_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(analysis.impurity_report(segments.label_shares(segmented(spark, sf_dir))))


def describe_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(analysis.describe(cloud(spark, sf_dir), ["scan_id", "label"], "rho"))


def pivot_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return _rounded(analysis.pivot_with_margins(items, "l_returnflag", "l_linestatus", "l_quantity", ["F", "O"]))


def drop_one_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    name = F.when(F.col("o_orderpriority").startswith("1"), "none").otherwise(F.col("o_orderpriority"))
    runs = orders.groupBy("o_custkey", name.alias("drop_col")).agg(F.max("o_totalprice").alias("f1"))
    return _rounded(analysis.importance(runs, ["o_custkey"], "drop_col", "f1"), 2)


def linear_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(analysis.linear_fit(cloud(spark, sf_dir), ["scan_id"], "x", "z"))


def scaled_top_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy("o_custkey").agg(F.count("*").alias("n"), F.avg("o_totalprice").alias("mean_price"))
    return _rounded(analysis.closest_by_scaled_difference(runs, "n", "mean_price", 15, "o_custkey"))


def running_point_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.running_point_ids(cloud(spark, sf_dir), "scan_id", ["point_counter"]).select("point_counter", "point_id")


def stride_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of every thirty rows of chosen scanlines."""
    chosen = scanlines(spark, sf_dir).where(F.col("scanline_id").isin(1, 100, 1000, 2000, 3000, 4000))
    return ordered.every_nth(chosen, 30, ["scan_id", "point_counter"]).select("point_counter", "scanline_id")


def threshold_sweep(spark: SparkSession, sf_dir: str, thresholds: Sequence[float] = (40.0, 80.0, 120.0)) -> DataFrame:
    """Number of segments of each scan for several thresholds of the range difference, in one pass."""
    place = F.struct("scanline_id", "vert_angle", "point_counter")
    flag = lambda t: (F.col("rho_diff") > t).cast("long")
    cells = [F.struct(F.lit(t).alias("threshold"), (1 + F.sum(flag(t)) - F.max_by(flag(t), place)).alias("segments")) for t in thresholds]
    swept = scanlines(spark, sf_dir).groupBy("scan_id").agg(F.count("*").alias("n"), F.array(*cells).alias("cells"))
    return swept.select("scan_id", "n", F.explode("cells").alias("c")).select("scan_id", "n", "c.threshold", "c.segments")


def segment_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wide table of segments: nearest points, statistics of heights above the lowest point, label, impurity and count."""
    return _rounded(segments.segment_table(segmented(spark, sf_dir), ["z", "rho"], (*segments.STATISTICS, "mean", "var", "median")))


def named_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points by name of their label, with a key of scan and label."""
    key = F.concat(F.lit("S"), F.col("scan_id").cast("string"), F.lit("_L"), F.col("label").cast("string"))
    return cloud(spark, sf_dir).groupBy(columns.mapped(F.col("label"), LABEL_NAMES).alias("label_name"), key.alias("key")).agg(F.count("*").alias("n"))


def chosen_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segment statistics without percentiles, the label renamed."""
    table = segments.segment_statistics(segmented(spark, sf_dir), ["z", "rho"])
    return _rounded(table.select(*columns.matching(table.columns, "perc|skew", keep=False)).withColumnRenamed("n", "points"))


def row_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(labels.row_weights(cloud(spark, sf_dir)).select("point_counter", "weight"))


def random_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.split_rows(cloud(spark, sf_dir), "point_counter").groupBy("label", "part").agg(F.count("*").alias("n"), F.min("point_counter").alias("first_point")).withColumn("label", F.col("label").cast("long"))


def fold_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of every file in each of two fixed folds, by role."""
    return labels.fold_roles(cloud(spark, sf_dir), "scan_id", [(0, 2), (1, 3)]).groupBy("fold", "scan_id", "role").agg(F.count("*").alias("n")).withColumn("fold", F.col("fold").cast("long"))


def inner_unfold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of segments with several points, with their segment's label; points of others go."""
    points = segmented(spark, sf_dir)
    named = segments.label_shares(points).where("n > 1").select("scan_id", "segment_id", F.col("mode_label").alias("predicted"))
    return _rounded(labels.unfold(points.select("scan_id", "segment_id", "point_counter"), named, inner=True).select("point_counter", "predicted"))


def exact_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.stratified_sample(cloud(spark, sf_dir), ["label"], 50, F.col("point_counter").desc(), exact=True).select("point_counter")


def summed_confusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum of the scans' confusion matrices, each row as shares too."""
    each = cloud(spark, sf_dir).groupBy("scan_id", F.col("label").alias("truth"), "pred").agg(F.count("*").alias("n"))
    return _rounded(metrics.summed(each))


def scan_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of all scans in one table."""
    return _rounded(metrics.reports_by(cloud(spark, sf_dir), "scan_id"))


def three_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores at three granularities of a segment's most frequent prediction."""
    points = stage(segmented(spark, sf_dir), "segmented")
    truth = segments.label_shares(points).select("scan_id", "segment_id", "n", F.col("mode_label").alias("label"))
    told = segments.label_shares(points, "pred").select("scan_id", "segment_id", F.col("mode_label").alias("predicted"))
    table = stage(columns.side_by_side(truth, told, ("scan_id", "segment_id")), "told")
    sample = labels.stratified_sample(table, ["label"], 50, F.struct("scan_id", "segment_id"))
    return _rounded(training.models.three_reports(sample, table, points.select("scan_id", "segment_id", "label")))


def percentage_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.mean_percentage_error(cloud(spark, sf_dir), "label", "pred"))


def correlation_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(analysis.correlations(cloud(spark, sf_dir), ["x", "y", "z", "rho"]))


def label_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(analysis.ranking(cloud(spark, sf_dir), "label", "rho"))


_OWN = (
    angle_adjust, scanline_summary, rho_diff, gradient_curvature, segment_stats, segment_labels, segment_representatives, segment_table, range_profile, expected_distance, scanline_features,
    break_segments, knn_break_segments, segmentation_sweep, impurity_sweep, threshold_sweep, radius_counts, radius_counts_strict, knn_mean_distance, voxels, voxel_pyramid, voxel_sweep, voxel_snap, neighbour_covariance, neighbour_statistics, pca_normals,
    radius_curvature, knn_normals, surroundings, roughness_at_radii, view_vectors, centred_by_median, nearest_result_report, label_left_join, label_unfold, inner_unfold, drop_class_recode, named_labels, chosen_columns,
    class_weights, row_weights, stratified_sample, exact_sample, random_split, fold_roles, confusion_matrix, summed_confusions, classification_report, scan_reports, three_reports, percentage_error,
    impurity_report, describe_groups, pivot_margins, drop_one_importance, linear_fits, correlation_matrix, label_ranking, scaled_top_runs, running_point_ids, stride_rows,
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _OWN} | files.QUERIES | training.QUERIES
ORACLES: dict[str, str] = oracles.SQL
