"""Every query of the catalogue against its SQL, and what SQL cannot express against brute force and planted labels."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from rangeloom.operators import labels, ordered, spatial
from rangeloom.plans import catalogue, models, training
from rangeloom.plans.cloud import cloud


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_sql(name, same_rows):
    same_rows(catalogue.QUERIES[name], catalogue.ORACLES[name])


@pytest.fixture(scope="module")
def points(spark, data):
    """Rows of the cloud, by scan, as arrays."""
    rows = cloud(spark, data).orderBy("scan_id", "point_counter").collect()
    return {s: [r for r in rows if r.scan_id == s] for s in {r.scan_id for r in rows}}


def surface_by_hand(own, near, view, few=2):
    """(curvature, normal, roughness, zenith) of points ``near`` around one of them."""
    if len(near) <= few:
        return 0.0, np.zeros(3), 0.0, 0.0
    values, vectors = np.linalg.eigh(np.cov(near.T))
    normal = vectors[:, 0] * (-1 if vectors[:, 0] @ view < 0 else 1)
    return values[0] / values.sum(), normal, abs((own - near.mean(0)) @ normal), np.degrees(np.arccos(np.clip(normal[2], -1, 1)))


def xyz_and_views(rows):
    xyz = np.array([(r.x, r.y, r.z) for r in rows])
    off = xyz - xyz.mean(0)
    return xyz, -off / np.linalg.norm(off, axis=1, keepdims=True)


def check_surface(got, points, neighbours):
    found = {r.src: r for r in got}
    assert len(found) == sum(map(len, points.values()))
    for rows in points.values():
        xyz, views = xyz_and_views(rows)
        apart = np.sqrt(((xyz[:, None] - xyz[None]) ** 2).sum(2))
        for i, r in enumerate(rows):
            near = neighbours(apart[i])
            curvature, normal, roughness, zenith = surface_by_hand(xyz[i], xyz[near], views[i])
            f = found[r.point_counter]
            assert f.n == len(near) and f.curvature == pytest.approx(curvature, abs=1e-9) and f.roughness == pytest.approx(roughness, abs=1e-6)
            if abs(normal @ views[i]) > 1e-6:
                assert np.allclose((f.nx, f.ny, f.nz), normal, atol=1e-6) and f.zenith_angle == pytest.approx(zenith, abs=1e-3)


def test_radius_surface_equals_brute_force(spark, data, points):
    wide = cloud(spark, data)
    got = spatial.surface(wide, spatial.within_radius(wide, wide, 3.0, carry=("x", "y", "z"))).collect()
    assert sum(r.n > 2 for r in got) > 100
    check_surface(got, points, lambda d: np.flatnonzero(d <= 3.0))


def test_knn_surface_equals_brute_force(spark, data, points):
    wide = cloud(spark, data)
    check_surface(spatial.surface(wide, spatial.nearest(wide, wide, catalogue.KNN)).collect(), points, lambda d: np.argsort(d, kind="stable")[: catalogue.KNN])


def test_surroundings_equal_brute_force(spark, data, points):
    """All ten attributes' statistics, those of the neighbours' own surfaces included."""
    radius = 3.0
    wide = cloud(spark, data)
    first = {r.src: r for r in spatial.surface(wide, spatial.within_radius(wide, wide, radius)).collect()}
    got = {r.src: r for r in spatial.surroundings(wide, radius).collect()}
    some = 0
    for rows in points.values():
        xyz, _ = xyz_and_views(rows)
        values = {a: np.array([r[a] if a in r.__fields__ else first[r.point_counter][a] for r in rows], float) for a in spatial.SURROUNDINGS}
        for i, r in enumerate(rows):
            near = np.flatnonzero(((xyz - xyz[i]) ** 2).sum(1) <= radius * radius)
            some += len(near) > 2
            for a, v in values.items():
                want = [v[near].mean(), v[near].std(), *np.percentile(v[near], (2, 25, 75, 98))] if len(near) > 2 else [0.0] * 6
                assert np.allclose([got[r.point_counter][f"{a}_{s}"] for s in ("mean", "std", "perc2nd", "perc25th", "perc75th", "perc98th")], want, atol=1e-6), (a, r.point_counter)
    assert some > 100


def test_roughness_at_radii_equals_brute_force(spark, data, points):
    thinned = ordered.every_nth(cloud(spark, data), 30, ["point_counter"])
    got = {r.src: r for r in spatial.roughness_at_radii(thinned, (1.0, 2.5, 5.0, 10.0)).collect()}
    kept = sorted(r.point_counter for rows in points.values() for r in rows)[::30]
    assert sorted(got) == kept
    for rows in points.values():
        rows = [r for r in rows if r.point_counter in got]
        xyz = np.array([(r.x, r.y, r.z) for r in rows])
        for i, r in enumerate(rows):
            apart = np.sqrt(((xyz - xyz[i]) ** 2).sum(1))
            for k, radius in enumerate((1.0, 2.5, 5.0, 10.0)):
                want = surface_by_hand(xyz[i], xyz[apart < radius], np.ones(3))[2]
                assert got[r.point_counter][f"roughness_{k}"] == pytest.approx(want, abs=1e-6)


def test_mean_distance_equals_brute_force(spark, data):
    some = cloud(spark, data).where("scan_id = 0").orderBy("point_counter").limit(80)
    rows = catalogue.with_mean_distance(some).collect()
    xyz = np.array([(r.x, r.y, r.z) for r in rows])
    apart = np.sort(np.sqrt(((xyz[:, None] - xyz[None]) ** 2).sum(2)), axis=1)[:, 1 : catalogue.KNN]
    assert len(rows) == 80 and np.allclose([r.mean_dist for r in rows], apart.mean(1))


@pytest.fixture(scope="module")
def planted(spark):
    """Segments of four files whose label shows in two of their features."""
    rng = np.random.default_rng(1)
    rows = []
    for i in range(480):
        label = i % 4
        rows.append((i % 16 // 4, i, float(label + rng.normal(0, 0.05)), float(-label + rng.normal(0, 0.05)), float(rng.normal()), label, 1.0 + (label == 3)))
    return spark.createDataFrame(rows, "scan_id int, segment_id int, z_std double, rho_std double, red_std double, label int, weight double")


@pytest.mark.parametrize(("kind", "weight"), [("forest", None), ("forest", "weight"), ("boosted", None), ("boosted", "weight")])
def test_models_find_planted_labels(planted, kind, weight):
    model = models.fit(planted.where("scan_id <> 3"), ["z_std", "rho_std", "red_std"], kind=kind, weight=weight, trees=8, depth=4)
    rows = models.predict(model, planted.where("scan_id = 3")).collect()
    assert len(rows) == 120 and all(r.predicted == r.label for r in rows)


def test_training_runs_find_planted_labels(spark, planted):
    features, how = ["z_std", "rho_std", "red_std"], {"trees": 6, "depth": 3}
    reports, model = models.fold_reports(planted, features, "scan_id", [(0, 1), (2, 3)], **how)
    right = {(r.fold, r.name): r.f1 for r in reports.collect()}
    assert len(right) == 14 and all(v == 1 for v in right.values())
    assert all(r.f1 == 1 for r in models.validation_report(model, planted).collect())
    ranked = models.importances(model).collect()
    assert [r.place for r in ranked] == [1, 2, 3] and ranked[-1].feature == "red_std"
    train, test = planted.where("scan_id <> 3"), planted.where("scan_id = 3")
    runs = {r.drop_col: (r.baseline_model, r.f1) for r in models.drop_one_runs(train, test, ["z", "rho", "red"], ["std"], by="attribute", **how).collect()}
    assert runs["none"] == (1, 1) and runs["z"] == runs["rho"] == runs["red"] == (0, 1)
    dropped = models.drop_class_runs(train, test, features, (1,), **how).collect()
    assert {r.name for r in dropped} == {"0", "1", "2", "accuracy", "macro avg", "weighted avg"} and all(r.f1 == 1 for r in dropped)
    grid = {(r.trees, r.depth): r.f1 for r in models.parameter_runs(train, test, features, {"trees": [1, 4], "depth": [1, 3]}).collect()}
    assert set(grid) == {(1, 1), (1, 3), (4, 1), (4, 3)} and grid[(4, 3)] == 1
    together = {(r.fold, r.name): r.f1 for r in models.fold_runs(planted, features, "scan_id", [(0, 1), (2, 3)], weight="weight", trees=4, depth=3).collect()}
    assert len(together) == 14 and all(v == 1 for v in together.values())
    assert models.importances(models.fit(planted, features, kind="boosted", trees=3, depth=3)).collect()[-1].feature == "red_std"
    best, tried = models.random_search(train, features, {"numTrees": [3, 6], "maxDepth": [1, 4]}, candidates=3)
    assert tried.count() == 3 and best["maxDepth"] == 4 and max(r.f1 for r in tried.collect()) > 0.99


@pytest.mark.parametrize("name", ["classify_segments", "boosted_segments"])
def test_segment_models_cover_the_fourth_scan(spark, data, name):
    rows = training.QUERIES[name](spark, data).collect()
    want = training.labelled_segments(spark, data).where("scan_id = 3")
    assert len(rows) == want.count() and {r.predicted for r in rows} <= set(range(6))


def test_folds_are_pairs_of_different_files():
    pairs = labels.fold_pairs("abcdef", 3)
    assert sorted(x for p in pairs for x in p) == list("abcdef") and pairs == labels.fold_pairs("fedcba", 3)
    with pytest.raises(ValueError, match="folds"):
        labels.fold_pairs("abc", 2)


def test_long_scans_are_many_tasks(spark, data):
    """Scanline ids of one scan over more partitions than scans, as those of a single window."""
    from pyspark.sql import Window

    one = cloud(spark, data).withColumn("scan_id", F.lit(0).cast("long"))
    w = Window.orderBy("horiz_angle", "point_counter")
    jump = F.coalesce(F.abs(F.lead("vert_angle").over(w) - F.col("vert_angle")), F.abs(F.col("vert_angle") - F.lag("vert_angle").over(w)))
    want = one.withColumn("b", (jump > 80).cast("int")).withColumn("w", F.sum("b").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("b") + 1)
    assert {r.point_counter: r.scanline_id for r in ordered.scanline_ids(one).collect()} == {r.point_counter: r.w for r in want.collect()}
