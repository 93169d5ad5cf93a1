"""What the sweeps rest on: sums and deviations to the last bit."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rangeloom.operators import analysis, bins, neighbourhood, ordered, segments, spatial, sweeps


def test_equal_values_of_a_bin_are_a_hole(spark):
    """Values of a bin that are the same in all tasks have no deviation at all, and the hole is filled from its neighbours."""
    rows = [(0, 10.0 * b + 1, 39.1 if b == 1 else 7.3 * b + i % 2) for b in range(3) for i in range(60)]
    points = spark.createDataFrame(rows, "scan_id long, rho double, value double").repartition(7)
    got = {r.bin: r.profile_std for r in bins.range_profile(points, "value", 10.0).collect()}
    assert got[2] == got[3] == 0.5


def test_angles_far_along_a_scan_are_those_of_ordered_sums(spark):
    """Sums of the regression take a row's pairs one after the other, the farthest end first, and squares from the C library."""
    rng = np.random.default_rng(3)
    phi = np.cumsum(rng.integers(1, 20, 400)) / 50 + 100_000
    rho = np.round(rng.random(400) * 100, 2)
    rows = [(0, 0, i, 0.0, 0.0, 0.0, float(r), float(p), float(i)) for i, (p, r) in enumerate(zip(phi, rho, strict=True))]
    line = spark.createDataFrame(rows, "scan_id long, scanline_id long, point_counter long, x double, y double, z double, rho double, horiz_angle double, vert_angle double")
    got = [r.slope_lstsq for r in neighbourhood.scanline_features(line, F.lit(6)).orderBy("point_counter").collect()]
    mirrored = lambda j: 2 * 399 - abs(j) if abs(j) >= 400 else abs(j)
    for i, found in enumerate(got):
        pairs = sorted(((mirrored(i + 1 + t), t, mirrored(i - 6 + t)) for t in range(6)), key=lambda p: (-p[0], p[1]))
        sx = sy = sxx = sxy = 0.0
        for b, _, a in pairs:
            sx, sy = sx + (phi[a] + phi[b]), sy + (rho[a] + rho[b])
            sxx, sxy = sxx + (math.pow(phi[a], 2) + math.pow(phi[b], 2)), sxy + (phi[a] * rho[a] + phi[b] * rho[b])
        spread = 12.0 * sxx - sx * sx
        beta = (12.0 * sxy - sx * sy) / spread if abs(spread) > 1e-9 else sx / 12 * sy / 12 / (math.pow(sx / 12, 2) + 1)
        assert math.isclose(found, math.degrees(math.atan(beta)), rel_tol=1e-13, abs_tol=1e-13), i


def test_segments_of_all_runs_are_counted_without_a_row_for_each(spark, monkeypatch):
    """Kinds of segments, over many stretches and long open ones, as those of a row for each point and run; null labels and conditions among them."""
    rng = np.random.default_rng(4)
    rows = [(i % 3, i // 40, float(i), i, None if i % 11 == 0 else int(rng.integers(0, 4)), float(rng.random() * 50), 10.0, None if i % 7 == 0 else 1.0, float(rng.normal() * (40 if i < 900 else 1))) for i in range(1500)]
    bent = spark.createDataFrame(rows, "scan_id long, scanline_id long, vert_angle double, point_counter long, label int, rho_diff double, expected_value double, expected_value_std double, curvature_lstsq double").repartition(5)
    monkeypatch.setattr(sweeps, "_ROWS", 64)
    monkeypatch.setattr(sweeps, "_LONG", 20)
    stds, curvatures = (1.0, 35.0), (20.0, 60.0)
    kinds, runs = sweeps.segment_kinds(bent, [ordered.range_jump(s) for s in stds], {2.0: [F.abs("curvature_lstsq") > c for c in curvatures]}, ["scanline_id", "vert_angle", "point_counter"])
    got = {(r.scan_id, *runs[r.run], r.n, r.squares): r.c for r in kinds.collect()}
    counts = ordered.sweep_label_counts(bent, stds, curvatures)
    each = counts.groupBy("scan_id", "std_multiplier", "curvature_threshold", "segment_id").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("squares"))
    want = {(r.scan_id, stds.index(r.std_multiplier), 2.0, curvatures.index(r.curvature_threshold), r.n, r.squares): r["count"] for r in each.groupBy("scan_id", "std_multiplier", "curvature_threshold", "n", "squares").count().collect()}
    assert got == want and max(k[4] for k in want) > 20
    keys = ["scan_id", "run"]
    report = analysis.impurity_report_of(kinds.withColumn("gini", F.round(1 - F.col("squares") / (F.col("n") * F.col("n")), 4)), keys)
    plain = kinds.withColumn("gini", F.round(1 - F.col("squares") / (F.col("n") * F.col("n")), 4)).withColumn("_", F.explode(F.sequence(F.lit(1).cast("long"), F.col("c"))))
    plain = {(r.scan_id, r.run): r for r in analysis.impurity_report(plain, keys).collect()}
    for r in report.collect():
        assert r.asDict() == pytest.approx(plain[r.scan_id, r.run].asDict(), abs=1e-12)


@pytest.mark.parametrize("crowd", [1 << 17, 20])
def test_nearest_points_are_described_in_a_row_each(spark, monkeypatch, crowd):
    """Count, distances and moments of the nearest, equally near ones by their ids, in blocks and where points crowd."""
    rng = np.random.default_rng(2)
    at = np.concatenate([rng.integers(0, 30, (300, 3)) / 10, np.full((40, 3), 1.0), [[90.0, 0.0, 0.0]]])
    points = spark.createDataFrame([(i % 2, i, *map(float, v)) for i, v in enumerate(at)] + [(7, 900, 1.0, 1.0, 1.0), (7, 901, 2.0, 1.0, 1.0)], "scan_id long, point_counter long, x double, y double, z double")
    monkeypatch.setattr(spatial, "_CROWD", crowd)
    got = {r.src: r for r in spatial.nearest_described(points, points, 6, moments=True).collect()}
    plain = {r.src: r for r in spatial.nearest_described(points, points, 6).collect()}
    assert set(got) == set(plain) == {*range(len(at)), 900, 901} and got[900].n == 2 and got[900].mean_dist == got[900].kth_dist == 1
    for i, v in enumerate(at):
        d = np.sqrt(((at - v) ** 2).sum(1))
        near = sorted(range(i % 2, len(at), 2), key=lambda j: (d[j], j != i, j))[:6]
        for r in (got[i], plain[i]):
            assert r.n == 6 and np.isclose(r.mean_dist, d[near[1:]].mean()) and np.isclose(r.kth_dist, d[near[-1]])
        assert np.allclose([got[i][f"m{c}"] for c in "xyz"], at[near].mean(0))
        assert np.allclose([got[i][f"c{c}"] for c in ("xx", "xy", "xz", "yy", "yz", "zz")], np.cov(at[near].T)[np.triu_indices(3)], atol=1e-9)
