"""Hand-made fixtures of the operators."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from rangeloom.operators import bins, columns, labels, metrics, ordered, segments, spatial, vicinity
from rangeloom.operators.components import connected_components
from rangeloom.operators.axes import principal_axes
from rangeloom.operators.prefix import running_total, running_totals
from rangeloom.sources import layouts


def test_break_row_stays_left(spark):
    rows = spark.createDataFrame([(0, i, float(i), i in (2, 4)) for i in range(7)], "scan_id long, point_counter long, vert_angle double, brk boolean").withColumn("scanline_id", F.lit(1))
    got = [r.segment_id for r in ordered.segment_ids(rows, F.col("brk")).orderBy("point_counter").collect()]
    assert got == [1, 1, 1, 2, 2, 3, 3]


def test_profile_holes_and_shift(spark):
    rows = spark.createDataFrame([(0, 0.1, 1.0), (0, 0.6, 3.0), (0, 2.1, 9.0), (0, 2.6, 5.0)], "scan_id long, rho double, d double")
    got = {r.bin: r.profile_max for r in bins.range_profile(rows, "d").collect()}
    assert got == {1: 1.0, 2: 1.0, 3: 3.0, 4: 5.0, 5: 7.0, 6: 9.0}


def test_single_point_and_ties(spark):
    rows = spark.createDataFrame([(0, 1, 5.0, 1), (0, 2, 1.0, 3), (0, 2, 1.0, 1), (0, 2, float("nan"), 3), (0, 2, 1.0, 1)], "scan_id long, segment_id long, z double, label int")
    stats = {r.segment_id: r for r in segments.segment_statistics(rows, ["z", "z"]).collect()}
    assert stats[1].z_std == 0 and stats[1].z_skewness == 0 and stats[2].z_std == 0
    shares = {r.segment_id: r for r in segments.label_shares(rows).collect()}
    assert shares[2].mode_label == 1 and shares[2].gini == 0.5 and shares[1].gini == 0


def test_percentiles_of_a_segment_come_from_one_list(spark):
    """Percentiles are exactly Spark's own, nulls and NaN left out, and the plan holds one buffer an attribute."""
    rng = np.random.default_rng(8)
    values = [None, float("nan"), -0.0, 0.0, *np.round(rng.normal(0, 9, 200), 1).tolist()]
    rows = [(0, int(i ** 0.5 * 3), values[int(rng.integers(0, len(values)))], int(rng.integers(0, 4))) for i in range(400)] + [(1, 1, None, 2), (1, 1, float("nan"), None)]
    table = spark.createDataFrame(rows, "scan_id long, segment_id long, z double, red int").repartition(3)
    names = (*segments.STATISTICS, "median")
    got = segments.segment_statistics(table, ["z", "red", "z"], names)
    want = table.groupBy("scan_id", "segment_id").agg(F.count("*").alias("n"), *[segments.statistic(a, s).alias(f"{a}_{s}") for a in ("z", "red") for s in names])
    assert got.columns == want.columns
    exact = [c for c in got.columns if "perc" in c or "median" in c]
    found, told = ({(r.scan_id, r.segment_id): r for r in df.collect()} for df in (got, want))
    assert found.keys() == told.keys() and all(found[k][c] == told[k][c] for k in told for c in exact)
    assert found[1, 1].z_perc2nd is None and found[1, 1].red_perc98th == 2
    assert "percentile" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_planar_patch(spark):
    rows = spark.createDataFrame([(0, i * 10 + j, float(i), float(j), 0.0) for i in range(10) for j in range(10)], "scan_id long, point_counter long, x double, y double, z double")
    axes = spatial.principal_axes(spatial.covariances(rows, spatial.within_radius(rows, rows, 1.5))).collect()
    assert len(axes) == 100 and all(abs(r.nz) == pytest.approx(1) and r.curvature == pytest.approx(0) for r in axes)


def test_nearest_grows_its_cell_and_keeps_duplicates(spark):
    rows = spark.createDataFrame([(0, 1, 0.0), (0, 2, 0.0), (0, 3, 50.0)], "scan_id long, point_counter long, x double").withColumns({"y": F.lit(0.0), "z": F.lit(0.0)})
    got = {(r.src, r["rank"]): (r.dst, r.dist) for r in spatial.nearest(rows, rows, 2).collect()}
    assert got == {(1, 0): (1, 0.0), (1, 1): (2, 0.0), (2, 0): (2, 0.0), (2, 1): (1, 0.0), (3, 0): (3, 0.0), (3, 1): (1, 50.0)}


def test_labels_do_not_fan_out(spark):
    scan = spark.createDataFrame([(1, 1.0), (2, None), (3, 9.0)], "point_counter long, x double")
    known = spark.createDataFrame([(7, 1.0, 4), (8, 1.0, 5), (9, None, 2)], "point_counter long, x double, label int")
    assert {r.point_counter: r.label for r in labels.attach_labels(scan, known, ["x"]).collect()} == {1: 4, 2: 2, 3: 0}
    with pytest.raises(ValueError, match="stratum"):
        labels.stratified_sample(known, ["label"], 2, F.col("point_counter"), exact=True)


def test_absent_class_scores_zero(spark):
    rows = spark.createDataFrame([(0, 0), (1, 0)], "label int, pred int")
    got = {r.name: r for r in metrics.report(rows).collect()}
    assert got["1"].precision == 0 and got["1"].recall == 0 and got["accuracy"].f1 == 0.5
    assert metrics.report(rows.limit(0)).count() == 0


def test_components_and_running_totals(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (5, 5), (None, 1)], "src long, dst long")
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}
    rows = spark.createDataFrame([("a", i, 1) for i in range(50)] + [(None, 1, None), (None, 2, 5)], "k string, o long, v long")
    sums = {(r.k, r.o): r.s for r in running_total(rows, "v", [F.col("o")], "s", by=["k"]).collect()}
    assert sums[("a", 49)] == 50 and sums[(None, 1)] == 0 and sums[(None, 2)] == 5


def test_text_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(1.0, 2.0, 3.0, 0.5, 1, 2, 3, 4.0, 5.0, 6.0, 7, 2)], layouts.layout_schema(layouts.LABELED12))
    layouts.write_points(rows, str(tmp_path / "pts"), layouts.LABELED12)
    back = layouts.read_points(spark, str(tmp_path / "pts"), layouts.LABELED12)
    assert back.drop("path").collect() == rows.collect()
    layouts.write_header(spark, ["a", 'b "c"', "d"], str(tmp_path / "names"))
    assert layouts.read_header(spark, str(tmp_path / "names")) == ["a", 'b "c"', "d"]


def test_every_nth_takes_the_first_of_each_run(spark):
    rows = spark.createDataFrame([(i * 7,) for i in range(100)], "o long")
    assert [r.o for r in ordered.every_nth(rows, 30, ["o"]).orderBy("o").collect()] == [0, 210, 420, 630]


def test_reports_append_and_confusions_round_trip(spark, tmp_path):
    path = str(tmp_path / "reports")
    for n in (1, 2):
        layouts.write_report(spark.createDataFrame([(f"r{n}", n)], "name string, n long"), path, append=True)
    assert sorted(tuple(r) for r in layouts.read_table(spark, path, "name string, n long").collect()) == [("r1", 1), ("r2", 2)]
    counts = spark.createDataFrame([(t, p, 10 * t + p) for t in range(3) for p in range(3)], "truth int, pred int, n long")
    layouts.write_confusion(counts, str(tmp_path / "one"))
    back = layouts.read_confusions(spark, str(tmp_path / "one")).collect()
    assert sorted((r.truth, r.pred, r.n) for r in back) == sorted(tuple(r) for r in counts.collect())


def test_parameters_of_a_file_with_several_rows(spark):
    rows = spark.createDataFrame([("/d/a_b.txt", 1), ("/d/c.txt", 2)], "path string, v int")
    own = spark.createDataFrame([("/p/a_b.csv", 2.0, 5), ("/p/a_b.csv", 1.0, 9)], "path string, std_multiplier double, curvature_threshold int")
    got = {r.v: (r.std_multiplier, r.curvature_threshold, r.params) for r in layouts.with_parameters(rows, own, ("std_multiplier", "curvature_threshold")).collect()}
    assert got == {1: (1.0, 9, "SM1.0_CT9"), 2: (None, None, None)}


def test_columns(spark):
    assert columns.matching(["a_std", "b_mean"], "std|x") == ["a_std"] and columns.matching(["a_std", "b_mean"], "std|x", keep=False) == ["b_mean"]
    assert dict(columns.drop_one(["a", "b"], ["s", "t"], "statistic")) == {"none": ["a_s", "a_t", "b_s", "b_t"], "s": ["a_t", "b_t"], "t": ["a_s", "b_s"]}
    assert [d for d, _ in columns.drop_one(["a", "b"], ["s"], "column")] == ["none", "a_s", "b_s"]


def test_several_totals_from_one_sort(spark):
    """Counters of a key with most rows, null values and keys, and columns that have the names of working ones."""
    rng = np.random.default_rng(6)
    rows = [(None if i % 10 == 0 else int(i % 3 == 0), i, int(rng.integers(0, 5)), None if i % 7 == 0 else 1, i, -i, 0) for i in range(300)]
    table = spark.createDataFrame(rows, "k int, at int, v int, w int, _s int, _k0 int, _base int").repartition(5)
    got = running_totals(table, {"v_sum": "v", "both": F.col("v") + F.col("w"), "_s_": "w"}, [F.col("at")], by=["k"])
    assert got.columns == [*table.columns, "v_sum", "both", "_s_"]
    by = {}
    for r in got.orderBy("at").collect():
        v, both, w = by.get(r.k, (0, 0, 0))
        by[r.k] = now = (v + r.v, both + (r.v + r.w if r.w is not None else 0), w + (r.w or 0))
        assert (r.v_sum, r.both, r._s_, r._s, r._k0) == (*now, r.at, -r.at)
    assert running_totals(table.limit(0), {"n": "v"}, [F.col("at")]).count() == 0


def test_lines_are_numbered_over_files_cut_into_splits(spark, tmp_path):
    """Files of unequal length, one of them gzipped and one empty, read in many splits."""
    import gzip

    path, n = tmp_path / "scans", 0
    path.mkdir()
    for name, rows in (("b_2.asc", 40), ("a 1.asc", 700), ("c.asc.gz", 30), ("a_0.asc", 0), ("d.asc", 1)):
        with (gzip.open if name.endswith("gz") else open)(path / name, "wt") as f:
            f.writelines(f"{i}.0 {rows}.0 0.5\n" + "\n" * (i % 5 == 0) for i in range(rows))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
    try:
        got = layouts.numbered_points(spark, str(path), ("x", "_block", "z")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    rows = sorted((r.point_id, r._block, r.x) for r in got)
    assert [r[0] for r in rows] == list(range(771))
    for size in (700.0, 40.0, 30.0, 1.0):
        assert [r[1:] for r in rows[n : n + int(size)]] == [(size, float(i)) for i in range(int(size))]
        n += int(size)


def test_voxels_of_all_sizes_equal_each_alone(spark):
    rng = np.random.default_rng(7)
    xyz = np.concatenate([rng.uniform(-3, 3, (400, 3)), np.tile(rng.uniform(-3, 3, 3), (200, 1))])
    points = spark.createDataFrame([(i % 2, i, *map(float, p)) for i, p in enumerate(xyz)], "scan_id int, point_counter long, x double, y double, z double")
    sizes = (2.0, 1.0, 0.5, 0.75)
    assert spatial.voxel_bases(sizes) == {2.0: (0.5, 4), 1.0: (0.5, 2), 0.5: (0.5, 1), 0.75: (0.75, 1)}
    got = {(r.edge, r.scan_id, r.vx, r.vy, r.vz): (r.n, r.x, r.y, r.z) for r in spatial.voxel_pyramid(points, sizes).collect()}
    want = {}
    for e in sizes:
        for i, p in enumerate(xyz):
            want.setdefault((e, i % 2, *map(int, np.floor(p / e))), []).append(p)
    assert set(got) == set(want)
    assert all(got[k][0] == len(v) and np.allclose(got[k][1:], np.mean(v, axis=0)) for k, v in want.items())
    snapped = {(r.edge, r.scan_id, r.vx, r.vy, r.vz): r.point_counter for r in spatial.snapped_voxels(points, sizes).collect()}
    for k, v in want.items():
        own = np.flatnonzero(np.arange(len(xyz)) % 2 == k[1])
        far = np.round(np.linalg.norm(xyz[own] - np.mean(v, axis=0), axis=1), 9)
        assert snapped[k] == own[np.argmin(far)]


def test_axes_equal_an_eigensolver(spark):
    """Random, flat, straight, round and tiny matrices; where eigenvalues are equal any of their axes will do."""
    rng = np.random.default_rng(8)
    made = []
    for scale in (1.0, 1e-8, 1e6):
        for values in ((3, 2, 1), (3, 2, 0), (5, 0, 0), (1, 1, 1), (2, 2, 1), (2, 1, 1), (1, 1, 0), (1, 1 - 1e-6, 0.5), (0, 0, 0)):
            for turn in (np.eye(3), np.linalg.qr(rng.normal(size=(3, 3)))[0], np.array([[1, 1, 0], [-1, 1, 0], [0, 0, 2**0.5]]) / 2**0.5):
                made.append(scale * turn @ np.diag(values) @ turn.T)
    rows = [(i, *map(float, (m[0, 0], m[0, 1], m[0, 2], m[1, 1], m[1, 2], m[2, 2])), 9, 1.0) for i, m in enumerate(made)] + [(-1, *[None] * 6, 9, 1.0), (-2, 1.0, 0.0, 0.0, 1.0, 0.0, 1.0, 2, 1.0)]
    table = spark.createDataFrame(rows, "src int, cxx double, cxy double, cxz double, cyy double, cyz double, czz double, n int, a double")
    got = {r.src: r for r in principal_axes(table).collect()}
    assert principal_axes(table).columns == [*table.columns, "curvature", "nx", "ny", "nz"] and got[0].a == 1.0
    for i, m in enumerate(made):
        r, values = got[i], np.linalg.eigvalsh(m)
        axis, trace = np.array([r.nx, r.ny, r.nz]), max(np.trace(m), 1e-300)
        assert np.linalg.norm(axis) == pytest.approx(1) and np.linalg.norm(m @ axis - values[0] * axis) <= 1e-7 * trace
        assert r.curvature == pytest.approx(values[0] / trace if values.any() else 0.0, abs=1e-9)
        assert axis[np.flatnonzero(np.abs(axis) > 1e-9)[0]] > 0
    assert (got[-2].curvature, got[-2].nx, got[-2].nz) == (0, 0, 0) and got[-1].curvature == 0


def test_keyed_reports_equal_each_alone(spark):
    rng = np.random.default_rng(9)
    rows = [("a" if i % 3 else "b", int(rng.integers(0, 4)), int(rng.integers(1, 5))) for i in range(200)] + [("c", 1, 1), ("d", None, 2), ("e", 2, 0)]
    table = spark.createDataFrame(rows, "part string, label int, pred int")
    near = lambda values: tuple(round(v, 12) for v in values)
    got = {(r.part, r.name): near(tuple(r)[2:]) for r in metrics.reports_by(table, "part").collect()}
    for part in "abcde":
        alone = {r.name: near(tuple(r)[1:]) for r in metrics.report(table.where(F.col("part") == part)).collect()}
        assert {k[1]: v for k, v in got.items() if k[0] == part} == alone and (part != "d" or not alone)
    pairs = [(t, p) for part, t, p in rows if part == "a"]
    n = len(pairs)
    assert got["a", "accuracy"][0] == pytest.approx(sum(t == p for t, p in pairs) / n)
    for c in range(5):
        hit, named, support = (sum(f(t, p) for t, p in pairs) for f in (lambda t, p, c=c: t == p == c, lambda t, p, c=c: p == c, lambda t, p, c=c: t == c))
        assert got["a", str(c)][:2] == pytest.approx((hit / named if named else 0, hit / support if support else 0)) and got["a", str(c)][3] == support
    f1 = [got["a", str(c)][2] for c in range(5)]
    assert got["a", "macro avg"][2] == pytest.approx(np.mean(f1))
    assert got["a", "weighted avg"][2] == pytest.approx(sum(f * sum(t == c for t, _ in pairs) for c, f in enumerate(f1)) / n)
    counts = table.groupBy("part", "label", "pred").count()
    assert {(r.part, r.name): near(tuple(r)[2:]) for r in metrics.report(counts.withColumnRenamed("count", "n"), by=["part"], count="n").select("part", "name", "precision", "recall", "f1", "support").collect()} == got
    grid = {(r.part, r.truth, r.pred): r.n for r in metrics.confusion(table, by=["part"]).collect()}
    assert sum(n for (p, _, _), n in grid.items() if p == "a") == n and len([k for k in grid if k[0] == "a"]) == 25 and grid["e", 2, 0] == 1 and grid["e", 0, 0] == 0


def test_scanline_pairs_over_batches_and_widths(spark, monkeypatch):
    """Several widths in one pass, bounded pairs at a time and columns with the names of working ones give what each width gives alone."""
    from rangeloom.operators import neighbourhood

    rng = np.random.default_rng(10)
    rows = [(i % 3, i % 7, i, float(rng.normal()), float(rng.normal()), None if i % 50 == 0 else float(rng.normal()), float(rng.uniform(1, 9)), float(i), float(rng.normal()), "own") for i in range(500)]
    points = spark.createDataFrame(rows, "scan_id int, scanline_id long, point_counter long, x double, y double, z double, rho double, horiz_angle double, vert_angle double, _line string").repartition(4)
    monkeypatch.setattr(neighbourhood, "_PAIRS", 17)
    both = neighbourhood.with_scanline_features(points, {"0": F.lit(3), "1": F.col("point_counter") % 6})
    assert both.columns == [*points.columns, *[f"{v}{w}" for w in "01" for v in ("slope", "slope_lstsq", "roughness")]]
    monkeypatch.setattr(neighbourhood, "_PAIRS", 1 << 19)
    for w, width in (("0", F.lit(3)), ("1", F.col("point_counter") % 6)):
        alone = {r.point_counter: (r.slope, r.slope_lstsq, r.roughness) for r in neighbourhood.scanline_features(points, width).collect()}
        assert {r.point_counter: (r[f"slope{w}"], r[f"slope_lstsq{w}"], r[f"roughness{w}"]) for r in both.collect()} == alone and len(alone) == 500
    assert neighbourhood.with_scanline_features(points.limit(0), {"": F.lit(2)}).count() == 0


def test_nearest_in_uneven_clouds(spark):
    """A cell that holds a third of the points, equal points, lone ones, queries outside the cloud, and a scan of a few points."""
    rng = np.random.default_rng(11)
    xyz = np.concatenate([rng.uniform(0, 100, (200, 3)), 50 + rng.uniform(0, 0.05, (120, 3)), np.tile([[1.0, 2.0, 3.0]], (30, 1)), [[1e4, 0, 0]]])
    rows = [(0, i, *map(float, p)) for i, p in enumerate(xyz)] + [(1, 1000 + i, float(i), 0.0, 0.0) for i in range(3)] + [(0, 999, None, 0.0, 0.0)]
    asked = [(0, 5000, -500.0, 20.0, 30.0), (0, 5001, 2e4, 2e4, 0.0), (0, 5002, 50.02, 50.02, 50.02), (2, 5003, 0.0, 0.0, 0.0), (1, 5004, 9.0, 9.0, 9.0)]
    schema = "scan_id int, point_counter long, x double, y double, z double"
    points, queries = spark.createDataFrame(rows, schema).repartition(4), spark.createDataFrame(rows + asked, schema)
    got = {}
    for r in spatial.nearest(points, queries, 5).orderBy("scan_id", "src", "rank").collect():
        got.setdefault((r.scan_id, r.src), []).append((r["rank"], r.dst, r.dist))
    want = {}
    for scan, src, *q in rows + asked:
        own = [r for r in rows if r[0] == scan and r[2] is not None]
        if q[0] is not None and own:
            apart = sorted((float(np.sqrt(sum((a - b) ** 2 for a, b in zip(r[2:], q, strict=True)))), r[1] != src, r[1]) for r in own)[:5]
            want[scan, src] = [(i, dst, d) for i, (d, _, dst) in enumerate(apart)]
    assert {k: [x[:2] for x in v] for k, v in got.items()} == {k: [x[:2] for x in v] for k, v in want.items()}
    assert all(a[2] == pytest.approx(b[2]) for k in want for a, b in zip(got[k], want[k], strict=True))
    assert spatial.nearest(points, queries.limit(0), 5).count() == 0 and spatial.nearest(points.limit(0), queries, 5).count() == 0


def test_quantiles_of_large_groups(spark):
    """A group with most rows in many partitions, a value that half of a group shares, NaN, nulls, null keys and clashing names."""
    from rangeloom.operators.quantiles import quantiles

    rng = np.random.default_rng(12)
    rows = [("big", float(v), 1, 2) for v in rng.normal(size=700)] + [("ties", 7.0, 1, 2)] * 100 + [("ties", float(v), 1, 2) for v in rng.normal(7, 1, 99)]
    rows += [(None, float(v), 1, 2) for v in range(4)] + [("one", 3.0, 1, 2), ("none", None, 1, 2), ("nan", 1.0, 1, 2), ("nan", float("nan"), 1, 2)]
    table = spark.createDataFrame(rows, "v string, slot double, of int, n int").repartition(6)
    shares = {"lo": 0.02, "q1": 0.25, "mid": 0.5, "hi": 0.98, "top": 1.0}
    got = {r.v: tuple(r)[1:] for r in quantiles(table, ["v"], ["slot", "n"], shares).collect()}
    assert set(got) == {"big", "ties", None, "one", "none", "nan"} and got["none"] == (None,) * 5 + (2.0,) * 5
    for name in ("big", "ties", None, "one"):
        values = [r[1] for r in rows if r[0] == name]
        assert np.allclose(got[name][:5], np.percentile(values, [100 * p for p in shares.values()])) and got[name][5:] == (2.0,) * 5
    assert got["nan"][1] != got["nan"][1] or got["nan"][1] >= 1.0
    assert quantiles(table.limit(0), ["v"], ["slot"], shares).count() == 0
    whole = quantiles(table.where("slot is not null and not isnan(slot)"), [], ["slot"], {"mid": 0.5}).collect()
    assert [r.slot_mid for r in whole] == [np.median([r[1] for r in rows if r[1] is not None and r[1] == r[1]])]


def test_draws_have_no_period_and_take_any_key(spark):
    keys = [*range(20_000), 4 * 10**9, 2**62, -5]
    got = {r.k: r.part for r in labels.split_rows(spark.createDataFrame([(k,) for k in keys], "k long"), "k").collect()}
    test = [k for k in range(20_000) if got[k] == "test"]
    assert 3700 < len(test) < 4300 and len(set(np.diff(test))) > 15
    assert all(0.15 < sum(k % m == 0 for k in test) * m / 20_000 < 0.25 for m in (2, 3, 5, 8, 13)) and len(got) == len(keys)


@pytest.mark.parametrize("search", [lambda p: spatial.within_radius(p, p, 0.5), lambda p: spatial.nearest(p, p, 5), lambda p: spatial.covariances(p, spatial.within_radius(p, p, 0.5))], ids=["radius", "nearest", "covariances"])
def test_searches_broadcast_no_points(spark, tmp_path, search):
    at = [F.floor(F.col("id") / s % 20).cast("double") for s in (1, 20, 400)]
    spark.range(8000).select(F.lit(0).alias("scan_id"), F.col("id").alias("point_counter"), *[v.alias(c) for v, c in zip(at, "xyz", strict=True)]).write.parquet(str(tmp_path / "points"))
    points = spark.read.parquet(str(tmp_path / "points"))
    before = spark.conf.get("spark.sql.maxBroadcastTableSize", None)
    spark.conf.set("spark.sql.maxBroadcastTableSize", str(6 << 20))
    try:
        rows = search(points)
        assert rows.count() == 8000 * (5 if "rank" in rows.columns else 1)
        assert "BroadcastHashJoin" not in rows._jdf.queryExecution().executedPlan().toString()
    finally:
        if before is None:
            spark.conf.unset("spark.sql.maxBroadcastTableSize")
        else:
            spark.conf.set("spark.sql.maxBroadcastTableSize", before)


def test_moments_at_radii_equal_brute_force_and_make_no_pair_rows(spark, monkeypatch):
    rng = np.random.default_rng(8)
    xyz = np.round(rng.uniform(0, 6, (400, 3)), 2)
    rows = [(i % 2, i, *map(float, v)) for i, v in enumerate(xyz)] + [(0, 900, None, 1.0, 1.0), (0, 901, 1.0, float("nan"), 1.0)]
    table = spark.createDataFrame(rows, "scan_id long, point_counter long, x double, y double, z double")
    monkeypatch.setattr(spatial, "_TILE", 30)
    monkeypatch.setattr(spatial, "_AT_ONCE", 7)
    found = spatial._moments_within(table, (0.5, 2.0))
    got = {r.src: r for r in found.collect()}
    assert set(got) == set(range(400))
    for i in range(400):
        own = xyz[i % 2 :: 2]
        dist = np.sqrt(((own - xyz[i]) ** 2).sum(1))
        for k, radius in enumerate((0.5, 2.0)):
            near = own[dist < radius]
            r = got[i].asDict()
            assert r[f"r{k}n"] == len(near) and np.allclose([r[f"r{k}m{c}"] for c in "xyz"], near.mean(0), atol=1e-12)
            if len(near) > 1:
                cov = np.cov(near.T)
                assert np.allclose([r[f"r{k}c{a}{b}"] for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")], cov[np.triu_indices(3)], atol=1e-12)
    assert spatial.roughness_at_radii(table.limit(0), (0.5, 2.0)).count() == 0


def test_nearest_of_tiles(spark, monkeypatch):
    """Cells of more points than a tile holds, crowds of one place among them, have the nearest points of brute force."""
    rng = np.random.default_rng(5)
    at = np.concatenate([rng.uniform(0, 1, (300, 3)), np.full((60, 3), 0.5)]).round(3)
    points = spark.createDataFrame([(0, i, *map(float, v)) for i, v in enumerate(at)], "scan_id long, point_counter long, x double, y double, z double")
    monkeypatch.setattr(spatial, "_TILE", 16)
    rows = {(r.src, r["rank"]): (r.dst, r.dist) for r in spatial.nearest(points, points, 7).collect()}
    for i, v in enumerate(at):
        d = np.sqrt(((at - v) ** 2).sum(1))
        want = sorted(range(len(at)), key=lambda j: (d[j], j != i, j))[:7]
        assert [rows[i, r][0] for r in range(7)] == want
    assert len(rows) == 7 * len(at)


@pytest.mark.parametrize("crowd", [0, 80])
def test_vicinity_equals_brute_force(spark, monkeypatch, crowd):
    """Blocks, their borders, crowds of one place, points at the very radius, and gaps in coordinates and attributes."""
    rng = np.random.default_rng(6)
    at = np.concatenate([rng.integers(-20, 21, (500, 3)) / 10, np.full((crowd, 3), 0.3)])
    red = np.where(rng.uniform(size=len(at)) < 0.1, np.nan, rng.integers(0, 50, len(at)))
    rows = [(i % 2, i, *map(float, v), None if np.isnan(r) and i % 3 else float(r)) for i, (v, r) in enumerate(zip(at, red, strict=True))]
    rows += [(0, 9000, None, 0.0, 0.0, 1.0), (0, 9001, float("nan"), 0.0, 0.0, 1.0), (None, 9002, 0.0, 0.0, 0.0, 1.0), (5, 9003, 50.0, 50.0, 50.0, None)]
    table = spark.createDataFrame(rows, "scan_id long, point_counter long, x double, y double, z double, red double")
    monkeypatch.setattr(vicinity, "_BLOCK", 40)
    monkeypatch.setattr(vicinity, "_QUERIES", 64)
    for strict in (False, True):
        got = {r.src: r.asDict() for r in vicinity.around(table, table, 0.5, strict, True, ["red"]).collect()}
        assert set(got) == {*range(len(at)), 9003}
        for i, v in enumerate(at):
            mine = np.arange(i % 2, len(at), 2)
            square = ((at[mine] - v) ** 2)
            square = square[:, 0] + square[:, 1] + square[:, 2]
            near = mine[square < 0.25 if strict else square <= 0.25]
            r = got[i]
            assert r["n"] == len(near) and np.isclose(r["total"], np.sqrt(((at[near] - v) ** 2).sum(1)).sum())
            assert np.allclose([r[f"m{c}"] for c in "xyz"], at[near].mean(0), atol=1e-12)
            if len(near) > 1:
                assert np.allclose([r[f"c{c}"] for c in ("xx", "xy", "xz", "yy", "yz", "zz")], np.cov(at[near].T)[np.triu_indices(3)], atol=1e-12)
            else:
                assert r["cxx"] is None
            known = red[near][~np.isnan(red[near])]
            want = [known.mean(), known.std(), *np.percentile(known, [2, 25, 75, 98])] if len(known) else None
            found = [r[f"red_{s}"] for s in vicinity.STATISTICS]
            assert np.allclose(found, want) if want else found == [None] * 6
    assert got[9003]["n"] == 1 and got[9003]["red_mean"] is None
    assert vicinity.around(table.limit(0), table, 0.5).count() == 0


@pytest.mark.parametrize("name", ["neighbour_covariance", "neighbour_statistics", "radius_counts", "radius_counts_strict", "radius_curvature", "pca_normals", "surroundings"])
def test_no_pair_of_near_points_is_a_row(spark, data, monkeypatch, name):
    from rangeloom.plans import catalogue

    def pairs(*_, **__):
        raise AssertionError("pairs as rows")

    monkeypatch.setattr(spatial, "within_radius", pairs)
    assert catalogue.QUERIES[name](spark, data).columns


def test_snapping_and_few_queries_make_no_row_for_each_pair(spark, monkeypatch):
    """Points meet their own voxel's mean, and others only within the ball that is left; few queries count the cells around them only."""
    rng = np.random.default_rng(9)
    xyz = np.concatenate([rng.uniform(-3, 3, (900, 3)), [[2.0, 0.5, 0.5], [3.9, 0.5, 0.5], [1.999, 0.5, 1.0]]]).round(3)
    points = spark.createDataFrame([(i % 2, i, *map(float, v)) for i, v in enumerate(xyz)], "scan_id long, point_counter long, x double, y double, z double").cache()

    def pairs(*_, **__):
        raise AssertionError("pairs as rows")

    monkeypatch.setattr(spatial, "within_radius", pairs)
    for cells in (100_000, 0):
        monkeypatch.setattr(spatial, "_CELLS", cells)
        got = {(r.scan_id, r.vx, r.vy, r.vz): r.point_counter for r in spatial.snap_to_points(points, 2.0).collect()}
        assert len(got) == len({(i % 2, *np.floor(v / 2)) for i, v in enumerate(xyz)})
        for (scan, *cell), found in got.items():
            own = np.arange(scan, len(xyz), 2)
            mean = xyz[own][(np.floor(xyz[own] / 2) == cell).all(1)].mean(0)
            assert found == own[np.argmin(np.round(np.sqrt(((xyz[own] - mean) ** 2).sum(1)), 9))]
        queries = points.where("point_counter % 60 = 0").select("scan_id", "point_counter", *[(F.col(c) * 1.1 + 0.01).alias(c) for c in "xyz"])
        near = {}
        for r in spatial.nearest(points, queries, 5).collect():
            near.setdefault(r.src, []).append((r["rank"], r.dst))
        assert len(near) == queries.count()
        for i, found in near.items():
            own = np.arange(i % 2, len(xyz), 2)
            d = np.sqrt(((xyz[own] - (xyz[i] * 1.1 + 0.01)) ** 2).sum(1))
            assert [x for _, x in sorted(found)] == own[np.argsort(d, kind="stable")[:5]].tolist()
