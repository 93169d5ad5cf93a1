"""The booster against a brute-force one, and many runs against each alone."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from rangeloom.operators import boosting
from rangeloom.operators.boosting import Run


def table_of(spark, n=200, seed=3):
    """Rows whose class depends on two of four features, with missing values, weights and files."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        x = [float(v) for v in rng.normal(size=4)]
        label = int(x[0] > 0.3) + int(x[1] + 0.4 * rng.normal() > 0)
        x[2] = float(round(x[2]))
        values = [None if rng.random() < 0.05 else float("nan") if rng.random() < 0.03 else v for v in x]
        rows.append((i, *values, [2, 5, 7][label], float(rng.uniform(0.5, 2)), "abcd"[i % 4]))
    rows += [(n, *x, None, 1.0, "a") for x in [[0.0] * 4]] + [(n + 1, 0.0, 0.0, 0.0, 0.0, 5, 0.0, "b")]
    return spark.createDataFrame(rows, "id int, p double, q double, r double, s double, label int, weight double, file string"), rows


def brute(rows, edges, names, run, classes):
    """Trees of one run by plain loops, as {(round, class): {node: (feature, bin) or value}}."""
    keep = [r for r in rows if r[5] is not None and r[6] > 0 and r[7] not in run.without_files and r[5] not in run.without_classes]
    known = [c for c in classes if c not in run.without_classes]
    bins = [[0 if v is None or v != v else 1 + sum(e < v for e in edges[i]) for i, v in enumerate(r[1:5])] for r in keep]
    margins = np.zeros((len(keep), len(known)))
    out = {}
    for t in range(run.rounds):
        p = np.exp(margins)
        p /= p.sum(1, keepdims=True)
        step = np.zeros_like(margins)
        for k, c in enumerate(known):
            g = np.array([(p[i, k] - (r[5] == c)) * r[6] for i, r in enumerate(keep)])
            h = np.array([2 * p[i, k] * (1 - p[i, k]) * r[6] for i, r in enumerate(keep)])
            nodes, tree = {0: list(range(len(keep)))}, {}
            for level in range(run.depth + 1):
                for at in [n for n in nodes if 2**level - 1 <= n < 2 ** (level + 1) - 1]:
                    own = nodes[at]
                    G, H = g[own].sum(), h[own].sum()
                    best = None
                    for f, name in enumerate(names):
                        if level == run.depth or (run.features and name not in run.features):
                            continue
                        for b in sorted({bins[i][f] for i in own}):
                            left = [i for i in own if bins[i][f] <= b]
                            gl, hl = g[left].sum(), h[left].sum()
                            gain = gl**2 / (hl + run.ridge) + (G - gl) ** 2 / (H - hl + run.ridge) - G**2 / (H + run.ridge)
                            if hl >= run.least_weight and H - hl >= run.least_weight and gain > 1e-6 and gain >= run.least_gain and (best is None or gain > best[0] + 1e-12):
                                best = (gain, f, b)
                    if best:
                        tree[at] = best[1:]
                        nodes[2 * at + 1] = [i for i in own if bins[i][best[1]] <= best[2]]
                        nodes[2 * at + 2] = [i for i in own if bins[i][best[1]] > best[2]]
                    else:
                        tree[at] = -run.rate * G / (H + run.ridge)
                        step[own, k] = tree[at]
            out[t, c] = tree
        margins += step
    return out, known, margins, keep


RUNS = (
    Run("plain", rounds=3, depth=3, rate=0.4, least_gain=0.5), Run("deep", rounds=2, depth=4, rate=0.1, least_gain=0.0, least_weight=0.2, ridge=0.5), Run("few", rounds=3, depth=2, features=("q", "r"), least_gain=0.0),
    Run("class", rounds=2, depth=2, without_classes=(5,), least_gain=0.0), Run("file", rounds=3, depth=2, without_files=("a", "c"), least_gain=2.0),
)


@pytest.mark.parametrize("kept_rounds", [1, 8])
def test_all_runs_equal_brute_force(spark, kept_rounds, monkeypatch):
    monkeypatch.setattr(boosting, "KEPT_ROUNDS", kept_rounds)
    table, rows = table_of(spark)
    names = ("p", "q", "r", "s")
    model = boosting.fit_boosted(table.repartition(3), names, RUNS, weight="weight", file_col="file", bins=8)
    assert model.classes == (2, 5, 7) and all(len(e) <= 7 for e in model.edges)
    for r, run in enumerate(RUNS):
        want, known, margins, keep = brute(rows, model.edges, names, run, model.classes)
        for (t, c), tree in want.items():
            got = model.rounds[t][r, model.classes.index(c)]
            for at, what in tree.items():
                if isinstance(what, tuple):
                    assert (got.feature[at], got.last[at]) == what, (run.name, t, c, at)
                else:
                    assert got.feature[at] == -1 and got.value[at] == pytest.approx(what, abs=1e-9), (run.name, t, c, at)
        told = {x.id: x.predicted for x in boosting.predict_boosted(model, table, r).collect()}
        assert all(told[row[0]] == known[int(np.argmax(m))] for row, m in zip(keep, margins, strict=True))


def test_runs_are_counted_in_one_pass(spark):
    table, _ = table_of(spark)
    model = boosting.fit_boosted(table, ("p", "q", "r", "s"), RUNS, weight="weight", file_col="file", bins=8)
    tested = [None, ("b",), None, None, ("a", "c")]
    got = {(x.run, x.rounds, x.label, x.pred): x.n for x in boosting.run_counts(model, table, file_col="file", tested=tested).collect()}
    for r, run in enumerate(RUNS):
        rows = boosting.predict_boosted(model, table, r).where("label is not null")
        rows = rows.where(~F.col("label").isin(*run.without_classes)) if run.without_classes else rows
        rows = rows.where(F.col("file").isin(*tested[r])) if tested[r] else rows
        assert {(r, run.rounds, x.label, x.predicted): x["count"] for x in rows.groupBy("label", "predicted").count().collect()} == {k: v for k, v in got.items() if k[0] == r}
    early = boosting.fit_boosted(table, ("p", "q", "r", "s"), [Run("plain", rounds=2, depth=3, rate=0.4)], weight="weight", bins=8)
    two = {(x.label, x.pred): x.n for x in boosting.run_counts(model, table, rounds=[2, 9]).where("run = 0 and rounds = 2").collect()}
    assert two == {(x.label, x.pred): x.n for x in boosting.run_counts(early, table).collect()}


def test_more_runs_take_no_more_jobs(spark):
    table, _ = table_of(spark)
    jobs = []
    for n in (1, 12):
        group = f"runs-{n}"
        spark.sparkContext.setJobGroup(group, group)
        boosting.fit_boosted(table, ("p", "q", "r", "s"), [Run(str(i), rounds=2, depth=2) for i in range(n)], bins=8)
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)))
    spark.sparkContext.setJobGroup("rest", "rest")
    assert jobs[0] == jobs[1]


def test_odd_tables(spark):
    table, _ = table_of(spark)
    clash = table.withColumnRenamed("p", "f0").withColumn("margins", F.lit("x")).withColumn("PREDICTED", F.lit(9))
    model = boosting.fit_boosted(clash, ("f0", "q"), [Run("one", rounds=1, depth=2)], bins=4)
    out = boosting.predict_boosted(model, clash)
    assert out.columns == [c for c in clash.columns if c != "PREDICTED"] + ["predicted"] and out.count() == table.count()
    for empty in (table.limit(0), table.where("label is null")):
        none = boosting.fit_boosted(empty, ("p", "q"), [Run("one", rounds=1, depth=2)])
        assert {r.predicted for r in boosting.predict_boosted(none, table).collect()} == {0}
    assert boosting.run_counts(model, clash.limit(0)).count() == 0
