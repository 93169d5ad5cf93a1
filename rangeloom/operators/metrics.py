"""Scores of predictions, all from counts per (truth, prediction)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _share(a: str | Column, b: Column) -> Column:
    """a over b, 0 where b is 0."""
    return F.coalesce((F.col(a) if isinstance(a, str) else a) / F.nullif(b, F.lit(0)), F.lit(0.0))


def confusion(rows: DataFrame, truth: str = "label", predicted: str = "pred", by: Sequence[str] = ()) -> DataFrame:
    """(by, truth, pred, n, share) over the union of both label sets of each key, rows without any count included; share is of the truth's row, to 4 places.

    Counts are the only thing that is shuffled. The labels of a key, which are few, come together in one row, and each truth is widened to them. A null label is in neither set.
    """
    keys = [F.col(f"`{c}`") for c in by] or [F.lit(0).alias("_all")]
    counts = rows.groupBy(*keys, F.col(truth).cast("int").alias("truth"), F.col(predicted).cast("int").alias("pred")).agg(F.count("*").alias("n"))
    names = list(by) or ["_all"]
    both = F.array_sort(F.array_union(F.collect_set("truth"), F.collect_set("pred")))
    wide = counts.groupBy(*names).agg(both.alias("_labels"), F.collect_list(F.struct("truth", "pred", "n")).alias("_cells"))
    each = wide.select(*names, "_labels", "_cells", F.explode("_labels").alias("truth"))
    each = each.select(*names, "truth", "_labels", F.map_from_entries(F.transform(F.filter("_cells", lambda c: (c["truth"] == F.col("truth")) & c["pred"].isNotNull()), lambda c: F.struct(c["pred"], c["n"]))).alias("_row"))
    cells = each.select(*names, "truth", "_row", F.aggregate(F.map_values("_row"), F.lit(0).cast("long"), lambda s, n: s + n).alias("_sum"), F.explode("_labels").alias("pred"))
    n = F.coalesce(F.element_at("_row", F.col("pred")), F.lit(0).cast("long"))
    return cells.select(*by, "truth", "pred", n.alias("n"), F.round(_share(n, F.col("_sum")), 4).alias("share"))


def report(rows: DataFrame, truth: str = "label", predicted: str = "pred", by: Sequence[str] = (), count: str | None = None) -> DataFrame:
    """(by, name, precision, recall, f1, support) of each class, then accuracy, macro avg and weighted avg of each key; undefined scores are 0.

    ``count`` names a column of how often a row counts. ``rows`` are read once: one keyed table of counts, a row for each class in it, and grouping sets that sum the classes up.
    """
    counts = rows.groupBy(*by, F.col(truth).cast("int").alias("_t"), F.col(predicted).cast("int").alias("_p")).agg((F.sum(count) if count else F.count("*")).alias("_c")).where("_t is not null and _p is not null")
    sides = F.explode(F.array(F.struct(F.col("_t").alias("class"), F.col("_c").alias("support"), F.lit(0).cast("long").alias("named")), F.struct(F.col("_p").alias("class"), F.lit(0).cast("long").alias("support"), F.col("_c").alias("named"))))
    met = counts.select(*by, sides.alias("_side"), F.when(F.col("_t") == F.col("_p"), F.col("_c")).otherwise(0).alias("_hit"))
    per = met.groupBy(*by, F.col("_side.class").alias("class")).agg(F.sum("_side.support").alias("support"), F.sum("_side.named").alias("named"), (F.sum("_hit") / 2).cast("long").alias("hit"))
    per = per.select(*by, "class", "support", "hit", _share("hit", F.col("named")).alias("precision"), _share("hit", F.col("support")).alias("recall"))
    per = per.withColumn("f1", _share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    scores = ("precision", "recall", "f1")
    # A class is a group of one row, all classes of a key are the other.
    sums = per.groupingSets([[*[F.col(c) for c in by], F.col("class")], [F.col(c) for c in by]], *by, "class").agg(
        F.grouping("class").alias("_whole"), F.sum("support").alias("support"), F.sum("hit").alias("_hit"), *[F.avg(s).alias(s) for s in scores], *[F.sum(F.col("support") * F.col(s)).alias(f"_{s}") for s in scores]
    )
    line = lambda name, *values: F.struct(name.alias("name"), *[v.alias(s) for s, v in zip(scores, values, strict=True)])
    accuracy = _share("_hit", F.col("support"))
    totals = F.array(line(F.lit("accuracy"), accuracy, accuracy, accuracy), line(F.lit("macro avg"), *map(F.col, scores)), line(F.lit("weighted avg"), *[_share(f"_{s}", F.col("support")) for s in scores]))
    lines = F.when(F.col("_whole") == 0, F.array(line(F.col("class").cast("string"), *map(F.col, scores)))).when(F.col("support") > 0, totals)
    return sums.select(*by, "support", F.explode(lines).alias("_line")).select(*by, "_line.*", "support")


def summed(confusions: DataFrame) -> DataFrame:
    """(truth, pred, n, share) of the sum of several matrices (truth, pred, n)."""
    total = confusions.groupBy("truth", "pred").agg(F.sum("n").cast("long").alias("n"))
    row = F.sum("n").over(Window.partitionBy("truth"))
    return total.select("truth", "pred", "n", F.round(F.coalesce(F.col("n") / F.nullif(row, F.lit(0)), F.lit(0.0)), 4).alias("share"))


def union_reports(reports: dict[str, DataFrame], name: str) -> DataFrame:
    """Rows of all reports with what each is of as column ``name``."""
    return reduce(DataFrame.unionByName, [r.withColumn(name, F.lit(k)) for k, r in reports.items()])


def reports_by(rows: DataFrame, key: str, truth: str = "label", predicted: str = "pred") -> DataFrame:
    """A report for each value of a column, all from one table of counts; the value as text."""
    return report(rows, truth, predicted, by=[key]).withColumn(key, F.col(key).cast("string"))


def reports_of(tables: dict[str, DataFrame], name: str, truth: str = "label", predicted: str = "pred") -> DataFrame:
    """A report for each of several tables, with its name as column ``name``; every table is read once."""
    rows = [t.select(F.lit(k).alias(name), F.col(truth).cast("int").alias("_truth"), F.col(predicted).cast("int").alias("_told")) for k, t in tables.items()]
    return report(reduce(DataFrame.unionByName, rows), "_truth", "_told", by=[name])


def mean_percentage_error(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """(n, mape): mean of the error's share of the truth, in percent, over the rows whose truth is not 0."""
    share = F.abs(F.col(predicted) - F.col(truth)) / F.abs(F.nullif(F.col(truth).cast("double"), F.lit(0.0)))
    return rows.agg(F.count(share).alias("n"), (100 * F.avg(share)).alias("mape"))
