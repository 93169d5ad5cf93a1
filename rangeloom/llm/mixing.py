"""Mixing sources to target weights by weighted fair queueing.

Every document of a source, in a fixed shuffled order, has a virtual finish
time: the words of its source up to its end divided by the source's target.
Further epochs of a source follow its first. All sources are merged by a global
range sort on that time and cut where the budget is spent. As finish times grow
along a source, the cut is one place per source, so the decision about a
document needs its own place in the shuffle and one row of its source.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rangeloom.llm.words import word_count
from rangeloom.operators.prefix import running_total
from rangeloom.operators.staging import stage

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3


def _place(id_col: str, text_col: str, size: Column) -> Column:
    """Where a document stands in the shuffle; rows that agree in id and text are peers."""
    name = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))
    return F.struct(F.md5(name).alias("shuffle"), size.alias("size"), F.xxhash64(F.col(f"`{text_col}`")).alias("text"))


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, rank, target) from rows (source, size).

    Sources share the whole size by weights, which repeat along the sources in
    code point order (null last). A target stops at ``max_epochs`` times its source; the
    excess is shared again among the others: the common level per unit of
    weight rises until no source passes its stop. One row per source.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("_one", F.lit(1))
    ranked = running_total(by_source, "_one", [F.col("source").asc_nulls_last()], "rank")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    table = stage(ranked.select("source", "source_size", "rank", weight.alias("weight"), (F.col("source_size") * max_epochs).alias("stop")), "sources")
    total = table.agg(F.sum("source_size")).first()[0] or 0
    level, held = 0.0, -1
    while True:
        full = F.col("weight") * F.lit(level) >= F.col("stop")
        spent, free, n = table.agg(F.sum(F.when(full, F.col("stop"))), F.sum(F.when(~full, F.col("weight"))), F.count(F.when(full, 1))).first()
        if n == held or not free:
            break
        level, held = (total - (spent or 0)) / free, n
    target = F.least(F.col("weight") * F.lit(level), F.col("stop").cast("double"))
    return table.select("source", "source_size", "rank", target.alias("target"))


def source_cuts(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: Sequence[float], max_epochs: int) -> DataFrame:
    """(source, source_size, target, epochs, last): documents up to place ``last`` are taken ``epochs`` times, later ones once less."""
    size = word_count(text_col)
    sizes = docs.select(F.col(f"`{source_col}`").alias("source"), size.alias("size"), _place(id_col, text_col, size).alias("place"))
    sizes = stage(sizes, "sizes")
    targets = stage(source_targets(sizes, weights, max_epochs), "targets")
    budget = targets.agg(F.sum("source_size")).first()[0] or 0
    queued = running_total(sizes, "size", [F.col("place")], "so_far", by=["source"])
    known = targets.withColumnRenamed("source", "_source")
    queued = queued.join(known, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    queued = stage(queued.select("source", "place", "size", "so_far", "source_size", "target", "rank"), "queued")

    def finish(epoch: Column | int) -> Column:
        words = (F.col("source_size") * epoch + F.col("so_far")).cast("double")
        return F.when(F.col("target") > 0, words / F.col("target")).otherwise(F.lit(0.0))

    turns = queued.where("size > 0").select("size", "source_size", "so_far", "target", "rank", F.explode(F.sequence(F.lit(0), F.lit(max_epochs - 1))).alias("epoch"))
    turns = turns.select(F.struct(finish(F.col("epoch")).alias("finish"), F.col("rank")).alias("at"), "size")
    merged = running_total(turns, "size", [F.col("at")], "spent")
    cut = merged.where(F.col("spent") <= budget).agg(F.max("at").alias("at")).first()["at"]
    if cut is None:
        times = F.lit(0)
    else:
        end = F.struct(F.lit(cut["finish"]).alias("finish"), F.lit(cut["rank"]).alias("rank"))
        times = sum(F.when(F.struct(finish(e).alias("finish"), F.col("rank")) <= end, 1).otherwise(0) for e in range(max_epochs))
    counted = queued.select("source", "source_size", "target", F.struct(times.alias("epochs"), F.col("place")).alias("reach"))
    return counted.groupBy("source").agg(F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.max("reach").alias("reach")).select(
        "source", "source_size", "target", F.col("reach.epochs").alias("epochs"), F.col("reach.place").alias("last")
    )


def _drawn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(row, mix_size, mix_source_size, mix_target, mix_times): each row of ``docs`` as a struct c0, c1, ..., with what ``mix`` tells about it."""
    cuts = stage(source_cuts(docs, id_col, text_col, source_col, weights, max_epochs), "cuts")
    cuts = cuts.select(*[F.col(c).alias(f"cut_{c}") for c in cuts.columns])
    size = word_count(text_col)
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
    met = docs.select(row.alias("row"), F.col(f"`{source_col}`").alias("source"), size.alias("mix_size"), _place(id_col, text_col, size).alias("place"))
    met = met.join(cuts, F.col("source").eqNullSafe(F.col("cut_source")), "left")
    late = F.when(F.col("place") > F.col("cut_last"), 1).otherwise(0)
    times = F.greatest(F.col("cut_epochs") - late, F.lit(0)).cast("int")
    return met.select("row", "mix_size", F.col("cut_source_size").alias("mix_source_size"), F.col("cut_target").alias("mix_target"), times.alias("mix_times"))


def mix(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with (mix_size, mix_source_size, mix_target, mix_times): how often the mixture takes each document.

    ``how``: id_col, text_col, source_col, weights, max_epochs. Size is the number of words (null text: 0); a null source is a source of its
    own. All sizes together are the budget; what a source is given comes within a
    document of its target. Repeated rows are peers and share one decision; an
    empty table gives an empty result. The shuffle depends on the id alone, so
    reruns agree. Extra columns are kept, those that have the names of the new ones are replaced; ``docs`` is read twice, for sizes and result.
    """
    new = ("mix_size", "mix_source_size", "mix_target", "mix_times")
    kept = [F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns) if c.lower() not in new]
    return _drawn(docs, **how).select(*kept, *new)


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The mixture itself: each row of ``docs``, whatever its columns, as often as it is taken."""
    drawn = _drawn(docs, **how).where("mix_times > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("mix_times"))).alias("turn"))
    return drawn.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)])
