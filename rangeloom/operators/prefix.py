"""Running totals and neighbours along a global order without a single-task window.

Rows are range-partitioned on key and order, so a key that holds a third of all rows spreads over many
partitions. What a partition needs to know of the others is one row per partition and key.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rangeloom.operators.names import fresh
from rangeloom.operators.staging import shuffle_partitions, stage


def ranged(df: DataFrame, order: Sequence[Column], by: Sequence[str] = (), slot: str = "_slot") -> DataFrame:
    """``df`` range-partitioned by key and order and staged, with the partition's number as ``slot``."""
    keys = [F.col(f"`{c}`") for c in by]
    return stage(df.repartitionByRange(shuffle_partitions(df.sparkSession), *keys, *order).withColumn(slot, F.spark_partition_id()), "ranged")


def _of_slot(columns: Sequence[str], slot: str, by: Sequence[str]) -> tuple[list[Column], Column, list[str]]:
    """Columns that name a slot and its keys so that no column of ``columns`` is hidden, the condition that a row belongs there, and the names."""
    names = fresh(columns, "_s", *[f"_k{i}" for i in range(len(by))])
    same = F.col(slot) == F.col(names[0])
    for c, k in zip(by, names[1:], strict=True):
        same = same & F.col(f"`{c}`").eqNullSafe(F.col(k))
    return [F.col(f"`{c}`").alias(n) for c, n in zip((slot, *by), names, strict=True)], same, list(names)


def running_totals(df: DataFrame, values: Mapping[str, Column | str], order: Sequence[Column], by: Sequence[str] = (), slot: str | None = None) -> DataFrame:
    """``df`` with an inclusive running sum of each of ``values`` (result column: what is summed) in ``order``, restarted for each ``by`` key.

    All counters come from one range sort. Each partition's sums per key form a table of at most partitions + keys rows; its running totals are
    the offsets that the rows of a partition start from. ``order`` should be total up to rows that are interchangeable. A null value counts as zero, null
    keys form one group, an empty table gives an empty result. ``slot`` names the column of a table that ``ranged`` has made in this order; it is dropped.
    """
    keys = [F.col(f"`{c}`") for c in by]
    if slot is None:
        (slot,) = fresh(df.columns, "_total_slot")
        df = ranged(df, order, by, slot)
    summed = {c: F.coalesce(F.col(v) if isinstance(v, str) else v, F.lit(0)) for c, v in values.items()}
    names, same, used = _of_slot([*df.columns, *values], slot, by)
    (base,) = fresh([*df.columns, *used, *values], "_base")
    sums = df.groupBy(slot, *keys).agg(*[F.sum(v).alias(f"{base}{i}") for i, v in enumerate(summed.values())])
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(slot).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*names, F.array(*[F.coalesce(F.sum(f"{base}{i}").over(before), F.lit(0)) for i in range(len(values))]).alias(base))
    inside = Window.partitionBy(slot, *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    kept = [F.col(f"`{c}`") for c in df.columns if c not in values and c != slot]
    local = df.select(*kept, slot, *[F.sum(v).over(inside).alias(c) for c, v in summed.items()])
    joined = local.join(stage(offsets, "offsets"), same)
    return joined.select(*kept, *[(F.col(c) + F.col(base)[i]).alias(c) for i, c in enumerate(values)])


def running_total(df: DataFrame, value: str, order: Sequence[Column], out: str, by: Sequence[str] = (), slot: str | None = None) -> DataFrame:
    """``running_totals`` of one column."""
    return running_totals(df, {out: value}, order, by, slot)


def with_neighbours(df: DataFrame, value: str, order: Sequence[str], before: str, after: str, by: Sequence[str] = (), slot: str = "_slot") -> DataFrame:
    """``df``, which ``ranged`` has made in this total order, with ``value`` of the row before and after each row of its key; null at the ends."""
    keys = [F.col(f"`{c}`") for c in by]
    names, same, used = _of_slot([*df.columns, before, after], slot, by)
    held, place = F.struct(F.col(value).alias("v")), F.struct(*order)
    prior, later = fresh([*df.columns, *used, before, after], "_before", "_after")
    ends = df.groupBy(slot, *keys).agg(F.min_by(held, place).alias("_first"), F.max_by(held, place).alias("_last"))
    across = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(slot)
    ends = stage(ends.select(*names, F.lag("_last").over(across).alias(prior), F.lead("_first").over(across).alias(later)), "slot-ends")
    inside = Window.partitionBy(slot, *keys).orderBy(*order)
    local = df.withColumns({before: F.lag(held).over(inside), after: F.lead(held).over(inside)})
    met = local.join(ends, same).withColumns({before: F.coalesce(before, prior)["v"], after: F.coalesce(after, later)["v"]})
    return met.drop(prior, later, *used)
