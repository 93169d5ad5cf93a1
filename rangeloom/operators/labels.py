"""Labels: joins, recoding, weights and samples."""

from __future__ import annotations

import random
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def attach_labels(scan: DataFrame, labelled: DataFrame, keys: Sequence[str], order: str = "point_counter", label: str = "label") -> DataFrame:
    """``scan`` with the label of the first labelled row of equal keys, null keys matching; 0 where there is none."""
    first = labelled.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.min_by(label, F.struct(order, label)).alias("_label"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return scan.join(first, same, "left").select(*scan.columns, F.coalesce("_label", F.lit(0)).alias(label))


def unfold(points: DataFrame, predicted: DataFrame, keys: Sequence[str] = ("scan_id", "segment_id"), inner: bool = False) -> DataFrame:
    """Predictions of segments at their points; points without one get 0, or go if ``inner``."""
    p = predicted.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("predicted").alias("_p"))
    same = F.lit(True)
    for k in keys:
        same = same & (F.col(k) == F.col(f"_{k}"))
    return points.join(p, same, "inner" if inner else "left").select(*points.columns, F.coalesce("_p", F.lit(0)).alias("predicted"))


def drop_class(points: DataFrame, dropped: int, label: str = "label") -> DataFrame:
    """Rows of other classes, with ``code``: the rank of their label among those left, from 0."""
    left = points.where(F.col(label) != dropped)
    codes = left.select(F.col(label).alias("_l")).distinct().withColumn("code", (F.dense_rank().over(Window.orderBy("_l")) - 1).cast("int"))
    return left.join(codes, F.col(label) == F.col("_l")).drop("_l")


def class_weights(points: DataFrame, label: str = "label") -> DataFrame:
    """(label, n, weight): rows over classes times rows of the class."""
    counts = points.groupBy(label).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("_all"), F.count("*").alias("_classes"))
    return counts.crossJoin(F.broadcast(total)).select(label, "n", (F.col("_all") / (F.col("_classes") * F.col("n"))).alias("weight"))


def stratified_sample(points: DataFrame, strata: Sequence[str], most: int, order: Column, exact: bool = False) -> DataFrame:
    """At most ``most`` rows of each stratum by ``order``; with ``exact`` a smaller stratum is an error."""
    if exact:
        short = points.groupBy(*strata).count().where(F.col("count") < most).first()
        if short:
            raise ValueError(f"stratum with {short['count']} rows, {most} asked for")
    rank = F.row_number().over(Window.partitionBy(*strata).orderBy(order))
    return points.withColumn("_rank", rank).where(F.col("_rank") <= most).drop("_rank")


def row_weights(points: DataFrame, label: str = "label") -> DataFrame:
    """``points`` with the weight of their class."""
    w = class_weights(points, label).select(F.col(label).alias("_l"), "weight")
    return points.join(w, F.col(label).eqNullSafe(F.col("_l"))).drop("_l")


def drawn_share(key: Column, seed: int = 42) -> Column:
    """A fixed number from 0 to 1 for each key: the first eight hexadecimal digits of the md5 of seed and key, as DuckDB has them too. Null keys draw as if empty."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))


def split_rows(rows: DataFrame, key: str, share: float = 0.8, seed: int = 42) -> DataFrame:
    """``rows`` with ``part``: train for the given share of keys, test for the rest; reruns agree."""
    return rows.withColumn("part", F.when(drawn_share(F.col(key), seed) < share, "train").otherwise("test"))


def fold_pairs(files: Sequence, folds: int, seed: int = 42) -> list[tuple]:
    """Pairs of different files, one pair for each fold, in the order of a seeded shuffle; no file is in two pairs."""
    order = sorted(files)
    random.Random(seed).shuffle(order)
    if 2 * folds > len(order):
        raise ValueError(f"{folds} folds need {2 * folds} files")
    return [tuple(sorted(order[2 * i : 2 * i + 2])) for i in range(folds)]


def fold_roles(rows: DataFrame, file_col: str, pairs: Sequence[tuple]) -> DataFrame:
    """``rows`` once for each fold, with ``fold`` (from 1) and ``role``: test for the files of the fold's pair, train for all others."""
    held = F.when(F.lit(False), F.lit(False))
    folds = rows.withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(len(pairs)))))
    for i, pair in enumerate(pairs, 1):
        held = held.when(F.col("fold") == i, F.coalesce(F.col(file_col).isin(*pair), F.lit(False)))
    return folds.withColumn("role", F.when(held, "test").otherwise("train"))
