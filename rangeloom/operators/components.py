"""Connected components by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from rangeloom.operators.staging import release, stage


def _edges(rows: DataFrame) -> tuple[DataFrame, tuple]:
    """Different edges, staged, with their number and a sum over them, both taken while they are written."""
    seen = Observation()
    e = stage(rows.distinct().observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b") % 1_000_000_007).alias("sum")), "edges")
    return e, (seen.get["n"], seen.get["sum"])


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 100) -> DataFrame:
    """Rows (node, component) for every node that an edge touches.

    ``component`` is the smallest node reachable. Each round rewires every
    node's larger neighbours to its smallest one, then every node's smaller
    neighbours likewise; the number of edges never grows, and the rounds grow
    with the logarithm of the diameter, not with it. Per-node minima are
    partial aggregates. They are staged before they are joined back, so that a
    hub's rows can be split. Nulls and self loops are ignored, an empty edge
    table gives an empty result.
    """
    e, seen = _edges(edges.select(F.least(src, dst).alias("a"), F.greatest(src, dst).alias("b")).where("a is not null and b is not null and a < b"))
    for _ in range(max_rounds):
        if not seen[0]:
            break
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = stage(both.groupBy("u").agg(F.min("v").alias("m")).where("m < u"), "low")
        large = stage(e.join(low, F.col("a") == F.col("u"), "left").select(F.coalesce("m", "a").alias("a"), "b").distinct(), "large")
        release(e, low)
        low = stage(large.groupBy(F.col("b").alias("v")).agg(F.min("a").alias("m")), "small")
        rest = large.join(low, F.col("b") == F.col("v")).where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))
        e, now = _edges(rest.unionByName(low.select(F.col("m").alias("a"), F.col("v").alias("b"))))
        release(large, low)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components not settled after {max_rounds} rounds")
    return e.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(
        e.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    )
