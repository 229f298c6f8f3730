"""Connected components over an edge table, without collecting edges anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from chronolake.runtime import drop_materialized, materialize


def mark_of(edges: DataFrame) -> tuple:
    """Count and exclusive or of the hashes of distinct ``edges``: equal for equal sets, and no sum that overflows."""
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component): the smallest node that each node of ``edges`` can reach.

    Alternates large-star and small-star steps until the edges stop changing; the number of
    rounds grows with the logarithm of the component size. Every step is an aggregate and
    an equi-join, each round is written to the shared folder. Null ends and loops are
    ignored; nodes without edges do not appear. Empty edges give no rows.
    """
    kept = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = materialize(kept.distinct(), "edges")

    def star(e: DataFrame, large: bool) -> DataFrame:
        around = e.union(e.select("b", "a")) if large else e
        least = around.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")).withColumn("m", F.least("u", "m"))
        linked = around.join(least, around["a"] == least["u"])
        if large:
            return linked.where("b > u").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        same = linked.select(F.col("b").alias("a"), F.col("m").alias("b"))
        return same.union(least.select("u", "m")).toDF("a", "b").where("a <> b").distinct()

    mark = None
    while True:
        after = materialize(star(star(now, True), False), "edges")
        drop_materialized(now)
        now = after
        seen = mark_of(now)
        if seen == mark:
            break
        mark = seen
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return nodes.union(roots)
