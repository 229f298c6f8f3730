"""Global order without a single-task sort: dense row numbers and range buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from chronolake.runtime import materialize, width


def dense_row_numbers(df: DataFrame, order: list[Column], name: str) -> tuple[DataFrame, int]:
    """``df`` with a gapless 0-based ``name`` in the given total order, and the row count.

    One range shuffle, one sort inside partitions and one write to the shared folder;
    the position inside a partition comes from the sorted write, the offsets from one
    row a partition. Rows equal in ``order`` take neighbouring numbers; nulls come first
    if ``order`` says nothing else. An empty frame gives no rows and the count 0.
    """
    spark = df.sparkSession
    sorted_parts = df.repartitionByRange(width(spark), *order).sortWithinPartitions(*order)
    kept = materialize(sorted_parts.withColumn("__at", F.monotonically_increasing_id()), "rank")
    part = F.shiftright("__at", 33)
    per_part = kept.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    before = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    offsets = per_part.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    # one row a shuffle partition: bounded by the session's setting, not by the data
    out = kept.withColumn("__part", part).join(F.broadcast(offsets), "__part", "left")
    return out.withColumn(name, F.col("__before") + inside).drop("__at", "__part", "__before"), kept.count()


def range_bounds(df: DataFrame, key: str, parts: int) -> list[int]:
    """At most ``parts - 1`` ascending cut points of an integer ``key`` for even ranges."""
    if parts < 2:
        return []
    cuts = df.select(F.percentile_approx(key, [i / parts for i in range(1, parts)], 20 * parts).alias("c")).first()[0]
    return sorted(set(cuts or []))


def range_bucket(key: Column, bounds: list[int]) -> Column:
    """Number of bounds that are at most ``key``; 0 for null. Two array scans of square-root length."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    blocks = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    heads = F.array(*[F.lit(int(b[0])) for b in blocks])
    whole = F.array(*[F.array(*[F.lit(int(x)) for x in b]) for b in blocks])
    block = F.size(F.filter(heads, lambda h: h <= key))
    inside = F.size(F.filter(F.element_at(whole, block), lambda h: h <= key))
    return F.when(key.isNull() | (block == 0), F.lit(0)).otherwise((block - 1) * step + inside)
