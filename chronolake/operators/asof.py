"""As-of selections: the latest right row that a left row may know.

The right side is stacked on the left and the last right row is carried forward in one
sort per key: one exchange, no range join. Right rows with a null time never match; left
rows with a null time or no match get nulls. Of right rows with equal key and time the one
that is largest in ``tie`` (or in the payload) wins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F


def asof(
    left: DataFrame, right: DataFrame, on: Sequence[str], left_time: str, right_time: str, take: Sequence[str],
    strict: bool = False, stale: float | None = None, clamp: bool = False, prefix: str = "r_",
) -> DataFrame:
    """``left`` with ``take`` and the time of the last right row at or before (``strict``: before) the left time.

    ``on`` names the key columns of both sides. ``stale``: seconds after which a match is
    void. ``clamp``: a left row before all right rows takes the first one.
    """
    keys = [f"__k{i}" for i in range(len(on))]
    payload = F.struct(F.col(right_time).alias("time"), *[F.col(c).alias(c) for c in take])
    order = 1 if strict else 0
    lefts = left.select(*[F.col(k).alias(a) for k, a in zip(on, keys)], F.col(left_time).alias("__t"), F.lit(1 - order).alias("__side"), F.struct("*").alias("__l"))
    rights = right.where(F.col(right_time).isNotNull()).select(*[F.col(k).alias(a) for k, a in zip(on, keys)], F.col(right_time).alias("__t"), F.lit(order).alias("__side"), payload.alias("__r"))
    both = lefts.unionByName(rights, allowMissingColumns=True)
    w = W.partitionBy(*keys).orderBy("__t", "__side", F.col("__r"))
    carried = both.withColumn("__m", F.last("__r", True).over(w.rowsBetween(W.unboundedPreceding, 0)))
    if clamp:
        carried = carried.withColumn("__m", F.coalesce("__m", F.first("__r", True).over(w.rowsBetween(0, W.unboundedFollowing))))
    found = carried.where(F.col("__l").isNotNull() & F.col("__r").isNull())
    match = F.when(F.col("__t").isNotNull(), F.col("__m"))
    if stale is not None:
        age = F.unix_micros(F.col("__t").cast("timestamp")) - F.unix_micros(F.col("__m.time").cast("timestamp"))
        match = F.when(age <= int(stale * 1e6), match)
    found = found.withColumn("__m", match)
    return found.select("__l.*", F.col("__m.time").alias(f"{prefix}{right_time}"), *[F.col(f"__m.{c}").alias(f"{prefix}{c}") for c in take])


def nearest(left: DataFrame, right: DataFrame, on: Sequence[str], left_time: str, right_time: str, take: Sequence[str], seconds: int, prefix: str = "r_") -> DataFrame:
    """``left`` with the right row nearest in time within ``seconds``; ties take the earlier one.

    The best row at or before and the best one after come from two as-of passes.
    """
    back = asof(left, right, on, left_time, right_time, take, stale=seconds, prefix="__b_")
    flip = lambda df, c: df.withColumn(f"__n_{c}", -F.unix_micros(F.col(c).cast("timestamp")))
    ahead = asof(flip(back, left_time), flip(right, right_time), on, f"__n_{left_time}", f"__n_{right_time}", [right_time, *take], prefix="__a_")
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    gap_b = micros(left_time) - micros(f"__b_{right_time}")
    gap_a = micros(f"__a_{right_time}") - micros(left_time)
    near_a = F.when(gap_a <= seconds * 1_000_000, gap_a)
    use_b = gap_b.isNotNull() & (near_a.isNull() | (gap_b <= near_a))
    pick = [F.when(use_b, F.col(f"__b_{c}")).when(near_a.isNotNull(), F.col(f"__a_{c}")).alias(f"{prefix}{c}") for c in (right_time, *take)]
    return ahead.select(*left.columns, *pick)


def tagged(need: DataFrame) -> DataFrame:
    """The distinct rows of ``need`` with themselves as ``__id`` and how often they occur as ``__n``."""
    return need.groupBy(*need.columns).agg(F.count(F.lit(1)).alias("__n")).withColumn("__id", F.struct(*need.columns))


def repeated(df: DataFrame) -> DataFrame:
    return df.withColumn("__i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__n"))))


def freshest_issue(need: DataFrame, issues: DataFrame, on: Sequence[str], decision: str, available: str, issue: str, take: Sequence[str]) -> DataFrame:
    """For each row of ``need`` the freshest issue of its valid time (part of ``on``) that was available at the decision.

    An equi-join on keys and valid time bounds the pairs; the largest issue time wins, then the payload.
    Rows of ``need`` that are equal meet the issues once and come out as often as they went in.
    """
    pairs = tagged(need).join(issues, list(on), "left")
    known = F.when(F.col(available) <= F.col(decision), F.struct(F.col(issue), *[F.col(c) for c in take]))
    best = repeated(pairs.groupBy("__id", "__n").agg(F.max(known).alias("__m")))
    return best.select("__id.*", F.col(f"__m.{issue}").alias(issue), *[F.col(f"__m.{c}").alias(c) for c in take])


def best_source(need: DataFrame, reports: DataFrame, on: Sequence[str], hour: str, decision: str, valid: str, available: str, rank: str, take: Sequence[str]) -> DataFrame:
    """For each (key, hour, decision) the report within an hour of it that was available: lowest rank, then latest.

    Reports are dealt to the two hours whose window they fall in, so the join is on equal hours.
    """
    floor = F.date_trunc("hour", F.col(valid))
    spread = reports.withColumn("__h", F.explode(F.array(floor, floor + F.expr("INTERVAL 1 HOUR")))).withColumnsRenamed({k: f"__o_{k}" for k in on})
    cond = (F.col(hour) == F.col("__h")) & (F.col(available) <= F.col(decision))
    for k in on:
        cond = cond & (F.col(k) == F.col(f"__o_{k}"))
    pairs = tagged(need).join(spread, cond, "left")
    order = F.struct((-F.col(rank)).alias("r"), F.col(valid).alias("v"), *[F.col(c).alias(c) for c in take])
    best = repeated(pairs.groupBy("__id", "__n").agg(F.max(F.when(F.col(rank).isNotNull(), order)).alias("__m")))
    return best.select("__id.*", (-F.col("__m.r")).alias(rank), F.col("__m.v").alias(valid), *[F.col(f"__m.{c}").alias(c) for c in take])


def lagged(left: DataFrame, right: DataFrame, on: Sequence[str], time: str, days: int, take: Sequence[str]) -> DataFrame:
    """``left`` with the right values of exactly ``days`` days before; the right key is moved, the join stays an equi-join."""
    moved = right.select(*on, F.date_add(F.col(time), days).alias(time), *[F.col(c).alias(f"lag_{c}") for c in take])
    return left.join(moved, [*on, time], "left")
