"""Flags, rates and summaries of event rows inside a contest: contact quality, direction, fatigue, exposure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def barrel(speed: Column, angle: Column) -> Column:
    """Whether contact is in the speed-dependent band of angles: from 98 on, two degrees wider either way for each unit of speed."""
    low = F.greatest(F.lit(8.0), F.least(F.lit(26.0), 26 - 2 * (speed - 98)))
    high = F.greatest(F.lit(30.0), F.least(F.lit(50.0), 30 + 2 * (speed - 98)))
    return (speed >= 98) & angle.between(low, high)


def spray(x: Column, y: Column, right_handed: Column, home: tuple[float, float] = (125.0, 200.0), half: float = 15.0) -> Column:
    """pull, center or oppo by the angle from the home point; the y axis points down."""
    angle = F.degrees(F.atan2(x - home[0], home[1] - y))
    return F.when(angle.between(-half, half), "center").when((angle < 0) == right_handed, "pull").otherwise("oppo")


def shares(df: DataFrame, keys: list[str], flags: dict[str, Column]) -> DataFrame:
    """The mean of each flag per key; rows where a flag is null do not count for it."""
    return df.groupBy(*keys).agg(*[F.avg(f.cast("int")).alias(n) for n, f in flags.items()])


def ratio(part: Column, whole: Column) -> Column:
    """Rows with ``part`` among those with ``whole``, null without any."""
    return F.try_divide(F.sum((part & whole).cast("int")), F.sum(whole.cast("int")))


def fatigue(df: DataFrame, keys: list[str], order: list[str], value: str, early: int, late: int) -> DataFrame:
    """Mean of ``value`` from place ``late`` on less that up to place ``early`` of each key, its sample deviation, and the rows."""
    placed = df.withColumn("__p", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    mean = lambda c: F.avg(F.when(c, F.col(value)))
    return placed.groupBy(*keys).agg((mean(F.col("__p") >= late) - mean(F.col("__p") <= early)).alias("decay"), F.stddev_samp(value).alias("deviation"), F.count(F.lit(1)).alias("n"))


def first_where(df: DataFrame, keys: list[str], flag: Column, order: list[Column], take: list[str]) -> DataFrame:
    """One row a key: the first flagged one in order, else the first of all."""
    best = F.min_by(F.struct(*take), F.struct((~F.coalesce(flag, F.lit(False))).alias("no"), *order))
    return df.groupBy(*keys).agg(best.alias("__b")).select(*keys, "__b.*")


def summed_map(df: DataFrame, keys: list[str], sums: list[str], means: list[str]) -> DataFrame:
    """Sums and means of columns that exist; names that do not exist are passed over."""
    have = set(df.columns)
    return df.groupBy(*keys).agg(*[F.sum(c).alias(f"{c}_sum") for c in sums if c in have], *[F.avg(c).alias(f"{c}_mean") for c in means if c in have])


def net_exposure(items: DataFrame, event: str, market: str, cost: Column) -> DataFrame:
    """(event, cost, exposure): cost less one for each further market of the event that must pay, never below 0."""
    agg = items.groupBy(event).agg(F.sum(cost).alias("cost"), F.countDistinct(market).alias("m"), F.count(F.lit(1)).alias("n"))
    held = F.when((F.col("n") < 2) | (F.col("m") < 2), F.col("cost")).otherwise(F.greatest(F.lit(0.0), F.col("cost") - F.least(F.col("m") - 1, F.col("n") - 1)))
    return agg.select(event, "cost", held.alias("exposure"))


def box_line(hits: Column, doubles: Column, triples: Column, homers: Column) -> dict[str, Column]:
    """Singles (not below 0) and total bases."""
    singles = F.greatest(hits - doubles - triples - homers, F.lit(0))
    return {"singles": singles, "total_bases": singles + 2 * doubles + 3 * triples + 4 * homers}
