"""Aggregates: profiles, two-level and conditional aggregates, simplex pivots, circular means, bootstrap, regression sums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

MODULUS = 2_147_483_647


def sum0(x: Column | str) -> Column:
    """Sum in which nothing counts as 0."""
    return F.coalesce(F.sum(x), F.lit(0))


def ratio(num: Column, den: Column) -> Column:
    """Ratio of two sums; a zero or missing divisor gives null."""
    return F.try_divide(F.sum(num).cast("double"), F.sum(den).cast("double"))


def last_then_mean(df: DataFrame, outer: Sequence[str], inner: Sequence[str], order: Sequence[str], x: str, name: str) -> DataFrame:
    """Mean over the inner groups of the last non-null value of each."""
    last = df.where(F.col(x).isNotNull()).groupBy(*outer, *inner).agg(F.max_by(x, F.struct(*order)).alias("__x"))
    return last.groupBy(*outer).agg(F.avg("__x").alias(name))


def simplex(df: DataFrame, keys: Sequence[str], category: str, values: Sequence[str]) -> DataFrame:
    """Shares of the named categories of each key, one column each; they add up to 1. Keys without any have nulls."""
    counts = df.groupBy(*keys).agg(*[F.count_if(F.col(category) == v).alias(v) for v in values])
    total = sum((F.col(v) for v in values[1:]), F.col(values[0]))
    return counts.select(*keys, *[F.try_divide(F.col(v).cast("double"), total.cast("double")).alias(f"share_{v}") for v in values])


def circular(angle: Column, least: int, steady: float) -> tuple[Column, Column]:
    """Mean direction in degrees and resultant length; the direction is null below ``least`` angles or ``steady`` length."""
    s, c = F.avg(F.sin(F.radians(angle))), F.avg(F.cos(F.radians(angle)))
    length = F.sqrt(s * s + c * c)
    mean = F.pmod(F.degrees(F.atan2(s, c)), F.lit(360.0))
    return F.when((F.count(angle) >= least) & (length >= steady), mean), length


def profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row a numeric column: counts, moments (population), exact linear quantiles, skewness and excess kurtosis."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in columns])).alias("e")).select("e.*")
    x = F.when(~F.isnan("x"), F.col("x"))
    q = [F.percentile(x, p).alias(f"p{int(p * 100)}") for p in (0.05, 0.25, 0.5, 0.75, 0.95)]
    return long.groupBy("column").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(x.isNull()).alias("n_null"), F.count_if(x == 0).alias("n_zero"),
        F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.min(x).alias("lo"), F.max(x).alias("hi"), *q, F.skewness(x).alias("skew"), F.kurtosis(x).alias("kurt"),
    )


def top_values(df: DataFrame, columns: Sequence[str], k: int) -> DataFrame:
    """(column, value, n, place): the ``k`` most frequent values of each column, ties by value."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])).alias("e")).select("e.*")
    counts = long.where("value IS NOT NULL").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(W.partitionBy("column").orderBy(F.desc("n"), "value"))
    return counts.withColumn("place", place).where(F.col("place") <= k)


def winsorise(df: DataFrame, x: str, low: float, high: float, name: str) -> DataFrame:
    """``df`` with a value held between two of its exact quantiles; the quantiles are one broadcast row."""
    cut = df.agg(F.percentile(x, low).alias("__lo"), F.percentile(x, high).alias("__hi"))
    return df.join(F.broadcast(cut)).withColumn(name, F.greatest(F.least(F.col(x), F.col("__hi")), F.col("__lo"))).drop("__lo", "__hi")


def standardise(df: DataFrame, columns: Sequence[str], fit: Column | None = None) -> DataFrame:
    """``df`` with z-scores ``z_`` (null: 0) and presence ``m_``; mean and deviation (population) from the rows that ``fit`` names."""
    rows = df if fit is None else df.where(fit)
    stats = rows.agg(*[F.avg(c).alias(f"__m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"__s_{c}") for c in columns])
    z = lambda c: (F.col(c) - F.col(f"__m_{c}")) / F.when(F.col(f"__s_{c}") > 0, F.col(f"__s_{c}")).otherwise(1.0)
    wide = df.join(F.broadcast(stats))
    return wide.select(*df.columns, *[F.coalesce(z(c), F.lit(0.0)).alias(f"z_{c}") for c in columns], *[F.col(c).isNotNull().cast("int").alias(f"m_{c}") for c in columns])


def row_consensus(columns: Sequence[str]) -> tuple[Column, Column]:
    """Mean and sample deviation of a row's non-null values."""
    xs = F.filter(F.array(*[F.col(c).cast("double") for c in columns]), lambda v: v.isNotNull())
    n = F.size(xs)
    total = F.aggregate(xs, F.lit(0.0), lambda a, v: a + v)
    mean = F.try_divide(total, n.cast("double"))
    square = F.aggregate(xs, F.lit(0.0), lambda a, v: a + (v - mean) * (v - mean))
    return mean, F.when(n > 1, F.sqrt(square / (n - 1)))


def bootstrap_ratio(df: DataFrame, cluster: str, num: Column, den: Column, replicates: int, seed: int = 1) -> DataFrame:
    """One row: the ratio of two sums and its 95 % interval from replicates that draw whole clusters.

    Sums are taken per cluster first; each replicate draws a Poisson(1) weight for a cluster
    from a multiplicative hash of cluster and replicate, so a run can be repeated and nothing
    is collected.
    """
    per = df.groupBy(cluster).agg(F.sum(num).alias("num"), F.sum(den).alias("den"))
    each = per.withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    first = F.pmod((F.col(cluster).cast("long") + 1) * F.lit(48271) + F.col("b") * F.lit(69621) + seed, F.lit(MODULUS))
    second = F.pmod(F.pmod(first * F.lit(16807), F.lit(MODULUS)) * F.lit(48271), F.lit(MODULUS))
    u = second / F.lit(float(MODULUS))
    weight = F.lit(0)
    for cut in (0.36787944117, 0.73575888234, 0.91969860293, 0.98101184312, 0.99634015317, 0.99940581518, 0.99991675885):
        weight = weight + (u >= cut).cast("int")
    drawn = each.groupBy("b").agg(F.sum(weight * F.col("num")).alias("n"), F.sum(weight * F.col("den")).alias("d"))
    ratios = drawn.agg(F.percentile(F.try_divide("n", "d"), 0.025).alias("low"), F.percentile(F.try_divide("n", "d"), 0.975).alias("high"))
    return per.agg((F.sum("num") / F.sum("den")).alias("ratio")).join(F.broadcast(ratios))


def lag_regression(df: DataFrame, keys: Sequence[str], order: Sequence[str], x: str, weight: Column | None = None) -> DataFrame:
    """Weighted first-order autoregression of each key from sums over pairs of neighbouring rows: n, slope, intercept."""
    w = W.partitionBy(*keys).orderBy(*order)
    pairs = df.select(*keys, F.lag(x).over(w).alias("a"), F.col(x).alias("b"), (weight if weight is not None else F.lit(1.0)).alias("w")).where("a IS NOT NULL AND b IS NOT NULL")
    s = pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("sw"), F.sum(F.expr("w*a")).alias("sa"), F.sum(F.expr("w*b")).alias("sb"), F.sum(F.expr("w*a*a")).alias("saa"), F.sum(F.expr("w*a*b")).alias("sab"))
    slope = F.try_divide(F.expr("sw*sab - sa*sb"), F.expr("sw*saa - sa*sa"))
    return s.withColumn("slope", slope).withColumn("intercept", (F.col("sb") - F.col("slope") * F.col("sa")) / F.col("sw")).select(*keys, "n", "slope", "intercept")
