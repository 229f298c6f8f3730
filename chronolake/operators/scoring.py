"""Scores against baselines, weights of folds, blends with missing members, paired comparisons, concordance."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def brier_skill(df: DataFrame, p: str, y: str, market: str) -> DataFrame:
    """One row: Brier scores of prediction, market and base rate, and the skill against either."""
    sums = df.agg(F.avg(F.pow(F.col(p) - F.col(y), 2)).alias("model"), F.avg(F.pow(F.col(market) - F.col(y), 2)).alias("market"), (F.avg(y) * (1 - F.avg(y))).alias("base"), F.count(F.lit(1)).alias("n"))
    return sums.select("n", "model", "market", "base", (1 - F.try_divide("model", "market")).alias("skill_market"), (1 - F.try_divide("model", "base")).alias("skill_base"))


def recency_mean(folds: DataFrame, season: str, metrics: list[str]) -> DataFrame:
    """One row: means weighted by the fold's place between the first and the last season, plus a tenth."""
    bounds = folds.agg(F.min(season).alias("__a"), F.greatest(F.max(season) - F.min(season), F.lit(1)).alias("__s"))
    w = (F.col(season) - F.col("__a")) / F.col("__s") + 0.1
    return folds.join(F.broadcast(bounds)).agg(*[(F.sum(F.col(m) * w) / F.sum(w)).alias(m) for m in metrics])


def blended(members: list[tuple[Column, float]], most_missing: float = 0.3) -> Column:
    """Weighted mean over the members that are known, weights scaled up again; null if over that share of members is missing."""
    known = [F.when(c.isNotNull(), F.lit(float(w))).otherwise(0.0) for c, w in members]
    total = reduce(lambda a, b: a + b, known)
    parts = reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0.0)) * w for c, w in members])
    missing = reduce(lambda a, b: a + b, [c.isNull().cast("int") for c, _ in members]) / len(members)
    return F.when((missing <= most_missing) & (total > 0), parts / total)


def sided(p: Column, auc: Column, low: float = 0.49, high: float = 0.51) -> Column:
    """A signal turned round if its AUC is below a half; null in the dead zone between."""
    return F.when(auc > high, p).when(auc < low, 1 - p)


def paired(a: DataFrame, b: DataFrame, on: str, pa: str, pb: str, y: str) -> DataFrame:
    """One row: squared errors of two predictions on the ids that both have, and how often the first is nearer."""
    both = a.join(b, on)
    ea, eb = F.abs(F.col(pa) - F.col(y)), F.abs(F.col(pb) - F.col(y))
    return both.agg(F.count(F.lit(1)).alias("n"), F.avg(ea * ea).alias("a"), F.avg(eb * eb).alias("b"), F.avg((ea < eb).cast("int")).alias("a_wins"))


def concordance(df: DataFrame, group: str, rank: str, x: str, y: str) -> DataFrame:
    """Kendall's tau-a per group from all pairs of its rows; for small groups (a season, a panel of features)."""
    a, b = df.select(group, rank, F.col(x).alias("x1"), F.col(y).alias("y1")), df.select(group, F.col(rank).alias("__r"), F.col(x).alias("x2"), F.col(y).alias("y2"))
    pairs = a.join(b, group).where(F.col(rank) < F.col("__r"))
    return pairs.groupBy(group).agg(F.avg(F.signum(F.col("x1") - F.col("x2")) * F.signum(F.col("y1") - F.col("y2"))).alias("tau"))


def sign_changes(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """(key, n, mean, cv, oscillation): spread of a value over its folds and the share of steps that turn back."""
    w = W.partitionBy(key).orderBy(order)
    step = df.withColumn("__d", F.col(value) - F.lag(value).over(w))
    turn = step.withColumn("__t", F.signum("__d") * F.signum(F.lag("__d").over(w)) < 0)
    return turn.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.try_divide(F.stddev_samp(value), F.abs(F.avg(value))).alias("cv"), F.avg(F.col("__t").cast("int")).alias("oscillation"))


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, r) of every pair of columns, in one aggregate."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    row = df.agg(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(a, b).alias("r")) for a, b in pairs]).alias("c"))
    return row.select(F.explode("c").alias("c")).select("c.*")
