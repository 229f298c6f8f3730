"""Scores of probabilities, calibration, folds and splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def scores(df: DataFrame, keys: Sequence[str], p: str, y: str, eps: float = 1e-15) -> DataFrame:
    """Rows, log-loss, Brier score, accuracy at one half and base rate of each key."""
    q = F.least(F.greatest(F.col(p), F.lit(eps)), F.lit(1 - eps))
    t = F.col(y).cast("double")
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(-(t * F.log(q) + (1 - t) * F.log(1 - q))).alias("logloss"), F.avg((F.col(p) - t) * (F.col(p) - t)).alias("brier"),
        F.avg(((F.col(p) >= 0.5) == (t == 1.0)).cast("double")).alias("accuracy"), F.avg(t).alias("base"),
    )


def regression(df: DataFrame, keys: Sequence[str], f: str, y: str, delta: float = 1.5) -> DataFrame:
    """MAE, RMSE, R2 and Huber loss of each key."""
    e = F.col(y) - F.col(f)
    huber = F.when(F.abs(e) <= delta, 0.5 * e * e).otherwise(delta * (F.abs(e) - 0.5 * delta))
    return df.groupBy(*keys).agg(
        F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), (1 - F.try_divide(F.sum(e * e), F.var_pop(y) * F.count(y))).alias("r2"), F.avg(huber).alias("huber")
    )


def bin_of(p: Column, bins: int) -> Column:
    """Equal-width bin of a probability; 1 belongs to the last."""
    return F.least(F.floor(p * bins), F.lit(bins - 1)).cast("int")


def calibration(df: DataFrame, p: str, y: str, bins: int) -> DataFrame:
    """(bin, n, mean_p, mean_y) of the bins that have rows."""
    return df.groupBy(bin_of(F.col(p), bins).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_p"), F.avg(F.col(y).cast("double")).alias("mean_y"))


def ece(df: DataFrame, p: str, y: str, bins: int = 15) -> DataFrame:
    """One row: expected calibration error."""
    c = calibration(df, p, y, bins)
    return c.agg((F.sum(F.col("n") * F.abs(F.col("mean_p") - F.col("mean_y"))) / F.sum("n")).alias("ece"))


def murphy(df: DataFrame, p: str, y: str, bins: int = 10) -> DataFrame:
    """One row: reliability, resolution and uncertainty of the binned Brier score; a bin keeps sums, so one pass does."""
    c = calibration(df, p, y, bins).withColumn("s", F.col("n") * F.col("mean_y"))
    base = c.agg((F.sum("s") / F.sum("n")).alias("base"), F.sum("n").alias("all"))
    j = c.join(F.broadcast(base))
    part = lambda x: F.sum(F.col("n") * x * x) / F.max("all")
    return j.agg(part(F.col("mean_p") - F.col("mean_y")).alias("reliability"), part(F.col("mean_y") - F.col("base")).alias("resolution"), F.max(F.col("base") * (1 - F.col("base"))).alias("uncertainty"))


def auc(df: DataFrame, p: str, y: str) -> DataFrame:
    """One row: rank AUC, ties shared. Rows are counted per score first; the running count is over distinct scores,
    cut in ranges of the score so that no single task sorts them all."""
    per = df.groupBy(p).agg(F.sum(F.col(y).cast("long")).alias("pos"), F.count(F.lit(1)).alias("n")).withColumn("part", F.floor(F.col(p) * 64))
    parts = per.groupBy("part").agg(F.sum(F.col("n") - F.col("pos")).alias("neg_part"))
    before = parts.select("part", F.coalesce(F.sum("neg_part").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("neg_before"))
    inside = F.coalesce(F.sum(F.col("n") - F.col("pos")).over(W.partitionBy("part").orderBy(p).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    wins = per.withColumn("inside", inside).join(F.broadcast(before), "part")
    won = F.sum(F.col("pos") * (F.col("neg_before") + F.col("inside") + (F.col("n") - F.col("pos")) / 2))
    return wins.agg(F.try_divide(won, F.sum("pos") * F.sum(F.col("n") - F.col("pos")).cast("double")).alias("auc"))


def folds(df: DataFrame, season: str, first_train: int) -> DataFrame:
    """(val, train) season pairs of expanding folds: at least ``first_train`` earlier seasons. Seasons are few."""
    s = df.select(F.col(season).alias("s")).where("s IS NOT NULL").distinct()
    pairs = s.select(F.col("s").alias("val")).join(F.broadcast(s.select(F.col("s").alias("train"))), F.col("train") < F.col("val"))
    n = F.count(F.lit(1)).over(W.partitionBy("val"))
    return pairs.withColumn("n", n).where(F.col("n") >= first_train).drop("n")


def date_split(df: DataFrame, day: str, train: float = 0.8, val: float = 0.1) -> DataFrame:
    """(day, part): distinct days in order, cut at shares of their number. Days are few."""
    d = df.select(day).distinct()
    place = F.row_number().over(W.orderBy(day)) - 1
    n = d.agg(F.count(F.lit(1)).alias("n"))
    out = d.withColumn("i", place).join(F.broadcast(n))
    part = F.when(F.col("i") < F.floor(F.col("n") * train), "train").when(F.col("i") < F.floor(F.col("n") * (train + val)), "val").otherwise("test")
    return out.select(day, part.alias("part"))


def tiers(df: DataFrame, x: str, low: float, high: float) -> DataFrame:
    """``df`` with HIGH, MEDIUM or LOW confidence by exact quantiles of a spread."""
    q = df.agg(F.percentile(x, low).alias("__a"), F.percentile(x, high).alias("__b"))
    tier = F.when(F.col(x) <= F.col("__a"), "HIGH").when(F.col(x) <= F.col("__b"), "MEDIUM").otherwise("LOW")
    return df.join(F.broadcast(q)).withColumn("tier", tier).drop("__a", "__b")


def ks_distance(df: DataFrame, group: str, a: str, b: str, x: str) -> DataFrame:
    """One row: the greatest distance of two groups' distribution functions, over counts per distinct value."""
    per = df.groupBy(x).agg(F.count_if(F.col(group) == a).alias("na"), F.count_if(F.col(group) == b).alias("nb"))
    w = W.orderBy(x).rowsBetween(W.unboundedPreceding, 0)
    tot = per.agg(F.sum("na").alias("ta"), F.sum("nb").alias("tb"))
    run = per.select(F.sum("na").over(w).alias("ca"), F.sum("nb").over(w).alias("cb")).join(F.broadcast(tot))
    return run.agg(F.max(F.abs(F.col("ca") / F.col("ta") - F.col("cb") / F.col("tb"))).alias("ks"))


def spearman(df: DataFrame, x: str, y: str, keys: Sequence[str]) -> DataFrame:
    """Rank correlation of each key, ties averaged."""
    rank = lambda c: F.rank().over(W.partitionBy(*keys).orderBy(c)) + (F.count(F.lit(1)).over(W.partitionBy(*keys, c)) - 1) / 2
    return df.select(*keys, rank(x).alias("rx"), rank(y).alias("ry")).groupBy(*keys).agg(F.corr("rx", "ry").alias("rho"))


def isotonic(df: DataFrame, x: str, y: str) -> DataFrame:
    """(x, n, fit): pooled adjacent violators over distinct scores, tied scores pooled first.

    The least-squares monotone fit at a score is the largest, over starts, of the smallest,
    over ends, mean of the rows between. Scores must be binned to a bounded number (the
    caller's part); pairs of bins are what is compared.
    """
    per = df.groupBy(x).agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(F.col(y).cast("double")).alias("s"))
    w = W.orderBy(x).rowsBetween(W.unboundedPreceding, 0)
    cum = per.select(x, "n", F.sum("n").over(w).alias("cn"), F.sum("s").over(w).alias("cs"), "s")
    start = cum.select(F.col(x).alias("xa"), (F.col("cn") - F.col("n")).alias("na"), (F.col("cs") - F.col("s")).alias("sa"))
    end = cum.select(F.col(x).alias("xb"), F.col("cn").alias("nb"), F.col("cs").alias("sb"))
    spans = start.join(F.broadcast(end), F.col("xb") >= F.col("xa")).withColumn("m", (F.col("sb") - F.col("sa")) / (F.col("nb") - F.col("na")))
    low = spans.withColumn("low", F.min("m").over(W.partitionBy("xa").orderBy(F.desc("xb")).rowsBetween(W.unboundedPreceding, 0)))
    best = low.groupBy("xb").agg(F.max("low").alias("fit"))
    return per.select(x, F.col("n").cast("long").alias("n")).join(best, F.col(x) == F.col("xb")).select(x, "n", "fit")
