"""Shaping of feature frames from their schemas: selections, pairs, masks, fills, grids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import BooleanType, NumericType


def select_prefixed(df: DataFrame, prefixes: tuple[str, ...], exclude: tuple[str, ...] = (), keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` and the numeric columns whose name begins with an allowed prefix and holds none of ``exclude``."""
    ok = [f.name for f in df.schema if isinstance(f.dataType, (NumericType, BooleanType)) and f.name.startswith(prefixes) and not any(x in f.name for x in exclude)]
    return df.select(*keep, *[c for c in ok if c not in keep])


def side_pairs(df: DataFrame, left: str = "home_", right: str = "away_", stem: str = "roll", sums: bool = True) -> DataFrame:
    """``df`` with the difference (and sum) of every pair of columns that differ only in the side."""
    pairs = [(c, right + c[len(left) :], c[len(left) :]) for c in df.columns if c.startswith(left + stem) and right + c[len(left) :] in df.columns]
    return df.select("*", *[(F.col(a) - F.col(b)).alias(f"diff_{n}") for a, b, n in pairs], *[(F.col(a) + F.col(b)).alias(f"sum_{n}") for a, b, n in pairs if sums])


def regime_flags(df: DataFrame, date: str, cutoffs: dict[str, str]) -> DataFrame:
    """A 0/1 column for each named date: whether the row is on it or after."""
    return df.withColumns({n: (F.to_date(date) >= F.lit(d).cast("date")).cast("int") for n, d in cutoffs.items()})


def observed_masks(df: DataFrame, columns: list[str], share: float = 0.05) -> DataFrame:
    """``df`` with an ``_observed`` column for each column with more than ``share`` nulls; one aggregate decides."""
    rates = df.agg(*[F.avg(F.col(c).isNull().cast("int")).alias(c) for c in columns]).first()
    return df.withColumns({f"{c}_observed": F.col(c).isNotNull().cast("int") for c in columns if (rates[c] or 0) > share})


def semantic_fill(df: DataFrame, rules: list[tuple[str, float]], columns: list[str]) -> DataFrame:
    """Nulls filled by the first rule whose text the column's name holds; columns without a rule stay."""
    fills = {c: next((v for text, v in rules if text in c), None) for c in columns}
    return df.fillna({c: v for c, v in fills.items() if v is not None})


def present(c: Column, sentinels: tuple = ()) -> Column:
    """Whether a value is neither null nor one of the sentinels."""
    return c.isNotNull() & ~F.coalesce(c.isin(*sentinels), F.lit(False)) if sentinels else c.isNotNull()


def all_present(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, [c.isNotNull() for c in columns])


def hour_grid(df: DataFrame, hour: str, decisions: tuple[int, int], targets: tuple[int, int]) -> DataFrame:
    """Each row for every pair of a decision offset and a target offset in hours."""
    step = lambda c: F.expr(f"{hour} + make_interval(0, 0, 0, 0, {c}, 0, 0)")
    wide = df.withColumn("d", F.explode(F.sequence(*map(F.lit, decisions)))).withColumn("t", F.explode(F.sequence(*map(F.lit, targets))))
    return wide.withColumn("decision", step("d")).withColumn("target", step("t"))


def pair_history(df: DataFrame, pair: list[str], day: str, values: dict[str, Column]) -> DataFrame:
    """``df`` with sums over all earlier days of the pair; the day itself is not seen."""
    w = W.partitionBy(*pair).orderBy(F.unix_date(F.to_date(day))).rangeBetween(W.unboundedPreceding, -1)
    return df.withColumns({n: F.coalesce(F.sum(c).over(w), F.lit(0)) for n, c in values.items()})


def linear_weights(df: DataFrame, season: str, least: float = 0.05, name: str = "weight") -> DataFrame:
    """Weights rising linearly from the first season (``least``) to the last (1), scaled to a mean of 1; equal seasons weigh 1."""
    bounds = df.agg(F.min(season).alias("__a"), F.max(season).alias("__b"))
    raw = F.when(F.col("__a") == F.col("__b"), 1.0).otherwise(F.greatest(F.lit(least), (F.col(season) - F.col("__a")) / (F.col("__b") - F.col("__a"))))
    rough = df.join(F.broadcast(bounds)).withColumn("__w", raw)
    mean = rough.agg(F.avg("__w").alias("__m"))  # one row
    return rough.join(F.broadcast(mean)).withColumn(name, F.col("__w") / F.col("__m")).drop("__a", "__b", "__w", "__m")


def spread_apart(points: Column, least: float, most: int, km) -> Column:
    """Of points in order (nearest first) those at least ``least`` from all taken before, ``most`` at the end; the list is bounded by the caller."""
    take = lambda s, p: F.when((F.size(s) < most) & ~F.exists(s, lambda q: km(p, q) < least), F.concat(s, F.array(p))).otherwise(s)
    return F.aggregate(points, F.slice(points, 1, 0), take)
