"""Data-quality operators: gates, containment, coverage, contiguity, version diffs, upserts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def containment(child: DataFrame, a: str, parent: DataFrame, b: str, child_name: str, parent_name: str) -> DataFrame:
    """One row: distinct keys of ``child`` and how many of them ``parent`` has. Null keys count on neither side."""
    keys = child.select(F.col(a).alias("k")).where("k IS NOT NULL").distinct()
    have = parent.select(F.col(b).alias("k")).where("k IS NOT NULL").distinct().withColumn("f", F.lit(1))
    return keys.join(have, "k", "left").agg(F.lit(child_name).alias("child"), F.lit(parent_name).alias("parent"), F.count("k").alias("n"), F.count("f").alias("n_found"))


def missing_days(df: DataFrame, keys: Sequence[str], day: str) -> DataFrame:
    """(keys, day) of every day of the table's span on which a key has no row."""
    present = df.select(*keys, day).distinct()
    span = df.agg(F.min(day).alias("a"), F.max(day).alias("b"))
    grid = present.select(*keys).distinct().join(F.broadcast(span)).select(*keys, F.explode(F.sequence("a", "b")).alias(day))
    return grid.join(present, [*keys, day], "left_anti")


def gates(df: DataFrame, bounds: dict[str, tuple[float | None, float | None, float]]) -> DataFrame:
    """One row a column: rows, nulls, values out of range, and whether it passes. ``bounds``: low, high, largest share of nulls."""
    exprs = []
    for c, (low, high, _) in bounds.items():
        x = F.col(c)
        off = F.lit(False)
        if low is not None:
            off = off | (x < low)
        if high is not None:
            off = off | (x > high)
        exprs += [F.count_if(x.isNull()).alias(f"{c}__null"), F.count_if(off).alias(f"{c}__off")]
    row = df.agg(F.count(F.lit(1)).alias("n"), *exprs)
    each = [
        F.struct(F.lit(c).alias("column"), F.col("n"), F.col(f"{c}__null").alias("n_null"), F.col(f"{c}__off").alias("n_off"),
                 ((F.col(f"{c}__off") == 0) & (F.col(f"{c}__null") <= F.col("n") * share)).alias("ok"))
        for c, (_, _, share) in bounds.items()
    ]
    return row.select(F.explode(F.array(*each)).alias("g")).select("g.*")


def runs(df: DataFrame, keys: Sequence[str], order: Sequence[str], state: str) -> DataFrame:
    """(keys, n, n_runs): rows and contiguous runs of equal ``state`` of each key."""
    w = W.partitionBy(*keys).orderBy(*order)
    new = F.when(F.lag(state).over(w).eqNullSafe(F.col(state)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    return df.select(*keys, new.alias("__new")).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("__new").cast("long").alias("n_runs"))


def density(df: DataFrame, keys: Sequence[str], index: str) -> DataFrame:
    """(keys, n, lo, hi, n_distinct, dense): whether an index runs without gaps or repeats."""
    agg = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(index).alias("lo"), F.max(index).alias("hi"), F.countDistinct(index).alias("n_distinct"))
    return agg.withColumn("dense", (F.col("n") == F.col("n_distinct")) & (F.col("hi") - F.col("lo") + 1 == F.col("n")))


def diff(old: DataFrame, new: DataFrame, keys: Sequence[str], values: Sequence[str], tolerance: float = 0.0) -> DataFrame:
    """One row: keys only in the old, only in the new, in both, and in both with a changed value."""
    a = old.select(*keys, F.struct(*values).alias("__a"), F.lit(1).alias("__ia"))
    b = new.select(*keys, F.struct(*values).alias("__b"), F.lit(1).alias("__ib"))
    changed = F.lit(False)
    for v in values:
        x, y = F.col(f"__a.{v}"), F.col(f"__b.{v}")
        changed = changed | F.coalesce(F.abs(x - y) > tolerance, x.isNull() != y.isNull())
    both = F.col("__ia").isNotNull() & F.col("__ib").isNotNull()
    joined = a.join(b, list(keys), "full")
    return joined.agg(
        F.count_if(F.col("__ib").isNull()).alias("n_gone"), F.count_if(F.col("__ia").isNull()).alias("n_new"),
        F.count_if(both).alias("n_both"), F.count_if(both & changed).alias("n_changed"),
    )


def failures(rules: dict[str, Column]) -> Column:
    """Names of the rules that a row breaks, in order; a rule that is null passes."""
    return F.array_compact(F.array(*[F.when(~rule, F.lit(name)) for name, rule in rules.items()]))


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All rows of both, the new one where both have a key."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new, allowMissingColumns=True)


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key in a total order."""
    w = W.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def replace_partitions(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``old`` without the partitions that ``new`` has, and ``new``."""
    return upsert(old, new, keys)


def backward_steps(df: DataFrame, keys: Sequence[str], order: Sequence[str], time: str) -> DataFrame:
    """(keys, n, n_back): how often a time runs backwards along an order."""
    w = W.partitionBy(*keys).orderBy(*order)
    back = F.when(F.col(time) < F.lag(time).over(w), 1).otherwise(0)
    return df.select(*keys, back.alias("__b")).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("__b").cast("long").alias("n_back"))
