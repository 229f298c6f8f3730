"""Unified timelines: two-role rows (home and away) stacked to one row an entity, and mapped back."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window as W, WindowSpec, functions as F


def stack_roles(df: DataFrame, keys: Sequence[str], roles: dict[str, tuple[str, dict[str, str]]]) -> DataFrame:
    """One row for each row and role: keys, role, entity and the role's values under common names.

    ``roles``: role name -> (entity column, {common name: column}). One pass over the input, by an explode.
    """
    each = [F.struct(F.lit(role).alias("role"), F.col(entity).alias("entity"), *[F.col(c).alias(n) for n, c in values.items()]) for role, (entity, values) in roles.items()]
    return df.select(*keys, F.explode(F.array(*each)).alias("__r")).select(*keys, "__r.*")


def unified_timeline(df: DataFrame, keys: Sequence[str], roles: dict[str, tuple[str, dict[str, str]]], order: Sequence[str], features: dict[str, Callable[[WindowSpec], Column]]) -> DataFrame:
    """``keys`` with ``{role}_{feature}`` columns: windows over each entity's rows in both roles.

    ``order`` totally orders an entity's rows; an entity that meets itself has both rows.
    """
    stacked = stack_roles(df, keys, roles)
    w = W.partitionBy("entity").orderBy(*order)
    valued = stacked.select(*keys, "role", *[make(w).alias(name) for name, make in features.items()])
    back = [F.max(F.when(F.col("role") == role, F.col(name))).alias(f"{role}_{name}") for role in roles for name in features]
    return valued.groupBy(*keys).agg(*back)
