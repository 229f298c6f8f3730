"""Rating systems: window forms where the rating is one, a native fold for Elo, small solves for the rest."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F


def log5(p: Column, q: Column) -> Column:
    """Chance that the first side wins, from both win rates, held off 0 and 1."""
    a, b = (F.least(F.greatest(x, F.lit(0.01)), F.lit(0.99)) for x in (p, q))
    return a * (1 - b) / (a * (1 - b) + b * (1 - a))


def pythagenpat(scored: Column, allowed: Column, games: Column, power: float = 0.287) -> Column:
    """Expected win share; the exponent is runs a game to a power; nothing allowed gives 1, nothing at all null."""
    exponent = F.pow(F.try_divide(scored + allowed, games), F.lit(power))
    share = F.pow(scored, exponent) / (F.pow(scored, exponent) + F.pow(allowed, exponent))
    return F.when(scored + allowed <= 0, None).when(allowed == 0, 1.0).otherwise(share)


def base_runs(h: Column, bb: Column, hr: Column, tb: Column, ab: Column) -> Column:
    """A * B / (B + C) + D with the usual weights."""
    a = h + bb - hr
    b = (1.4 * tb - 0.6 * h - 3 * hr + 0.1 * bb) * 1.02
    return F.try_divide(a * b, b + ab - h) + hr


def elo(matches: DataFrame, group: str, order: Sequence[str], home: str, away: str, margin: str, k: float = 4.0, advantage: float = 24.0, start: float = 1500.0) -> DataFrame:
    """(group, order.., home, away, home_elo, away_elo): ratings before each match of a group, played in order.

    Strictly sequential by nature: a group (a league, a season) is folded in one row by a
    native aggregate whose state is the array of ratings and the matches rated so far. Groups
    are independent, and one group's matches must fit in a row.
    """
    match = F.struct(*[F.col(c) for c in order], F.col(home).cast("int").alias("h"), F.col(away).cast("int").alias("a"), F.col(margin).cast("double").alias("m"))
    rows = matches.groupBy(group).agg(F.array_sort(F.collect_list(match)).alias("ms"), F.max(F.greatest(home, away)).cast("int").alias("top"))
    rated = (
        "aggregate(ms, named_struct('r', transform(sequence(0, top), i -> CAST({s} AS DOUBLE)), 'out', CAST(array() AS array<struct<i:int,he:double,ae:double>>)), (s, m) -> "
        "transform(array(named_struct('rh', s.r[m.h], 'ra', s.r[m.a], 'd', {k} * ln(abs(m.m) + 1) * ((CASE WHEN m.m > 0 THEN 1.0D WHEN m.m < 0 THEN 0.0D ELSE 0.5D END) - 1 / (1 + pow(10, (s.r[m.a] - s.r[m.h] - {adv}) / 400))))), q -> "
        "named_struct('r', transform(s.r, (x, i) -> CASE WHEN i = m.h AND m.h <> m.a THEN x + q.d WHEN i = m.a AND m.h <> m.a THEN x - q.d ELSE x END), "
        "'out', concat(s.out, array(named_struct('i', size(s.out), 'he', q.rh, 'ae', q.ra)))))[0], s -> s.out)"
    ).format(s=start, k=k, adv=advantage)
    both = rows.select(group, "ms", F.expr(rated).alias("out")).select(group, F.explode(F.arrays_zip("ms", "out")).alias("z"))
    return both.select(group, *[F.col(f"z.ms.{c}").alias(c) for c in order], F.col("z.ms.h").alias("home"), F.col("z.ms.a").alias("away"), F.col("z.out.he").alias("home_elo"), F.col("z.out.ae").alias("away_elo"))


def pair_table(matches: DataFrame, group: str, home: str, away: str, margin: str) -> DataFrame:
    """(group, h, a, n, won, margin): one row a pair of sides; what the solves need, whatever the number of matches."""
    won = F.when(F.col(margin) > 0, 1.0).when(F.col(margin) == 0, 0.5).otherwise(0.0)
    return matches.where(f"{home} <> {away}").groupBy(group, F.col(home).alias("h"), F.col(away).alias("a")).agg(F.count(F.lit(1)).alias("n"), F.sum(won).alias("won"), F.sum(margin).cast("double").alias("margin"))


def _components(n: int, h: np.ndarray, a: np.ndarray) -> np.ndarray:
    label = np.arange(n)
    while True:
        before = label.copy()
        low = np.minimum(label[h], label[a])
        np.minimum.at(label, h, low)
        np.minimum.at(label, a, low)
        if (label == before).all():
            return label


def solve_massey(pdf: pd.DataFrame, value: str = "margin", ridge: float = 0.01) -> tuple[np.ndarray, np.ndarray]:
    """Sides and least-squares ratings that sum to zero in each connected component."""
    sides, flat = np.unique(np.concatenate([pdf["h"], pdf["a"]]), return_inverse=True)
    h, a = flat[: len(pdf)], flat[len(pdf) :]
    n = pdf["n"].to_numpy(float)
    m = np.zeros((len(sides), len(sides)))
    b = np.zeros(len(sides))
    np.add.at(m, (h, h), n)
    np.add.at(m, (a, a), n)
    np.add.at(m, (h, a), -n)
    np.add.at(m, (a, h), -n)
    np.add.at(b, h, pdf[value].to_numpy(float))
    np.add.at(b, a, -pdf[value].to_numpy(float))
    label = _components(len(sides), h, a)
    for c in np.unique(label):
        rows = np.flatnonzero(label == c)
        m[rows[-1]] = 0
        m[rows[-1], rows] = 1
        b[rows[-1]] = 0
    if np.linalg.cond(m) > 1e12:
        return sides, np.linalg.lstsq(m + ridge * np.eye(len(sides)), b, rcond=None)[0]
    return sides, np.linalg.solve(m, b)


def solve_bradley_terry(pdf: pd.DataFrame, rounds: int = 100, tol: float = 1e-9) -> tuple[np.ndarray, np.ndarray]:
    """Sides and centred log strengths by the minorise-maximise iteration, half a win each way added to every pair."""
    sides, flat = np.unique(np.concatenate([pdf["h"], pdf["a"]]), return_inverse=True)
    h, a = flat[: len(pdf)], flat[len(pdf) :]
    n, won = pdf["n"].to_numpy(float) + 1, pdf["won"].to_numpy(float) + 0.5
    wins = np.bincount(h, won, len(sides)) + np.bincount(a, n - won, len(sides))
    s = np.ones(len(sides))
    for _ in range(rounds):
        d = n / (s[h] + s[a])
        new = wins / (np.bincount(h, d, len(sides)) + np.bincount(a, d, len(sides)))
        new /= np.exp(np.log(new).mean())
        done = np.abs(new - s).max() < tol
        s = new
        if done:
            break
    return sides, np.log(s)


def solve_srs(pdf: pd.DataFrame, rounds: int = 100, tol: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """Sides and simple ratings: average margin plus the mean rating of the sides met, centred, by damped iteration."""
    sides, flat = np.unique(np.concatenate([pdf["h"], pdf["a"]]), return_inverse=True)
    h, a = flat[: len(pdf)], flat[len(pdf) :]
    n, margin = pdf["n"].to_numpy(float), pdf["margin"].to_numpy(float)
    games = np.bincount(h, n, len(sides)) + np.bincount(a, n, len(sides))
    avg = (np.bincount(h, margin, len(sides)) - np.bincount(a, margin, len(sides))) / games
    r = avg.copy()
    for _ in range(rounds):
        met = (np.bincount(h, n * r[a], len(sides)) + np.bincount(a, n * r[h], len(sides))) / games
        new = 0.5 * r + 0.5 * (avg + met)
        new -= new.mean()
        done = np.abs(new - r).max() < tol
        r = new
        if done:
            break
    return sides, r


def rate(matches: DataFrame, group: str, home: str, away: str, margin: str) -> DataFrame:
    """(group, side, massey, colley_like, bradley_terry, srs) of each group; the solves see one row a pair of sides."""
    pairs = pair_table(matches, group, home, away, margin)
    kinds = {f.name: f.dataType.simpleString() for f in pairs.schema}

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        sides, massey = solve_massey(pdf)
        balance = pdf.assign(balance=2 * pdf["won"] - pdf["n"])
        return pd.DataFrame({group: pdf[group].iloc[0], "side": sides, "massey": massey, "colley_like": solve_massey(balance, "balance")[1], "bradley_terry": solve_bradley_terry(pdf)[1], "srs": solve_srs(pdf)[1]})

    return pairs.groupBy(group).applyInPandas(solve, f"{group} {kinds[group]}, side {kinds['h']}, massey double, colley_like double, bradley_terry double, srs double")
