"""Quotes: candle cleaning with counts, orientation, quarantine, opportunities, period scaling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def candle_state(bid: Column, ask: Column, top: float) -> Column:
    """one_sided (an empty or impossible side), crossed, or two_sided."""
    return F.when(bid.isNull() | ask.isNull() | (bid <= 0) | (ask <= 0) | (ask > top), "one_sided").when(bid >= ask, "crossed").otherwise("two_sided")


def clean_candles(df: DataFrame, key: str, time: str, bid: str, ask: str, top: float, last: str) -> DataFrame:
    """Two-sided candles, the last of each key and time (largest ``last``), with mid and spread."""
    good = df.where(candle_state(F.col(bid), F.col(ask), top) == "two_sided")
    kept = good.groupBy(key, time).agg(F.max_by(F.struct(bid, ask), last).alias("__c"))
    return kept.select(key, time, f"__c.{bid}", f"__c.{ask}", ((F.col(f"__c.{bid}") + F.col(f"__c.{ask}")) / 2).alias("mid"), (F.col(f"__c.{ask}") - F.col(f"__c.{bid}")).alias("spread"))


def candle_counts(df: DataFrame, bid: str, ask: str, top: float) -> DataFrame:
    """How many candles each state has, so that nothing is dropped unseen."""
    return df.groupBy(candle_state(F.col(bid), F.col(ask), top).alias("state")).agg(F.count(F.lit(1)).alias("n"))


def oriented(df: DataFrame, suffix: str, home: str, away: str, fair: str, outcome: str) -> DataFrame:
    """Rows that name the home side as they are, rows of the away side turned round (both numbers at once), others dropped."""
    flip = F.col(suffix) == F.col(away)
    turned = {c: F.when(flip, 1 - F.col(c)).otherwise(F.col(c)) for c in (fair, outcome)}
    return df.where((F.col(suffix) == F.col(home)) | flip).withColumns(turned)


def quarantined(df: DataFrame, identity: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that keep an identity (unknown counts as broken), and how many there are of either kind."""
    kept = F.coalesce(identity, F.lit(False))
    return df.where(kept), df.groupBy(kept.alias("kept")).agg(F.count(F.lit(1)).alias("n"))


def scaled_to_period(mu: Column, alpha: Column, done: Column, period: float, whole: float) -> tuple[Column, Column]:
    """Mean and dispersion of what remains of a period, by the share of time left; null once it is over."""
    share = F.when((done < period) & (done < whole), (period - done) / (whole - done))
    return mu * share, alpha * share


def any_score(mu_a: Column, alpha_a: Column, mu_b: Column, alpha_b: Column) -> Column:
    """Chance that at least one of two sides scores, both counts negative binomial."""
    none = lambda mu, alpha: F.pow(alpha / (alpha + mu), alpha)
    return 1 - none(mu_a, alpha_a) * none(mu_b, alpha_b)


def split_total(total: Column, diff: Column, sd_total: Column, sd_diff: Column) -> dict[str, Column]:
    """Mean of either side and their common deviation, from total and difference."""
    return {"home": (total + diff) / 2, "away": (total - diff) / 2, "sd": F.sqrt(sd_total * sd_total + sd_diff * sd_diff) / 2}


def taker(bid: Column, ask: Column, fair: Column, need: Column) -> Column:
    """yes, no or null: which side of the book (in ticks of 100) is off by at least ``need`` of a unit."""
    return F.when((ask < fair) & ((fair - ask) / 100 >= need), "yes").when((bid > fair) & ((bid - fair) / 100 >= need), "no")


def hold_or_exit(tier: Column, accuracy: Column, edge: Column) -> Column:
    return F.when((tier == "HIGH") & (accuracy >= 1), "hold").when((tier == "LOW") | (accuracy < 0.7) | (edge < 0.02), "exit").otherwise("hold")


def quotes(fair: Column, half: Column, least_edge: Column) -> dict[str, Column]:
    """Bid and ask in whole ticks about a fair value, held inside 1..99; null where the half spread is under the edge that is asked for."""
    fine = half >= least_edge
    return {"bid": F.when(fine, F.greatest(F.lit(1), F.floor(fair - half).cast("int"))), "ask": F.when(fine, F.least(F.lit(99), F.ceil(fair + half).cast("int")))}
