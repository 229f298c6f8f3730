"""Pricing of counts and spreads, fees and profit, order books and risk rules, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def negbin_pmf(mu: Column, alpha: Column, top: int) -> Column:
    """Array of the negative binomial's probabilities of 0..top (size ``alpha``, mean ``mu``, both bounded away from 0)."""
    m, a = F.greatest(mu, F.lit(1e-6)), F.greatest(alpha, F.lit(1e-3))
    p = a / (a + m)
    first = F.array(F.pow(p, a))
    step = lambda xs, k: F.concat(xs, F.array(F.element_at(xs, -1) * (k - 1 + a) / k * (1 - p)))
    return F.aggregate(F.sequence(F.lit(1), F.lit(top)), first, step)


def array_sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)


def survival(pmf: Column, strike: Column) -> Column:
    """Probability of at least ``strike`` (whole strikes count)."""
    below = F.ceil(strike).cast("int")
    return 1 - array_sum(F.slice(pmf, F.lit(1), F.greatest(below, F.lit(0))))


def joint_grid(df: DataFrame, keys: list[str], home: str, away: str) -> DataFrame:
    """One row for each key and score pair, with its probability normalised over the grid. ``home``, ``away``: pmf arrays."""
    h = df.select(*keys, away, F.posexplode(home).alias("h", "ph"))
    g = h.select(*keys, "h", "ph", F.posexplode(away).alias("a", "pa"))
    total = F.sum(F.col("ph") * F.col("pa")).over(W.partitionBy(*keys))
    return g.select(*keys, "h", "a", (F.col("ph") * F.col("pa") / total).alias("p"))


def markets(grid: DataFrame, keys: list[str], total: float, spread: float) -> DataFrame:
    """Home win, tie, total over and spread cover of each key, from a joint grid."""
    on = lambda c: F.sum(F.when(c, F.col("p")).otherwise(0.0))
    return grid.groupBy(*keys).agg(
        on(F.col("h") > F.col("a")).alias("home_win"), on(F.col("h") == F.col("a")).alias("tie"),
        on(F.col("h") + F.col("a") >= total).alias("over"), on(F.col("h") - F.col("a") >= spread).alias("cover"),
    )


def taker_fee(price: Column, whole_cents: bool = True) -> Column:
    """0.07 * P * (1 - P), rounded up to a cent or smooth."""
    fee = F.lit(0.07) * price * (1 - price)
    return F.ceil(F.round(fee * 100, 9)) / 100 if whole_cents else fee


def view(fair: Column, bid: Column, ask: Column) -> Column:
    """Which side a fair price would take; touching a price is no view."""
    return F.when(fair > ask, "take_yes").when(fair < bid, "take_no").otherwise("no_view")


def taker_profit(fair: Column, bid: Column, ask: Column, won: Column) -> Column:
    """Profit of one contract net of the fee; null without a view."""
    yes = won.cast("double") - ask - taker_fee(ask)
    no = bid - won.cast("double") - taker_fee(bid)
    return F.when(fair > ask, yes).when(fair < bid, no)


def top_of_book(levels: DataFrame, keys: list[str], side: str, price: str, size: str) -> DataFrame:
    """Best bid and ask (100 less the best no price) of each key from open levels; a crossed book gives nulls."""
    open_ = F.col(size) > 0
    top = levels.groupBy(*keys).agg(F.max(F.when(open_ & (F.col(side) == "yes"), F.col(price))).alias("bid"), (100 - F.max(F.when(open_ & (F.col(side) == "no"), F.col(price)))).alias("ask"))
    fine = F.coalesce(F.col("bid") < F.col("ask"), F.lit(True))
    return top.select(*keys, F.when(fine, F.col("bid")).alias("bid"), F.when(fine, F.col("ask")).alias("ask"))


def book_levels(deltas: DataFrame, keys: list[str], seq: str, side: str, price: str, change: str) -> DataFrame:
    """Open levels of each key after all deltas; a repeated sequence number counts once; emptied levels go."""
    once = deltas.groupBy(*keys, seq).agg(F.min(F.struct(side, price, change)).alias("d"))
    return once.groupBy(*keys, F.col(f"d.{side}").alias(side), F.col(f"d.{price}").alias(price)).agg(F.sum(f"d.{change}").alias("size")).where("size > 0")


def first_reason(rules: list[tuple[Column, str]], fine: str) -> Column:
    """The label of the first rule that holds."""
    out = None
    for rule, label in rules:
        out = F.when(rule, label) if out is None else out.when(rule, label)
    return out.otherwise(fine)


def capped_shares(df: DataFrame, keys: list[str], order: list[str], want: str, cap: str, name: str) -> DataFrame:
    """Greedy sizing under a cap per key: each row, in order, takes what its wish and the room left allow."""
    w = W.partitionBy(*keys).orderBy(*order)
    used = F.coalesce(F.sum(want).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    return df.withColumn(name, F.greatest(F.lit(0.0), F.least(F.col(want), F.col(cap) - used)))


def positions(fills: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Open quantity, average price of buys and realised profit of each key from signed fills (qty, price).

    A sale is measured against the average of the buys before it, fill by fill in ``order``;
    later buys do not change it. Sold before any buy, it counts with the whole price.
    """
    q, p = F.col("qty"), F.col("price")
    so_far = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    bought, paid = F.when(q > 0, q), F.when(q > 0, q * p)
    cost = F.try_divide(F.sum(paid).over(so_far), F.sum(bought).over(so_far))
    gain = F.when(q < 0, -q * (p - F.coalesce(cost, F.lit(0.0))))
    return fills.withColumn("__g", gain).groupBy(*keys).agg(
        F.sum(q).alias("open"), F.try_divide(F.sum(paid), F.sum(bought)).alias("cost"), F.coalesce(F.sum("__g"), F.lit(0.0)).alias("realised"),
    )


def half_spread(mu: Column, alpha: Column) -> Column:
    """Ticks to quote either side: 1 + 0.4 deviations, half to even, held between 2 and 5."""
    return F.least(F.greatest(F.bround(1 + 0.4 * F.sqrt(mu + mu * mu / alpha)), F.lit(2.0)), F.lit(5.0)).cast("int")
