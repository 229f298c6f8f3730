"""Pricing, order books and profit over stand-ins: views are quotes, purchases are trades."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from chronolake.operators import pricing as M
from chronolake.plans.registry import query
from chronolake.runtime import table

_LG = "exp(lgamma(k + a) - lgamma(a) - lgamma(k + 1.0) + a * ln(a / (a + m)) + k * ln(m / (a + m)))"


def states(spark: SparkSession, d: str) -> DataFrame:
    """Mean and shape of each supplier nation's counts."""
    li = table(spark, d, "lineitem").select("l_suppkey", "l_quantity")
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    return li.join(s, "l_suppkey").groupBy("s_nationkey").agg((F.avg("l_quantity") / 6).alias("m"), (F.stddev_samp("l_quantity") / 3).alias("a"))


_STATE = "s AS (SELECT s_nationkey, avg(l_quantity) / 6 AS m, stddev_samp(l_quantity) / 3 AS a FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1)"


@query("negbin_table", f"WITH {_STATE} SELECT s_nationkey, CAST(k AS INTEGER) AS k, round({_LG}, 6) AS p FROM s, range(0, 31) r(k)")
def negbin_table(spark: SparkSession, d: str) -> DataFrame:
    s = states(spark, d)
    return s.select("s_nationkey", F.posexplode(M.negbin_pmf(F.col("m"), F.col("a"), 30)).alias("k", "p")).withColumn("p", F.round("p", 6))


@query(
    "negbin_markets",
    f"""WITH {_STATE}, p AS (SELECT s_nationkey, k, {_LG} AS p FROM s, range(0, 31) r(k)), g AS (SELECT h.s_nationkey AS home, b.s_nationkey AS away, h.k AS h, b.k AS a, h.p * b.p AS p FROM p h JOIN p b ON b.s_nationkey = (h.s_nationkey + 1) % 25)
    SELECT home, round(sum(p) FILTER (h > a) / sum(p), 6) AS home_win, round(sum(p) FILTER (h = a) / sum(p), 6) AS tie, round(sum(p) FILTER (h + a >= 8.5) / sum(p), 6) AS over, round(sum(p) FILTER (h - a >= 1.5) / sum(p), 6) AS cover FROM g GROUP BY 1""",
)
def negbin_markets(spark: SparkSession, d: str) -> DataFrame:
    s = states(spark, d).select("s_nationkey", M.negbin_pmf(F.col("m"), F.col("a"), 30).alias("pmf"))
    pair = s.select(F.col("s_nationkey").alias("home"), F.col("pmf").alias("hp"), ((F.col("s_nationkey") + 1) % 25).alias("away")).join(s.select(F.col("s_nationkey").alias("away"), F.col("pmf").alias("ap")), "away")
    out = M.markets(M.joint_grid(pair.select("home", "hp", "ap"), ["home"], "hp", "ap"), ["home"], 8.5, 1.5)
    return out.select("home", *[F.round(c, 6).alias(c) for c in ("home_win", "tie", "over", "cover")])


@query(
    "line_ladder",
    f"""WITH {_STATE}, l AS (SELECT unnest([2.5, 3.0, 4.5, 6.0, 9.5]) AS line) SELECT s_nationkey, line, round(1 - coalesce((SELECT sum({_LG}) FROM range(0, 31) r(k) WHERE k < line), 0), 6) AS at_least FROM s, l""",
)
def line_ladder(spark: SparkSession, d: str) -> DataFrame:
    s = states(spark, d).withColumn("pmf", M.negbin_pmf(F.col("m"), F.col("a"), 30))
    ladder = s.select("s_nationkey", "pmf", F.explode(F.array(*[F.lit(x) for x in (2.5, 3.0, 4.5, 6.0, 9.5)])).alias("line"))
    return ladder.select("s_nationkey", "line", F.round(M.survival(F.col("pmf"), F.col("line")), 6).alias("at_least"))


@query(
    "taker_pnl",
    """WITH x AS (SELECT event_id, least(0.99, greatest(0.01, value / 490)) AS f, ((event_id * 37) % 89 + 3) / 100.0 AS bid, event_type IN ('purchase', 'click') AS won FROM events),
    y AS (SELECT *, bid + 0.05 AS ask FROM x)
    SELECT event_id, CASE WHEN f > ask THEN 'take_yes' WHEN f < bid THEN 'take_no' ELSE 'no_view' END AS side,
    round(CASE WHEN f > ask THEN won::INT - ask - ceil(round(0.07 * ask * (1 - ask) * 100, 9)) / 100 WHEN f < bid THEN bid - won::INT - ceil(round(0.07 * bid * (1 - bid) * 100, 9)) / 100 END, 6) AS profit FROM y""",
)
def taker_pnl(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", F.least(F.lit(0.99), F.greatest(F.lit(0.01), F.col("value") / 490)).alias("f"), ((F.col("event_id") * 37 % 89 + 3) / 100.0).alias("bid"), F.col("event_type").isin("purchase", "click").cast("int").alias("won"))
    e = e.withColumn("ask", F.col("bid") + 0.05)
    f, b, a = F.col("f"), F.col("bid"), F.col("ask")
    return e.select("event_id", M.view(f, b, a).alias("side"), F.round(M.taker_profit(f, b, a, F.col("won")), 6).alias("profit"))


_DELTAS = "(SELECT user_id, event_id % 500 AS seq, CASE WHEN event_id % 2 = 0 THEN 'yes' ELSE 'no' END AS side, CAST(value AS BIGINT) % 45 + 1 AS price, CASE WHEN event_type = 'error' THEN -30 ELSE 10 END AS qty FROM (SELECT event_id, user_id, floor(value) AS value, event_type FROM events))"


@query(
    "order_book_top",
    f"""WITH d AS (SELECT user_id, seq, min((side, price, qty)) AS m FROM {_DELTAS} GROUP BY 1, 2), u AS (SELECT user_id, m[1] AS side, m[2] AS price, sum(m[3]) AS size FROM d GROUP BY 1, 2, 3),
    t AS (SELECT user_id, max(price) FILTER (side = 'yes') AS bid, 100 - max(price) FILTER (side = 'no') AS ask FROM u WHERE size > 0 GROUP BY 1)
    SELECT user_id, CASE WHEN coalesce(bid < ask, true) THEN bid END AS bid, CASE WHEN coalesce(bid < ask, true) THEN ask END AS ask FROM t""",
)
def order_book_top(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(
        "user_id", (F.col("event_id") % 500).alias("seq"), F.when(F.col("event_id") % 2 == 0, "yes").otherwise("no").alias("side"),
        (F.floor("value").cast("long") % 45 + 1).alias("price"), F.when(F.col("event_type") == "error", -30).otherwise(10).alias("qty"),
    )
    return M.top_of_book(M.book_levels(e, ["user_id"], "seq", "side", "price", "qty"), ["user_id"], "side", "price", "size")


@query(
    "risk_gate",
    """WITH x AS (SELECT user_id, CAST(ts AS DATE) AS day, sum(value) AS exposure, count(*) AS n FROM events GROUP BY 1, 2)
    SELECT user_id, day, CASE WHEN n > 6 THEN 'too many orders' WHEN exposure > 800 THEN 'exposure' WHEN exposure / n > 250 THEN 'order size' ELSE 'ok' END AS verdict FROM x""",
)
def risk_gate(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "events").groupBy("user_id", F.col("ts").cast("date").alias("day")).agg(F.sum("value").alias("exposure"), F.count(F.lit(1)).alias("n"))
    rules = [(F.col("n") > 6, "too many orders"), (F.col("exposure") > 800, "exposure"), (F.col("exposure") / F.col("n") > 250, "order size")]
    return x.select("user_id", "day", M.first_reason(rules, "ok").alias("verdict"))


@query(
    "capped_sizing",
    """SELECT event_id, round(greatest(0.0, least(value, 1500.0 - coalesce(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))), 4) AS size FROM events""",
)
def capped_sizing(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "user_id", "ts", "value", F.lit(1500.0).alias("cap"))
    return M.capped_shares(e, ["user_id"], ["ts", "event_id"], "value", "cap", "size").select("event_id", F.round("size", 4).alias("size"))


@query(
    "position_ledger",
    """WITH f AS (SELECT user_id, ts, event_id, CASE WHEN event_type = 'purchase' THEN -1.0 ELSE 1.0 END AS qty, value AS price FROM events),
    c AS (SELECT *, sum(qty * price) FILTER (qty > 0) OVER w / sum(qty) FILTER (qty > 0) OVER w AS avg_cost FROM f WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
    SELECT user_id, sum(qty) AS open, round(sum(qty * price) FILTER (qty > 0) / sum(qty) FILTER (qty > 0), 4) AS cost,
    round(coalesce(sum(-qty * (price - coalesce(avg_cost, 0))) FILTER (qty < 0), 0), 4) AS realised FROM c GROUP BY 1""",
)
def position_ledger(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "events").select("user_id", "ts", "event_id", F.when(F.col("event_type") == "purchase", -1.0).otherwise(1.0).alias("qty"), F.col("value").alias("price"))
    return M.positions(f, ["user_id"], ["ts", "event_id"]).select("user_id", "open", F.round("cost", 4).alias("cost"), F.round("realised", 4).alias("realised"))


@query("quote_half_spread", f"WITH {_STATE} SELECT s_nationkey, CAST(least(greatest(round_even(1 + 0.4 * sqrt(m + m * m / a), 0), 2), 5) AS INTEGER) AS ticks FROM s")
def quote_half_spread(spark: SparkSession, d: str) -> DataFrame:
    return states(spark, d).select("s_nationkey", M.half_spread(F.col("m"), F.col("a")).alias("ticks"))
