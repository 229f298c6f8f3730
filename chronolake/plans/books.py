"""Candles, orientation, opportunities, period scaling, the time of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from chronolake.operators import books as B, shaping as S
from chronolake.plans.registry import query
from chronolake.runtime import table

_C = "c AS (SELECT user_id, date_trunc('hour', ts) AS qts, event_id, (event_id * 31 % 105) / 100.0 AS bid, (event_id * 17 % 110) / 100.0 AS ask FROM events)"


def candles(spark: SparkSession, d: str) -> DataFrame:
    hundredth = lambda s: (F.expr(s) / F.lit(100.0))
    return table(spark, d, "events").select("user_id", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("qts"), "event_id", hundredth("event_id * 31 % 105").alias("bid"), hundredth("event_id * 17 % 110").alias("ask"))


@query("candle_counts", f"WITH {_C} SELECT CASE WHEN bid <= 0 OR ask <= 0 OR ask > 1 THEN 'one_sided' WHEN bid >= ask THEN 'crossed' ELSE 'two_sided' END AS state, count(*) AS n FROM c GROUP BY 1")
def candle_counts(spark: SparkSession, d: str) -> DataFrame:
    return B.candle_counts(candles(spark, d), "bid", "ask", 1.0)


@query(
    "candle_clean",
    f"""WITH {_C} SELECT user_id, qts, round(bid, 4) AS bid, round(ask, 4) AS ask, round((bid + ask) / 2, 4) AS mid, round(ask - bid, 4) AS spread FROM c WHERE bid > 0 AND ask > 0 AND ask <= 1 AND bid < ask
    QUALIFY row_number() OVER (PARTITION BY user_id, qts ORDER BY event_id DESC) = 1""",
)
def candle_clean(spark: SparkSession, d: str) -> DataFrame:
    out = B.clean_candles(candles(spark, d), "user_id", "qts", "bid", "ask", 1.0, "event_id")
    return out.select("user_id", "qts", *[F.round(c, 4).alias(c) for c in ("bid", "ask", "mid", "spread")])


_H = "h AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'AAA' WHEN 1 THEN 'BBB' WHEN 2 THEN 'AAA' ELSE 'CCC' END AS suffix, 'AAA' AS home, 'BBB' AS away, value / 500 AS fair, CAST(event_id % 3 = 0 AS DOUBLE) AS outcome FROM events)"


@query("oriented_heads", f"WITH {_H} SELECT event_id, round(CASE WHEN suffix = away THEN 1 - fair ELSE fair END, 6) AS fair, CASE WHEN suffix = away THEN 1 - outcome ELSE outcome END AS outcome FROM h WHERE suffix IN (home, away)")
def oriented_heads(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_id") % 4
    h = table(spark, d, "events").select("event_id", F.when(kind.isin(0, 2), "AAA").when(kind == 1, "BBB").otherwise("CCC").alias("suffix"), F.lit("AAA").alias("home"), F.lit("BBB").alias("away"), (F.col("value") / 500).alias("fair"), (F.col("event_id") % 3 == 0).cast("double").alias("outcome"))
    return B.oriented(h, "suffix", "home", "away", "fair", "outcome").select("event_id", F.round("fair", 6).alias("fair"), "outcome")


@query("target_quarantine", "SELECT l_extendedprice >= l_quantity * 950 AS kept, count(*) AS n FROM lineitem GROUP BY 1")
def target_quarantine(spark: SparkSession, d: str) -> DataFrame:
    return B.quarantined(table(spark, d, "lineitem"), F.col("l_extendedprice") >= F.col("l_quantity") * 950)[1]


_S = "s AS (SELECT c_custkey, 3 + abs(c_acctbal) / 4000 AS mu, 2 + abs(c_acctbal) / 8000 AS alpha, CAST(c_custkey % 10 AS DOUBLE) AS done FROM customer)"


def states(spark: SparkSession, d: str) -> DataFrame:
    bal = F.abs("c_acctbal")
    return table(spark, d, "customer").select("c_custkey", (3 + bal / 4000).alias("mu"), (2 + bal / 8000).alias("alpha"), (F.col("c_custkey") % 10).cast("double").alias("done"))


@query(
    "period_scaling",
    f"""WITH {_S}, f AS (SELECT *, CASE WHEN done < 5 THEN (5 - done) / (9 - done) END AS r FROM s)
    SELECT c_custkey, round(mu * r, 9) AS mu, round(alpha * r, 9) AS alpha, round(1 - pow(alpha / (alpha + mu / 9), alpha) * pow(2.5 / (2.5 + mu / 9), 2.5), 6) AS any_score FROM f""",
)
def period_scaling(spark: SparkSession, d: str) -> DataFrame:
    mu, alpha = B.scaled_to_period(F.col("mu"), F.col("alpha"), F.col("done"), 5.0, 9.0)
    first = F.col("mu") / 9
    return states(spark, d).select("c_custkey", F.round(mu, 9).alias("mu"), F.round(alpha, 9).alias("alpha"), F.round(B.any_score(first, F.col("alpha"), first, F.lit(2.5)), 6).alias("any_score"))


@query("split_total", f"WITH {_S} SELECT c_custkey, round((mu + 0.7) / 2, 9) AS home, round((mu - 0.7) / 2, 9) AS away, round(sqrt(mu * mu + alpha * alpha) / 2, 9) AS sd FROM s")
def split_total(spark: SparkSession, d: str) -> DataFrame:
    parts = B.split_total(F.col("mu"), F.lit(0.7), F.col("mu"), F.col("alpha"))
    return states(spark, d).select("c_custkey", *[F.round(v, 9).alias(k) for k, v in parts.items()])


@query(
    "taker_check",
    """WITH b AS (SELECT event_id, event_id * 31 % 99 + 1 AS bid, event_id * 17 % 99 + 1 AS ask, CAST(event_id * 7 % 99 + 1 AS BIGINT) AS fair FROM events)
    SELECT event_id, CASE WHEN ask < fair AND (fair - ask) / 100.0 >= 0.1 THEN 'yes' WHEN bid > fair AND (bid - fair) / 100.0 >= 0.1 THEN 'no' END AS side FROM b""",
)
def taker_check(spark: SparkSession, d: str) -> DataFrame:
    tick = lambda k: F.col("event_id") * k % 99 + 1
    return table(spark, d, "events").select("event_id", B.taker(tick(31), tick(17), tick(7), F.lit(0.1)).alias("side"))


@query(
    "hold_or_exit",
    """WITH p AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'HIGH' WHEN 'O' THEN 'MEDIUM' ELSE 'LOW' END AS tier, o_orderkey % 13 / 10.0 AS acc, o_orderkey % 7 / 100.0 AS edge FROM orders)
    SELECT o_orderkey, CASE WHEN tier = 'HIGH' AND acc >= 1 THEN 'hold' WHEN tier = 'LOW' OR acc < 0.7 OR edge < 0.02 THEN 'exit' ELSE 'hold' END AS state FROM p""",
)
def hold_or_exit(spark: SparkSession, d: str) -> DataFrame:
    status = F.col("o_orderstatus")
    tier = F.when(status == "F", "HIGH").when(status == "O", "MEDIUM").otherwise("LOW")
    return table(spark, d, "orders").select("o_orderkey", B.hold_or_exit(tier, F.col("o_orderkey") % 13 / 10.0, F.col("o_orderkey") % 7 / 100.0).alias("state"))


@query("quote_generation", "WITH q AS (SELECT s_suppkey, abs(s_acctbal) / 110 AS fair, s_suppkey % 5 + 0.5 AS half FROM supplier) SELECT s_suppkey, CASE WHEN half >= 2 THEN greatest(1, CAST(floor(fair - half) AS INT)) END AS bid, CASE WHEN half >= 2 THEN least(99, CAST(ceil(fair + half) AS INT)) END AS ask FROM q")
def quote_generation(spark: SparkSession, d: str) -> DataFrame:
    q = B.quotes(F.abs("s_acctbal") / 110, F.col("s_suppkey") % 5 + 0.5, F.lit(2.0))
    return table(spark, d, "supplier").select("s_suppkey", *[v.alias(k) for k, v in q.items()])


@query(
    "interpolated_time",
    """WITH b AS (SELECT user_id, min(ts) AS a, max(ts) AS z FROM events GROUP BY 1), e AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events)
    SELECT event_id, CAST(epoch_us(a) + (epoch_us(z) - epoch_us(a)) * k // n AS BIGINT) AS micros FROM e JOIN b USING (user_id)""",
)
def interpolated_time(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    by = W.partitionBy("user_id")
    k = F.row_number().over(by.orderBy("ts", "event_id")) - 1
    return e.select("event_id", F.min("us").over(by).alias("a"), F.max("us").over(by).alias("z"), k.alias("k"), F.count(F.lit(1)).over(by).alias("n")).select("event_id", F.expr("a + (z - a) * k DIV n").alias("micros"))


@query("grid_decisions", "SELECT r_regionkey, d, t, TIMESTAMP '2024-05-01 19:00:00' + to_hours(CAST(d AS INT)) AS decision, TIMESTAMP '2024-05-01 19:00:00' + to_hours(CAST(t AS INT)) AS target FROM region, range(0, 7) x(d), range(-1, 6) y(t)")
def grid_decisions(spark: SparkSession, d: str) -> DataFrame:
    games = table(spark, d, "region").select("r_regionkey", F.expr("TIMESTAMP_NTZ '2024-05-01 19:00:00'").alias("hour"))
    out = S.hour_grid(games, "hour", (0, 6), (-1, 5))
    return out.select("r_regionkey", F.col("d").cast("long").alias("d"), F.col("t").cast("long").alias("t"), "decision", "target")


@query("state_grid", "WITH a AS (SELECT user_id, CAST(ts AS DATE) AS day, event_id FROM events WHERE event_type = 'signup'), b AS (SELECT user_id, CAST(ts AS DATE) AS day, event_id FROM events WHERE event_type = 'error') SELECT a.event_id AS state_id, b.event_id AS ticker_id FROM a JOIN b ON a.user_id = b.user_id AND a.day = b.day")
def state_grid(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", F.to_date("ts").alias("day"), "event_id", "event_type")
    side = lambda k, n: e.where(F.col("event_type") == k).select("user_id", "day", F.col("event_id").alias(n))
    return side("signup", "state_id").join(side("error", "ticker_id"), ["user_id", "day"]).select("state_id", "ticker_id")


@query(
    "reprice_triggers",
    """SELECT event_id, CASE WHEN event_type = 'purchase' THEN 'scoring' WHEN event_type = 'error' THEN 'out' WHEN event_type = 'signup' THEN 'walk' WHEN v - value >= 300 THEN 'drop' END AS trigger FROM (SELECT event_id, event_type, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS v FROM events)""",
)
def reprice_triggers(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    drop = F.lag("value").over(W.partitionBy("user_id").orderBy("ts", "event_id")) - F.col("value")
    rules = F.when(kind == "purchase", "scoring").when(kind == "error", "out").when(kind == "signup", "walk").when(drop >= 300, "drop")
    return table(spark, d, "events").select("event_id", rules.alias("trigger"))
