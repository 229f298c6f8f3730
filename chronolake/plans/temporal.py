"""Prior-only windows, timelines and sequences over orders, lineitem and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from chronolake.operators import prior as P
from chronolake.operators.timeline import unified_timeline
from chronolake.plans.registry import query
from chronolake.runtime import table

KEYS, ORDER = ["o_custkey"], ["o_orderdate", "o_orderkey"]
W_SQL = "PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey"


#: Whole cents: sums are exact, so both engines give the same means whatever the order.
CENTS = "CAST(round(o_totalprice * 100) AS BIGINT)"


def orders(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice", F.expr(CENTS).alias("cents"), *cols)


def events(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    return table(spark, d, "events").select("user_id", "event_id", "ts", "value", *cols)


def gate(agg: str, rows: str, least: int, x: str = "o_totalprice", w: str = W_SQL) -> str:
    """SQL of an aggregate over a prior frame, null below ``least`` values."""
    return f"CASE WHEN count({x}) OVER ({w} ROWS BETWEEN {rows} PRECEDING AND 1 PRECEDING) >= {least} THEN {agg} OVER ({w} ROWS BETWEEN {rows} PRECEDING AND 1 PRECEDING) END"


@query(
    "roll_mean_prior",
    f"SELECT o_custkey, o_orderkey, {gate(f'avg({CENTS})', '5', 3)} AS mean_5, {gate(f'avg({CENTS})', '10', 5)} AS mean_10, {gate(f'avg({CENTS})', '20', 10)} AS mean_20 FROM orders",
)
def roll_mean_prior(spark: SparkSession, d: str) -> DataFrame:
    w = P.ordered(KEYS, ORDER)
    return orders(spark, d).select("o_custkey", "o_orderkey", *[P.rolling("cents", w, n, P.default_least(n)).alias(f"mean_{n}") for n in (5, 10, 20)])


@query(
    "roll_std_prior",
    f"SELECT o_custkey, o_orderkey, round({gate('stddev_samp(o_totalprice)', '10', 3)}, 4) AS std_10, round({gate('max(o_totalprice)', '10', 3)}, 4) AS max_10 FROM orders",
)
def roll_std_prior(spark: SparkSession, d: str) -> DataFrame:
    w = P.ordered(KEYS, ORDER)
    return orders(spark, d).select("o_custkey", "o_orderkey", F.round(P.rolling("o_totalprice", w, 10, 3, "stddev_samp"), 4).alias("std_10"), F.round(P.rolling("o_totalprice", w, 10, 3, "max"), 4).alias("max_10"))


EVENT_W = "PARTITION BY user_id ORDER BY ts, event_id"
_num = "(CASE WHEN event_type = 'purchase' THEN value ELSE 0 END)"


@query(
    "roll_ratio_prior",
    f"""SELECT user_id, event_id, round(CASE WHEN count(value) OVER f >= 5 THEN sum({_num}) OVER f / sum(value) OVER f END, 6) AS share_10,
    round(CASE WHEN count(value) OVER g >= 10 THEN sum({_num}) OVER g / sum(value) OVER g END, 6) AS share_50
    FROM events WINDOW f AS ({EVENT_W} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), g AS ({EVENT_W} ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING)""",
)
def roll_ratio_prior(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d, "event_type").withColumn("bought", F.when(F.col("event_type") == "purchase", F.col("value")).otherwise(0.0))
    w = P.ordered(["user_id"], ["ts", "event_id"])
    return e.select("user_id", "event_id", F.round(P.rolling_ratio("bought", "value", w, 10, 5), 6).alias("share_10"), F.round(P.rolling_ratio("bought", "value", w, 50, 10), 6).alias("share_50"))


@query("expanding_gate", f"SELECT o_custkey, o_orderkey, {gate(f'avg({CENTS})', 'UNBOUNDED', 5)} AS mean_all, count(*) OVER ({W_SQL} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n_before FROM orders")
def expanding_gate(spark: SparkSession, d: str) -> DataFrame:
    w = P.ordered(KEYS, ORDER)
    return orders(spark, d).select("o_custkey", "o_orderkey", P.rolling("cents", w, None, 5).alias("mean_all"), F.count(F.lit(1)).over(P.before(w)).alias("n_before"))


@query(
    "expanding_ratio",
    """WITH d AS (SELECT l_suppkey, CAST(l_shipdate AS DATE) AS day, sum(l_extendedprice * l_discount) AS off, sum(l_extendedprice) AS price FROM lineitem GROUP BY 1, 2)
    SELECT l_suppkey, day, round(CASE WHEN count(off) OVER f >= 5 THEN avg(off) OVER f / greatest(avg(price) OVER f, 1.0) END, 6) AS ratio
    FROM d WINDOW f AS (PARTITION BY l_suppkey ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
)
def expanding_ratio(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").groupBy("l_suppkey", F.col("l_shipdate").cast("date").alias("day")).agg(F.sum(F.col("l_extendedprice") * F.col("l_discount")).alias("off"), F.sum("l_extendedprice").alias("price"))
    return li.select("l_suppkey", "day", F.round(P.expanding_ratio_of_means("off", "price", P.ordered(["l_suppkey"], ["day"]), 5, 1.0), 6).alias("ratio"))


@query(
    "ewma_prior",
    f"""WITH p AS (SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice AS x, row_number() OVER ({W_SQL}) AS i FROM orders)
    SELECT o_custkey, o_orderkey, round(CASE WHEN count(x) OVER f >= 5 THEN sum(x * pow(2.0, i / 15.0)) OVER f / sum(pow(2.0, i / 15.0)) OVER f END, 4) AS ewma
    FROM p WINDOW f AS ({W_SQL} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
)
def ewma_prior(spark: SparkSession, d: str) -> DataFrame:
    return P.with_ewma(orders(spark, d), "o_totalprice", KEYS, ORDER, 15.0, 5, "ewma").select("o_custkey", "o_orderkey", F.round("ewma", 4).alias("ewma"))


@query(
    "streak_prior",
    f"""WITH b AS (SELECT user_id, event_id, ts, CASE WHEN event_type = 'error' THEN NULL ELSE value > 100 END AS won FROM events),
    k AS (SELECT *, row_number() OVER ({EVENT_W}) - row_number() OVER (PARTITION BY user_id, won ORDER BY ts, event_id) AS island FROM b WHERE won IS NOT NULL),
    r AS (SELECT event_id, CASE WHEN won THEN 1 ELSE -1 END * row_number() OVER (PARTITION BY user_id, won, island ORDER BY ts, event_id) AS run FROM k)
    SELECT b.user_id, b.event_id, CAST(last_value(r.run IGNORE NULLS) OVER (PARTITION BY b.user_id ORDER BY b.ts, b.event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS INTEGER) AS streak
    FROM b LEFT JOIN r ON b.event_id = r.event_id""",
)
def streak_prior(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d, "event_type").withColumn("won", F.when(F.col("event_type") != "error", F.col("value") > 100))
    return P.streak(e, "won", ["user_id"], ["ts", "event_id"], "streak").select("user_id", "event_id", F.col("streak").cast("int").alias("streak"))


@query("days_since_last", f"SELECT o_custkey, o_orderkey, date_diff('day', lag(CAST(o_orderdate AS DATE)) OVER ({W_SQL}), CAST(o_orderdate AS DATE)) AS days FROM orders")
def days_since_last(spark: SparkSession, d: str) -> DataFrame:
    return orders(spark, d).select("o_custkey", "o_orderkey", P.days_since("o_orderdate", P.ordered(KEYS, ORDER)).alias("days"))


_R = "PARTITION BY user_id ORDER BY CAST(ts AS DATE) RANGE BETWEEN INTERVAL {} DAY PRECEDING AND INTERVAL 1 DAY PRECEDING"


@query(
    "calendar_3d_7d",
    f"""SELECT user_id, event_id, count(*) OVER ({_R.format(7)}) AS n_7d, round(coalesce(sum(value) OVER ({_R.format(3)}), 0), 4) AS sum_3d, round(coalesce(sum(value) OVER ({_R.format(7)}), 0), 4) AS sum_7d FROM events""",
)
def calendar_3d_7d(spark: SparkSession, d: str) -> DataFrame:
    s = lambda n, how="sum": P.calendar_sum("value", ["user_id"], "ts", n, how)
    return events(spark, d).select("user_id", "event_id", s(7, "count").alias("n_7d"), F.round(s(3), 4).alias("sum_3d"), F.round(s(7), 4).alias("sum_7d"))


_ROLES = """WITH g AS (SELECT l_orderkey, l_shipdate, s.s_nationkey AS home, c.c_nationkey AS away, l_quantity AS hs, l_extendedprice / 1000 AS aws, l_partkey, l_suppkey, l_linenumber,
    row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS game
    FROM lineitem JOIN supplier s ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer c ON o_custkey = c_custkey)"""


def games(spark: SparkSession, d: str) -> DataFrame:
    """Contests of supplier and customer nations, one a line item, with a total order."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey", "l_linenumber", "l_shipdate", "l_quantity", "l_extendedprice")
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("home"))
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("away"))
    return li.join(s, "l_suppkey").join(o, "l_orderkey").join(c, "o_custkey").select("l_orderkey", "l_shipdate", "home", "away", F.col("l_quantity").alias("hs"), (F.col("l_extendedprice") / 1000).alias("aws"), "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice")


@query(
    "unified_timeline_form",
    """WITH g AS (SELECT date_trunc('day', l_shipdate) AS day, s.s_nationkey AS home, c.c_nationkey AS away, sum(l_quantity) AS hs, sum(l_linenumber) AS aws
      FROM lineitem JOIN supplier s ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer c ON o_custkey = c_custkey GROUP BY 1, 2, 3),
    t AS (SELECT day, home, away, 'home' AS role, home AS team, hs AS scored FROM g UNION ALL SELECT day, home, away, 'away', away, aws FROM g),
    w AS (SELECT *, CASE WHEN count(scored) OVER f >= 5 THEN avg(scored) OVER f END AS form FROM t WINDOW f AS (PARTITION BY team ORDER BY day, role, home, away ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING))
    SELECT day, home, away, round(max(CASE WHEN role = 'home' THEN form END), 4) AS home_form, round(max(CASE WHEN role = 'away' THEN form END), 4) AS away_form FROM w GROUP BY day, home, away""",
)
def unified_timeline_form(spark: SparkSession, d: str) -> DataFrame:
    g = games(spark, d).groupBy(F.date_trunc("day", "l_shipdate").alias("day"), "home", "away").agg(F.sum("hs").alias("hs"), F.sum("l_linenumber").cast("double").alias("aws"))
    return unified_timeline(
        g.withColumn("day", F.col("day").cast("timestamp_ntz")), ["day", "home", "away"], {"home": ("home", {"scored": "hs"}), "away": ("away", {"scored": "aws"})}, ["day", "role", "home", "away"],
        {"form": lambda w: P.rolling("scored", w, 10, 5)},
    ).select("day", "home", "away", F.round("home_form", 4).alias("home_form"), F.round("away_form", 4).alias("away_form"))


@query(
    "h2h_symmetric",
    """WITH p AS (SELECT o_orderkey, o_orderdate, CAST(round(o_totalprice * 100) AS BIGINT) AS cents, least(CAST(c_nationkey AS VARCHAR), o_orderstatus) || '|' || greatest(CAST(c_nationkey AS VARCHAR), o_orderstatus) AS pair FROM orders JOIN customer ON o_custkey = c_custkey)
    SELECT o_orderkey, pair, CASE WHEN count(cents) OVER f >= 3 THEN avg(cents) OVER f END AS h2h FROM p WINDOW f AS (PARTITION BY pair ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)""",
)
def h2h_symmetric(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    p = orders(spark, d, "o_orderstatus").join(c, "o_custkey").withColumn("pair", P.pair_key("c_nationkey", "o_orderstatus"))
    return p.select("o_orderkey", "pair", P.rolling("cents", P.ordered(["pair"], ORDER), 10, 3).alias("h2h"))


@query("season_reset_roll", f"SELECT o_custkey, o_orderkey, {gate(f'avg({CENTS})', '5', 2, w='PARTITION BY o_custkey, year(o_orderdate) ORDER BY o_orderdate, o_orderkey')} AS mean_5 FROM orders")
def season_reset_roll(spark: SparkSession, d: str) -> DataFrame:
    w = P.ordered(["o_custkey", F.year("o_orderdate")], ORDER)
    return orders(spark, d).select("o_custkey", "o_orderkey", P.rolling("cents", w, 5, 2).alias("mean_5"))


@query("trailing_inclusive", f"SELECT user_id, event_id, round(sum(value) OVER ({EVENT_W} ROWS BETWEEN 5 PRECEDING AND CURRENT ROW), 4) AS sum_6, round(sum(value) OVER ({EVENT_W} ROWS BETWEEN 23 PRECEDING AND CURRENT ROW), 4) AS sum_24 FROM events")
def trailing_inclusive(spark: SparkSession, d: str) -> DataFrame:
    w = P.ordered(["user_id"], ["ts", "event_id"])
    return events(spark, d).select("user_id", "event_id", F.round(P.trailing("value", w, 6), 4).alias("sum_6"), F.round(P.trailing("value", w, 24), 4).alias("sum_24"))


@query(
    "history_array",
    f"""SELECT user_id, event_id, array_to_string(list_concat(list_transform(range(0, 4 - coalesce(len(h), 0)), lambda x: '-'), coalesce(h, [])), ',') AS last_4 FROM
    (SELECT user_id, event_id, list(event_type) OVER ({EVENT_W} ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS h FROM events)""",
)
def history_array(spark: SparkSession, d: str) -> DataFrame:
    w = P.ordered(["user_id"], ["ts", "event_id"])
    return events(spark, d, "event_type").select("user_id", "event_id", F.array_join(P.history("event_type", w, 4, F.lit("-")), ",").alias("last_4"))


@query("running_max_floor", f"SELECT user_id, event_id, max(greatest(value, 50.0)) OVER ({EVENT_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS peak FROM events")
def running_max_floor(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).select("user_id", "event_id", P.running_max("value", F.lit(50.0), P.ordered(["user_id"], ["ts", "event_id"])).alias("peak"))


@query("ffill_group", f"SELECT user_id, event_id, coalesce(last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER ({EVENT_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0.0) AS last_buy FROM events")
def ffill_group(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d, "event_type").withColumn("buy", F.when(F.col("event_type") == "purchase", F.col("value")))
    return e.select("user_id", "event_id", P.fill_forward("buy", P.ordered(["user_id"], ["ts", "event_id"]), F.lit(0.0)).alias("last_buy"))


@query(
    "gap_since_seen",
    f"""WITH g AS (SELECT *, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER ({EVENT_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS isl FROM events),
    c AS (SELECT *, sum(CASE WHEN event_type = 'purchase' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id, isl ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS gap FROM g)
    SELECT user_id, event_id, CAST(lag(gap) OVER ({EVENT_W}) AS BIGINT) AS gap FROM c""",
)
def gap_since_seen(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d, "event_type").withColumn("seen", F.col("event_type") == "purchase")
    return P.gap_since(e, "seen", ["user_id"], ["ts", "event_id"], "gap").select("user_id", "event_id", F.col("gap").cast("long").alias("gap"))


@query("trend_ratio", f"SELECT o_custkey, o_orderkey, round({gate(f'avg({CENTS})', '3', 3)} / {gate(f'avg({CENTS})', '10', 5)}, 6) AS trend FROM orders")
def trend_ratio(spark: SparkSession, d: str) -> DataFrame:
    w = P.ordered(KEYS, ORDER)
    return orders(spark, d).select("o_custkey", "o_orderkey", F.round(P.rolling("cents", w, 3, 3) / P.rolling("cents", w, 10, 5), 6).alias("trend"))


@query(
    "prior_totals",
    f"""SELECT o_custkey, o_orderkey, CAST(coalesce(sum({CENTS}) OVER f, 0) AS BIGINT) AS total_before, row_number() OVER ({W_SQL}) - 1 AS games_before,
    round(least(1.0, count(*) OVER (PARTITION BY o_custkey, year(o_orderdate) ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) / 5.0), 6) AS progress
    FROM orders WINDOW f AS ({W_SQL} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
)
def prior_totals(spark: SparkSession, d: str) -> DataFrame:
    w = P.ordered(KEYS, ORDER)
    season = P.before(P.ordered(["o_custkey", F.year("o_orderdate")], ORDER))
    return orders(spark, d).select(
        "o_custkey", "o_orderkey", F.coalesce(F.sum("cents").over(P.before(w)), F.lit(0)).alias("total_before"),
        (F.row_number().over(w) - 1).cast("long").alias("games_before"), F.round(F.least(F.lit(1.0), F.count(F.lit(1)).over(season) / 5.0), 6).alias("progress"),
    )


@query(
    "decay_weights",
    """WITH p AS (SELECT o_custkey, o_orderkey, year(o_orderdate) AS y, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) - 1 AS age, max(year(o_orderdate)) OVER (PARTITION BY o_custkey) AS top FROM orders)
    SELECT o_custkey, o_orderkey, round(exp(-0.02 * age) * exp(-0.3 * (top - y)), 6) AS weight FROM p""",
)
def decay_weights(spark: SparkSession, d: str) -> DataFrame:
    back = W.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    p = orders(spark, d).select("o_custkey", "o_orderkey", (F.row_number().over(back) - 1).alias("age"), (F.max(F.year("o_orderdate")).over(W.partitionBy("o_custkey")) - F.year("o_orderdate")).alias("old"))
    return p.select("o_custkey", "o_orderkey", F.round(P.decay("age", 0.02) * P.decay("old", 0.3), 6).alias("weight"))


@query(
    "ranks_within_day",
    """WITH x AS (SELECT CAST(ts AS DATE) AS day, user_id, sum(CAST(round(value * 100) AS BIGINT)) AS v FROM events GROUP BY 1, 2)
    SELECT day, user_id, CAST(rank() OVER (PARTITION BY day ORDER BY v DESC) AS INTEGER) AS rank_min, rank() OVER (PARTITION BY day ORDER BY v) + (count(*) OVER (PARTITION BY day, v) - 1) / 2.0 AS rank_avg FROM x""",
)
def ranks_within_day(spark: SparkSession, d: str) -> DataFrame:
    x = events(spark, d).groupBy(F.col("ts").cast("date").alias("day"), "user_id").agg(F.sum(F.round(F.col("value") * 100).cast("long")).alias("v"))
    return x.select("day", "user_id", F.rank().over(W.partitionBy("day").orderBy(F.desc("v"))).alias("rank_min"), P.average_rank("v", ["day"]).alias("rank_avg"))


@query(
    "prefix_samples",
    """WITH n AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1), p AS (SELECT user_id, n, unnest(list_distinct(list_append(range(0, n, 5), n - 1))) AS pos FROM n),
    r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY pos) AS k, count(*) OVER (PARTITION BY user_id) AS m FROM p)
    SELECT user_id, pos AS prefix FROM r WHERE k <= 31 OR k = m""",
)
def prefix_samples(spark: SparkSession, d: str) -> DataFrame:
    n = events(spark, d).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    every = F.array_sort(F.array_union(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(5).cast("long")), F.array(F.col("n") - 1)))
    kept = F.when(F.size(every) <= 32, every).otherwise(F.concat(F.slice(every, 1, 31), F.slice(every, -1, 1)))
    return n.select("user_id", F.explode(kept).alias("prefix"))
