"""Event rows as deliveries of a contest: a user's day is a start, its events are in time order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from chronolake.operators import pitches as P, prior
from chronolake.plans.registry import query
from chronolake.runtime import table

_P = """p AS (SELECT event_id, user_id, CAST(ts AS DATE) AS day, ts, event_type AS kind, 70 + value / 15 AS speed, CAST(event_id * 7 % 100 - 30 AS DOUBLE) AS angle,
    CAST(event_id * 13 % 250 AS DOUBLE) AS x, CAST(event_id * 17 % 200 AS DOUBLE) AS y, event_id % 2 = 0 AS rh FROM events)"""


def deliveries(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    num = lambda s: F.expr(f"CAST({s} AS DOUBLE)")
    return e.select(
        "event_id", "user_id", F.to_date("ts").alias("day"), "ts", F.col("event_type").alias("kind"), (70 + F.col("value") / 15).alias("speed"),
        num("event_id * 7 % 100 - 30").alias("angle"), num("event_id * 13 % 250").alias("x"), num("event_id * 17 % 200").alias("y"), (F.col("event_id") % 2 == 0).alias("rh"),
    )


_BARREL = "(speed >= 98 AND angle BETWEEN greatest(8, least(26, 26 - 2 * (speed - 98))) AND greatest(30, least(50, 30 + 2 * (speed - 98))))"


@query(
    "contact_quality",
    f"""WITH {_P} SELECT user_id, round(avg(CAST({_BARREL} AS INT)), 6) AS barrel, round(avg(CAST(speed >= 95 AS INT)), 6) AS hard, round(avg(CAST(angle BETWEEN 8 AND 32 AS INT)), 6) AS sweet FROM p GROUP BY 1""",
)
def contact_quality(spark: SparkSession, d: str) -> DataFrame:
    speed, angle = F.col("speed"), F.col("angle")
    out = P.shares(deliveries(spark, d), ["user_id"], {"barrel": P.barrel(speed, angle), "hard": speed >= 95, "sweet": angle.between(8, 32)})
    return out.select("user_id", *[F.round(c, 6).alias(c) for c in ("barrel", "hard", "sweet")])


@query(
    "contact_quality_roll",
    f"""WITH {_P}, g AS (SELECT user_id, day, avg(CAST(speed >= 95 AS INT)) AS hard FROM p GROUP BY 1, 2),
    r AS (SELECT *, avg(hard) OVER w AS m, count(hard) OVER w AS c FROM g WINDOW w AS (PARTITION BY user_id ORDER BY day ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING))
    SELECT user_id, day, round(CASE WHEN c >= 2 THEN m END, 6) AS hard_roll5 FROM r""",
)
def contact_quality_roll(spark: SparkSession, d: str) -> DataFrame:
    starts = P.shares(deliveries(spark, d), ["user_id", "day"], {"hard": F.col("speed") >= 95})
    w, prior5 = F.col("hard"), prior.W.partitionBy("user_id").orderBy("day").rowsBetween(-5, -1)
    return starts.select("user_id", "day", F.round(F.when(F.count(w).over(prior5) >= 2, F.avg(w).over(prior5)), 6).alias("hard_roll5"))


@query(
    "spray_shares",
    f"""WITH {_P}, a AS (SELECT *, degrees(atan2(x - 125, 200 - y)) AS ang FROM p),
    s AS (SELECT user_id, CASE WHEN ang BETWEEN -15 AND 15 THEN 'center' WHEN (ang < 0) = rh THEN 'pull' ELSE 'oppo' END AS s FROM a)
    SELECT user_id, round(avg(CAST(s = 'pull' AS INT)), 6) AS pull, round(avg(CAST(s = 'center' AS INT)), 6) AS center, round(avg(CAST(s = 'oppo' AS INT)), 6) AS oppo FROM s GROUP BY 1""",
)
def spray_shares(spark: SparkSession, d: str) -> DataFrame:
    way = P.spray(F.col("x"), F.col("y"), F.col("rh"))
    out = P.shares(deliveries(spark, d).withColumn("s", way), ["user_id"], {n: F.col("s") == n for n in ("pull", "center", "oppo")})
    return out.select("user_id", *[F.round(c, 6).alias(c) for c in ("pull", "center", "oppo")])


@query(
    "rate_aggregates",
    f"""WITH {_P} SELECT user_id, day, round(avg(CAST(kind <> 'error' AS INT)), 6) AS zone, round(avg(CAST(kind IN ('click', 'purchase') AS INT)), 6) AS swing,
    round(sum(CAST(kind = 'error' AND rh AS INT)) / nullif(sum(CAST(kind = 'error' AS INT)), 0), 6) AS chase, count(*) AS n FROM p GROUP BY 1, 2""",
)
def rate_aggregates(spark: SparkSession, d: str) -> DataFrame:
    kind, p = F.col("kind"), deliveries(spark, d)
    return p.groupBy("user_id", "day").agg(
        F.round(F.avg((kind != "error").cast("int")), 6).alias("zone"), F.round(F.avg(kind.isin("click", "purchase").cast("int")), 6).alias("swing"),
        F.round(P.ratio(F.col("rh"), kind == "error"), 6).alias("chase"), F.count(F.lit(1)).alias("n"),
    )


@query(
    "start_fatigue",
    f"""WITH {_P}, s AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM p)
    SELECT user_id, round(avg(speed) FILTER (k >= 45) - avg(speed) FILTER (k <= 15), 6) AS decay, round(stddev_samp(speed), 6) AS deviation, count(*) AS n FROM s GROUP BY 1""",
)
def start_fatigue(spark: SparkSession, d: str) -> DataFrame:
    out = P.fatigue(deliveries(spark, d), ["user_id"], ["ts", "event_id"], "speed", 15, 45)
    return out.select("user_id", F.round("decay", 6).alias("decay"), F.round("deviation", 6).alias("deviation"), "n")


@query(
    "movement_by_kind",
    f"""WITH {_P} SELECT user_id, {', '.join(f"round(avg(speed) FILTER (kind = '{k}'), 6) AS {k}_speed" for k in ('view', 'click', 'purchase'))}, round(avg(x) FILTER (kind = 'view') / avg(x), 6) AS x_trend FROM p GROUP BY 1""",
)
def movement_by_kind(spark: SparkSession, d: str) -> DataFrame:
    mean = lambda c, k: F.avg(F.when(F.col("kind") == k, F.col(c)))
    return deliveries(spark, d).groupBy("user_id").agg(*[F.round(mean("speed", k), 6).alias(f"{k}_speed") for k in ("view", "click", "purchase")], F.round(F.try_divide(mean("x", "view"), F.avg("x")), 6).alias("x_trend"))


@query(
    "terminal_rows",
    f"""WITH {_P} SELECT user_id, day, event_id, kind FROM p WHERE kind IN ('purchase', 'signup', 'error') QUALIFY row_number() OVER (PARTITION BY user_id, day ORDER BY ts, event_id) = 1""",
)
def terminal_rows(spark: SparkSession, d: str) -> DataFrame:
    p = deliveries(spark, d).where(F.col("kind").isin("purchase", "signup", "error"))
    return P.first_where(p, ["user_id", "day"], F.lit(True), [F.col("ts"), F.col("event_id")], ["event_id", "kind"])


@query(
    "starter_pick",
    f"""WITH {_P} SELECT day, event_id, user_id, kind FROM p QUALIFY row_number() OVER (PARTITION BY day ORDER BY (kind <> 'signup')::INT, ts, event_id) = 1""",
)
def starter_pick(spark: SparkSession, d: str) -> DataFrame:
    return P.first_where(deliveries(spark, d), ["day"], F.col("kind") == "signup", [F.col("ts"), F.col("event_id")], ["event_id", "user_id", "kind"])


@query("side_sum_map", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS l_quantity_sum, round(sum(l_tax), 2) AS l_tax_sum, round(avg(l_discount), 6) AS l_discount_mean FROM lineitem GROUP BY 1, 2")
def side_sum_map(spark: SparkSession, d: str) -> DataFrame:
    out = P.summed_map(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], ["l_quantity", "l_tax", "absent"], ["l_discount", "missing"])
    return out.select("l_returnflag", "l_linestatus", F.round("l_quantity_sum", 2).alias("l_quantity_sum"), F.round("l_tax_sum", 2).alias("l_tax_sum"), F.round("l_discount_mean", 6).alias("l_discount_mean"))


@query(
    "box_line",
    """WITH c AS (SELECT user_id, count(*) FILTER (event_type <> 'error') AS h, count(*) FILTER (event_type = 'click') AS d, count(*) FILTER (event_type = 'purchase') AS t, count(*) FILTER (event_type = 'signup') AS r FROM events GROUP BY 1)
    SELECT user_id, greatest(h - d - t - r, 0) AS singles, greatest(h - d - t - r, 0) + 2 * d + 3 * t + 4 * r AS total_bases FROM c""",
)
def box_line(spark: SparkSession, d: str) -> DataFrame:
    n = lambda k: F.count(F.when(F.col("event_type") == k, 1))
    c = table(spark, d, "events").groupBy("user_id").agg(F.count(F.when(F.col("event_type") != "error", 1)).alias("h"), n("click").alias("d"), n("purchase").alias("t"), n("signup").alias("r"))
    return c.select("user_id", *[v.alias(k) for k, v in P.box_line(*[F.col(x) for x in "hdtr"]).items()])


@query(
    "player_targets",
    """WITH c AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) FILTER (event_type <> 'error') AS pa, count(*) FILTER (event_type = 'purchase') AS hits FROM events GROUP BY 1, 2)
    SELECT user_id, day, hits, CASE WHEN pa = 0 THEN 'no_appearance' WHEN pa = 1 THEN 'substitute' ELSE 'trainable' END AS status FROM c""",
)
def player_targets(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count(F.when(F.col("event_type") != "error", 1)).alias("pa"), F.count(F.when(F.col("event_type") == "purchase", 1)).alias("hits"))
    return c.select("user_id", "day", "hits", F.when(F.col("pa") == 0, "no_appearance").when(F.col("pa") == 1, "substitute").otherwise("trainable").alias("status"))


@query(
    "remaining_target",
    f"""WITH {_P}, s AS (SELECT *, sum(CAST(kind = 'purchase' AS INT)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS score, sum(CAST(kind = 'purchase' AS INT)) OVER (PARTITION BY user_id) AS final FROM p)
    SELECT event_id, CAST(greatest(final - score, 0) AS BIGINT) AS remaining FROM s""",
)
def remaining_target(spark: SparkSession, d: str) -> DataFrame:
    p = deliveries(spark, d).withColumn("hit", (F.col("kind") == "purchase").cast("int"))
    scored = prior.W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(prior.W.unboundedPreceding, 0)
    score = F.sum("hit").over(scored)
    final = F.sum("hit").over(prior.W.partitionBy("user_id"))
    return p.select("event_id", F.greatest(final - score, F.lit(0)).cast("long").alias("remaining"))


@query("grid_patterns", "SELECT CAST(l_quantity AS INT) % 4 AS balls, l_linenumber % 3 AS strikes, count(*) AS n, round(avg(l_extendedprice), 4) AS mean_price FROM lineitem GROUP BY 1, 2")
def grid_patterns(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    return li.groupBy((F.col("l_quantity").cast("int") % 4).alias("balls"), (F.col("l_linenumber") % 3).alias("strikes")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("l_extendedprice"), 4).alias("mean_price"))


@query(
    "platoon_share_roll",
    f"""WITH {_P}, g AS (SELECT user_id, day, avg(CAST(rh AS INT)) AS s FROM p GROUP BY 1, 2)
    SELECT user_id, day, round(avg(s) OVER w, 6) AS share, round(abs(avg(s) OVER w - 0.5), 6) AS divergence FROM g WINDOW w AS (PARTITION BY user_id ORDER BY day ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)""",
)
def platoon_share_roll(spark: SparkSession, d: str) -> DataFrame:
    g = P.shares(deliveries(spark, d), ["user_id", "day"], {"s": F.col("rh")})
    m = F.avg("s").over(prior.W.partitionBy("user_id").orderBy("day").rowsBetween(-20, -1))
    return g.select("user_id", "day", F.round(m, 6).alias("share"), F.round(F.abs(m - 0.5), 6).alias("divergence"))


@query(
    "strength_roll",
    f"""WITH {_P}, g AS (SELECT user_id, day, avg(sqrt(x * x + y * y)) AS dist, sum(CAST(kind = 'purchase' AS INT)) AS tb, count(*) AS h FROM p GROUP BY 1, 2)
    SELECT user_id, day, round(avg(dist) OVER w, 6) AS dist_roll10, round(sum(tb) OVER w / nullif(sum(h) OVER w, 0), 6) AS tb_per_hit FROM g WINDOW w AS (PARTITION BY user_id ORDER BY day ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)""",
)
def strength_roll(spark: SparkSession, d: str) -> DataFrame:
    g = deliveries(spark, d).groupBy("user_id", "day").agg(F.avg(F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y"))).alias("dist"), F.sum((F.col("kind") == "purchase").cast("int")).alias("tb"), F.count(F.lit(1)).alias("h"))
    w = prior.W.partitionBy("user_id").orderBy("day").rowsBetween(-10, -1)
    return g.select("user_id", "day", F.round(F.avg("dist").over(w), 6).alias("dist_roll10"), F.round(F.try_divide(F.sum("tb").over(w), F.sum("h").over(w)), 6).alias("tb_per_hit"))


@query(
    "manager_tendencies",
    f"""WITH {_P}, g AS (SELECT user_id, day, count(DISTINCT kind) AS used, avg(CAST(kind = 'error' AS INT)) AS bunt FROM p GROUP BY 1, 2)
    SELECT user_id, day, round(avg(used) OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), 6) AS used_roll10,
    round(avg(bunt) OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), 6) AS bunt_roll20 FROM g""",
)
def manager_tendencies(spark: SparkSession, d: str) -> DataFrame:
    g = deliveries(spark, d).groupBy("user_id", "day").agg(F.countDistinct("kind").alias("used"), F.avg((F.col("kind") == "error").cast("int")).alias("bunt"))
    w = lambda n: prior.W.partitionBy("user_id").orderBy("day").rowsBetween(-n, -1)
    return g.select("user_id", "day", F.round(F.avg("used").over(w(10)), 6).alias("used_roll10"), F.round(F.avg("bunt").over(w(20)), 6).alias("bunt_roll20"))


@query(
    "net_exposure",
    """WITH e AS (SELECT user_id, count(DISTINCT event_type) AS m, count(*) AS n, sum(value / 100) AS cost FROM events GROUP BY 1)
    SELECT user_id, round(cost, 6) AS cost, round(CASE WHEN n < 2 OR m < 2 THEN cost ELSE greatest(0, cost - least(m - 1, n - 1)) END, 6) AS exposure FROM e""",
)
def net_exposure(spark: SparkSession, d: str) -> DataFrame:
    out = P.net_exposure(table(spark, d, "events"), "user_id", "event_type", F.col("value") / 100)
    return out.select("user_id", F.round("cost", 6).alias("cost"), F.round("exposure", 6).alias("exposure"))


@query("cluster_inventory", "SELECT p_brand, n_name, CAST(sum(l_quantity) AS BIGINT) AS held FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2")
def cluster_inventory(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return li.groupBy("p_brand", "n_name").agg(F.sum("l_quantity").cast("long").alias("held"))
