"""Conditional, two-level, profile and resampling aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from chronolake.operators import agg as G, quality as Q
from chronolake.plans.registry import query
from chronolake.runtime import table


@query(
    "cond_counts",
    """SELECT l_returnflag, count(*) AS n, count(*) FILTER (l_linestatus = 'O') AS n_open, count(*) FILTER (l_discount > 0.05) AS n_off, count(*) FILTER (l_quantity >= 25 AND l_tax > 0.04) AS n_big,
    round(coalesce(sum(l_extendedprice) FILTER (l_linestatus = 'X'), 0), 2) AS none_sum FROM lineitem GROUP BY 1""",
)
def cond_counts(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    return li.groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_linestatus") == "O").alias("n_open"), F.count_if(F.col("l_discount") > 0.05).alias("n_off"),
        F.count_if((F.col("l_quantity") >= 25) & (F.col("l_tax") > 0.04)).alias("n_big"), F.round(G.sum0(F.when(F.col("l_linestatus") == "X", F.col("l_extendedprice"))), 2).alias("none_sum"),
    )


@query(
    "period_sums",
    """SELECT l_orderkey, round(coalesce(sum(l_quantity) FILTER (l_linenumber <= 1), 0), 2) AS first_1, round(coalesce(sum(l_quantity) FILTER (l_linenumber <= 5), 0), 2) AS first_5, round(sum(l_quantity), 2) AS whole,
    max(l_linenumber) > 6 AS extra FROM lineitem GROUP BY 1""",
)
def period_sums(spark: SparkSession, d: str) -> DataFrame:
    upto = lambda n: F.round(G.sum0(F.when(F.col("l_linenumber") <= n, F.col("l_quantity"))), 2)
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(upto(1).alias("first_1"), upto(5).alias("first_5"), F.round(F.sum("l_quantity"), 2).alias("whole"), (F.max("l_linenumber") > 6).alias("extra"))


@query(
    "two_level_last_mean",
    """WITH x AS (SELECT user_id, CAST(ts AS DATE) AS day, event_type, arg_max(value, ts) AS v FROM events GROUP BY 1, 2, 3) SELECT user_id, day, round(avg(v), 4) AS mean_last FROM x GROUP BY 1, 2""",
)
def two_level_last_mean(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("day", F.col("ts").cast("date"))
    return G.last_then_mean(e, ["user_id", "day"], ["event_type"], ["ts"], "value", "mean_last").withColumn("mean_last", F.round("mean_last", 4))



@query(
    "profile_numeric",
    """WITH l AS (SELECT 'l_quantity' AS "column", l_quantity AS x FROM lineitem UNION ALL SELECT 'l_discount', l_discount FROM lineitem UNION ALL SELECT 'l_extendedprice', l_extendedprice FROM lineitem),
    m AS (SELECT "column", avg(x) AS mu FROM l GROUP BY 1),
    c AS (SELECT l."column", avg((x - mu) ** 2) AS m2, avg((x - mu) ** 3) AS m3, avg((x - mu) ** 4) AS m4 FROM l JOIN m ON l."column" = m."column" GROUP BY 1)
    SELECT l."column", count(*) AS n, count(*) FILTER (x IS NULL) AS n_null, count(*) FILTER (x = 0) AS n_zero, round(avg(x), 4) AS mean, round(stddev_pop(x), 4) AS std, round(quantile_cont(x, 0.05), 4) AS p5, round(quantile_cont(x, 0.5), 4) AS p50, round(quantile_cont(x, 0.95), 4) AS p95,
    round(any_value(m3 / pow(m2, 1.5)), 4) AS skew, round(any_value(m4 / (m2 * m2) - 3), 4) AS kurt FROM l JOIN c ON l."column" = c."column" GROUP BY 1""",
)
def profile_numeric(spark: SparkSession, d: str) -> DataFrame:
    p = G.profile(table(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_extendedprice"])
    return p.select("column", "n", "n_null", "n_zero", *[F.round(c, 4).alias(c) for c in ("mean", "std", "p5", "p50", "p95", "skew", "kurt")])


@query(
    "topk_categorical",
    """WITH l AS (SELECT 'o_orderpriority' AS "column", o_orderpriority AS value FROM orders UNION ALL SELECT 'o_orderstatus', o_orderstatus FROM orders UNION ALL SELECT 'o_custkey', CAST(o_custkey AS VARCHAR) FROM orders),
    c AS (SELECT "column", value, count(*) AS n FROM l GROUP BY 1, 2)
    SELECT "column", value, n, CAST(row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS INTEGER) AS place FROM c QUALIFY place <= 5""",
)
def topk_categorical(spark: SparkSession, d: str) -> DataFrame:
    return G.top_values(table(spark, d, "orders"), ["o_orderpriority", "o_orderstatus", "o_custkey"], 5)


_KINDS = ("view", "click", "purchase", "signup", "error")


@query("freq_simplex", "SELECT user_id, " + ", ".join(f"round(count(*) FILTER (event_type = '{k}') / count(*), 6) AS share_{k}" for k in _KINDS) + " FROM events GROUP BY 1")
def freq_simplex(spark: SparkSession, d: str) -> DataFrame:
    s = G.simplex(table(spark, d, "events"), ["user_id"], "event_type", list(_KINDS))
    return s.select("user_id", *[F.round(f"share_{k}", 6).alias(f"share_{k}") for k in _KINDS])


@query(
    "circular_mean",
    """WITH a AS (SELECT user_id, avg(sin(radians(value))) AS s, avg(cos(radians(value))) AS c, count(value) AS n FROM events GROUP BY 1)
    SELECT user_id, round(CASE WHEN n >= 5 AND sqrt(s * s + c * c) >= 0.1 THEN CASE WHEN degrees(atan2(s, c)) < 0 THEN degrees(atan2(s, c)) + 360 ELSE degrees(atan2(s, c)) END END, 4) AS direction, round(sqrt(s * s + c * c), 6) AS steadiness FROM a""",
)
def circular_mean(spark: SparkSession, d: str) -> DataFrame:
    mean, length = G.circular(F.col("value"), 5, 0.1)
    return table(spark, d, "events").groupBy("user_id").agg(F.round(mean, 4).alias("direction"), F.round(length, 6).alias("steadiness"))


@query(
    "cum_margin_pivot",
    """WITH x AS (SELECT l_orderkey, l_linenumber, sum(l_quantity - 25) AS m FROM lineitem GROUP BY 1, 2), c AS (SELECT l_orderkey, l_linenumber, sum(m) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS run FROM x)
    SELECT l_orderkey, """
    + ", ".join(f"round(max(CASE WHEN l_linenumber = {i} THEN run END), 2) AS inn{i}" for i in range(1, 5))
    + ", round(arg_max(run, l_linenumber), 2) AS final FROM c GROUP BY 1",
)
def cum_margin_pivot(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.sum(F.col("l_quantity") - 25).alias("m"))
    c = x.withColumn("run", F.sum("m").over(W.partitionBy("l_orderkey").orderBy("l_linenumber")))
    return c.groupBy("l_orderkey").agg(*[F.round(F.max(F.when(F.col("l_linenumber") == i, F.col("run"))), 2).alias(f"inn{i}") for i in range(1, 5)], F.round(F.max_by("run", "l_linenumber"), 2).alias("final"))


@query(
    "climatology",
    """SELECT user_id, CAST(month(ts) AS INTEGER) AS month, count(*) AS n, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS std FROM events WHERE hour(ts) >= 22 OR hour(ts) < 4 GROUP BY 1, 2""",
)
def climatology(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").where((F.hour("ts") >= 22) | (F.hour("ts") < 4))
    return e.groupBy("user_id", F.month("ts").alias("month")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 4).alias("mean"), F.round(F.stddev_samp("value"), 4).alias("std"))


@query(
    "recent_seasons_mean",
    """WITH r AS (SELECT o_orderpriority, o_totalprice, dense_rank() OVER (ORDER BY year(o_orderdate) DESC) AS k FROM orders) SELECT o_orderpriority, round(coalesce(avg(o_totalprice), 0.32), 4) AS league FROM r WHERE k <= 3 GROUP BY 1""",
)
def recent_seasons_mean(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderpriority", "o_totalprice", F.year("o_orderdate").alias("y"))
    # one row a year: ranked apart, so that no window runs over all rows
    years = o.select("y").distinct().withColumn("k", F.dense_rank().over(W.orderBy(F.desc("y")))).where("k <= 3")
    return o.join(F.broadcast(years), "y").groupBy("o_orderpriority").agg(F.round(F.coalesce(F.avg("o_totalprice"), F.lit(0.32)), 4).alias("league"))


@query(
    "stability_by_season",
    """WITH s AS (SELECT o_orderpriority, year(o_orderdate) AS y, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) / count(*) AS r FROM orders GROUP BY 1, 2)
    SELECT o_orderpriority, count(*) AS n, round(avg(r), 6) AS mean, round(stddev_samp(r) / avg(r), 6) AS cv, round(min(r), 6) AS lo, round(max(r) - min(r), 6) AS spread FROM s GROUP BY 1""",
)
def stability_by_season(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "orders").groupBy("o_orderpriority", F.year("o_orderdate").alias("y")).agg(F.avg((F.col("o_orderstatus") == "F").cast("double")).alias("r"))
    return s.groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("r"), 6).alias("mean"), F.round(F.try_divide(F.stddev_samp("r"), F.avg("r")), 6).alias("cv"), F.round(F.min("r"), 6).alias("lo"), F.round(F.max("r") - F.min("r"), 6).alias("spread")
    )


@query(
    "weighted_average",
    "SELECT CASE WHEN l_quantity < 10 THEN 'low' WHEN l_quantity < 30 THEN 'mid' ELSE 'high' END AS bucket, round(sum(l_quantity * l_discount) / sum(l_quantity), 6) AS weighted, count(*) AS n FROM lineitem GROUP BY 1",
)
def weighted_average(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").withColumn("bucket", F.when(F.col("l_quantity") < 10, "low").when(F.col("l_quantity") < 30, "mid").otherwise("high"))
    return li.groupBy("bucket").agg(F.round(G.ratio(F.col("l_quantity") * F.col("l_discount"), F.col("l_quantity")), 6).alias("weighted"), F.count(F.lit(1)).alias("n"))


_CUTS = (0.36787944117, 0.73575888234, 0.91969860293, 0.98101184312, 0.99634015317, 0.99940581518, 0.99991675885)


@query(
    "bootstrap_ratio_ci",
    "WITH p AS (SELECT user_id, sum(CASE WHEN event_type = 'purchase' THEN value ELSE 0 END) AS num, sum(value) AS den FROM events GROUP BY 1), "
    "u AS (SELECT *, b, ((((((user_id + 1) * 48271 + b * 69621 + 1) % 2147483647) * 16807) % 2147483647) * 48271 % 2147483647) / 2147483647.0 AS u FROM p, range(1, 401) r(b)), "
    "w AS (SELECT b, num, den, " + " + ".join(f"(u >= {c})::INT" for c in _CUTS) + " AS w FROM u), d AS (SELECT b, sum(w * num) / sum(w * den) AS r FROM w GROUP BY 1) "
    "SELECT (SELECT round(sum(num) / sum(den), 6) FROM p) AS ratio, round(quantile_cont(r, 0.025), 6) AS low, round(quantile_cont(r, 0.975), 6) AS high FROM d",
)
def bootstrap_ratio_ci(spark: SparkSession, d: str) -> DataFrame:
    bought = F.when(F.col("event_type") == "purchase", F.col("value")).otherwise(0.0)
    out = G.bootstrap_ratio(table(spark, d, "events"), "user_id", bought, F.col("value"), 400)
    return out.select(*[F.round(c, 6).alias(c) for c in ("ratio", "low", "high")])


@query(
    "lag_regression",
    """WITH x AS (SELECT user_id, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS a, value AS b FROM events)
    SELECT user_id, count(*) AS n, round(regr_slope(b, a), 6) AS slope, round(regr_intercept(b, a), 4) AS intercept FROM x WHERE a IS NOT NULL GROUP BY 1""",
)
def lag_regression(spark: SparkSession, d: str) -> DataFrame:
    r = G.lag_regression(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], "value")
    return r.select("user_id", "n", F.round("slope", 6).alias("slope"), F.round("intercept", 4).alias("intercept"))


@query(
    "winsorise",
    "WITH q AS (SELECT quantile_cont(value, 0.05) AS lo, quantile_cont(value, 0.95) AS hi FROM events) SELECT event_id, round(greatest(least(value, hi), lo), 4) AS held FROM events, q",
)
def winsorise(spark: SparkSession, d: str) -> DataFrame:
    return G.winsorise(table(spark, d, "events").select("event_id", "value"), "value", 0.05, 0.95, "held").select("event_id", F.round("held", 4).alias("held"))


@query(
    "standardise",
    """WITH f AS (SELECT avg(l_quantity) AS m, stddev_pop(l_quantity) AS s FROM lineitem WHERE year(l_shipdate) < 1997) SELECT l_orderkey, l_linenumber, round((l_quantity - m) / s, 4) AS z, 1 AS present FROM lineitem, f""",
)
def standardise(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_shipdate")
    return G.standardise(li, ["l_quantity"], F.year("l_shipdate") < 1997).select("l_orderkey", "l_linenumber", F.round("z_l_quantity", 4).alias("z"), F.col("m_l_quantity").alias("present"))


@query(
    "row_consensus",
    """WITH x AS (SELECT event_id, list_filter([value / 500, CASE WHEN event_type = 'view' THEN value / 600 END, CASE WHEN event_type <> 'error' THEN value / 700 END], lambda v: v IS NOT NULL) AS v FROM events)
    SELECT event_id, round(list_avg(v), 6) AS mean, round(list_stddev_samp(v), 6) AS std FROM x""",
)
def row_consensus(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", (F.col("value") / 500).alias("a"), F.when(F.col("event_type") == "view", F.col("value") / 600).alias("b"), F.when(F.col("event_type") != "error", F.col("value") / 700).alias("c"))
    mean, std = G.row_consensus(["a", "b", "c"])
    return e.select("event_id", F.round(mean, 6).alias("mean"), F.round(std, 6).alias("std"))


@query(
    "contiguity_check",
    """WITH x AS (SELECT user_id, CASE WHEN lag(event_type) OVER w IS NOT DISTINCT FROM event_type AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT user_id, count(*) AS n, CAST(sum(new) AS BIGINT) AS n_runs FROM x GROUP BY 1""",
)
def contiguity_check(spark: SparkSession, d: str) -> DataFrame:
    return Q.runs(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], "event_type")


@query(
    "density_check",
    "SELECT conv_id, count(*) AS n, min(turn) AS lo, max(turn) AS hi, count(DISTINCT turn) AS n_distinct, count(*) = count(DISTINCT turn) AND max(turn) - min(turn) + 1 = count(*) AS dense FROM conversations GROUP BY 1",
)
def density_check(spark: SparkSession, d: str) -> DataFrame:
    return Q.density(table(spark, d, "conversations"), ["conv_id"], "turn")


@query(
    "quality_gates",
    """SELECT 'l_discount' AS "column", count(*) AS n, count(*) FILTER (l_discount IS NULL) AS n_null, count(*) FILTER (l_discount < 0 OR l_discount > 0.08) AS n_off, count(*) FILTER (l_discount < 0 OR l_discount > 0.08) = 0 AS ok FROM lineitem
    UNION ALL SELECT 'l_quantity', count(*), count(*) FILTER (l_quantity IS NULL), count(*) FILTER (l_quantity < 0), count(*) FILTER (l_quantity < 0) = 0 FROM lineitem""",
)
def quality_gates(spark: SparkSession, d: str) -> DataFrame:
    return Q.gates(table(spark, d, "lineitem"), {"l_discount": (0.0, 0.08, 0.1), "l_quantity": (0.0, None, 0.1)})


@query(
    "artifact_diff",
    """WITH a AS (SELECT o_orderkey, o_totalprice AS v FROM orders WHERE o_orderkey % 10 <> 3), b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS v FROM orders WHERE o_orderkey % 11 <> 5)
    SELECT count(*) FILTER (b.o_orderkey IS NULL) AS n_gone, count(*) FILTER (a.o_orderkey IS NULL) AS n_new, count(*) FILTER (a.o_orderkey IS NOT NULL AND b.o_orderkey IS NOT NULL) AS n_both, count(*) FILTER (abs(a.v - b.v) > 0.5) AS n_changed FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey""",
)
def artifact_diff(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("v"))
    new = o.where("o_orderkey % 11 <> 5").withColumn("v", F.when(F.expr("o_orderkey % 7 = 0"), F.col("v") + 1).otherwise(F.col("v")))
    return Q.diff(o.where("o_orderkey % 10 <> 3"), new, ["o_orderkey"], ["v"], 0.5)


@query(
    "row_failures",
    """SELECT l_orderkey, l_linenumber, array_to_string(list_filter([CASE WHEN NOT l_quantity <= 45 THEN 'quantity' END, CASE WHEN NOT l_tax < 0.08 THEN 'tax' END, CASE WHEN NOT (l_returnflag IN ('A', 'N')) THEN 'flag' END], lambda x: x IS NOT NULL), ',') AS failed FROM lineitem""",
)
def row_failures(spark: SparkSession, d: str) -> DataFrame:
    rules = {"quantity": F.col("l_quantity") <= 45, "tax": F.col("l_tax") < 0.08, "flag": F.col("l_returnflag").isin("A", "N")}
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.array_join(Q.failures(rules), ",").alias("failed"))


@query(
    "backward_steps",
    """WITH x AS (SELECT o_custkey, CASE WHEN o_orderdate < lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) THEN 1 ELSE 0 END AS b FROM orders) SELECT o_custkey, count(*) AS n, CAST(sum(b) AS BIGINT) AS n_back FROM x GROUP BY 1""",
)
def backward_steps(spark: SparkSession, d: str) -> DataFrame:
    return Q.backward_steps(table(spark, d, "orders"), ["o_custkey"], ["o_orderkey"], "o_orderdate")


@query(
    "mode_share",
    """WITH c AS (SELECT event_type, CAST(round(value) AS BIGINT) AS r, count(*) AS n FROM events WHERE value <> 0 GROUP BY 1, 2) SELECT event_type, round(max(n) / sum(n), 6) AS share, count(*) AS n_values FROM c GROUP BY 1""",
)
def mode_share(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "events").where("value <> 0").groupBy("event_type", F.round("value").cast("long").alias("r")).agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy("event_type").agg(F.round(F.max("n") / F.sum("n"), 6).alias("share"), F.count(F.lit(1)).alias("n_values"))
