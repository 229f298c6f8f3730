"""As-of, bucketed, nearest, coverage and containment joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from chronolake.operators import asof as A, quality as Q
from chronolake.plans.registry import query
from chronolake.runtime import table


def quotes(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").where("event_type = 'view'")
    return e.select("user_id", F.col("ts").alias("qts"), F.col("value").alias("bid"), F.col("event_id").alias("quote_id"))


def trades(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").where("event_type = 'purchase'").select("user_id", "event_id", "ts", "value")


_Q = "q AS (SELECT user_id, ts AS qts, value AS bid, event_id AS quote_id FROM events WHERE event_type = 'view'), t AS (SELECT user_id, event_id, ts, value FROM events WHERE event_type = 'purchase')"


@query("asof_backward", f"WITH {_Q} SELECT t.event_id, q.bid, q.quote_id FROM t ASOF LEFT JOIN q ON t.user_id = q.user_id AND t.ts >= q.qts")
def asof_backward(spark: SparkSession, d: str) -> DataFrame:
    return A.asof(trades(spark, d), quotes(spark, d), ["user_id"], "ts", "qts", ["bid", "quote_id"], prefix="").select("event_id", "bid", "quote_id")


@query("asof_strict", "WITH e AS (SELECT user_id, event_id, ts, value FROM events) SELECT a.event_id, b.value AS before_value, b.event_id AS before_id FROM e a ASOF LEFT JOIN e b ON a.user_id = b.user_id AND a.ts > b.ts")
def asof_strict(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "event_id", "ts", "value")
    out = A.asof(e, e.select("user_id", F.col("ts").alias("bts"), F.col("value").alias("before_value"), F.col("event_id").alias("before_id")), ["user_id"], "ts", "bts", ["before_value", "before_id"], strict=True, prefix="")
    return out.select("event_id", "before_value", "before_id")


@query(
    "asof_clamp",
    f"""WITH {_Q}, f AS (SELECT user_id, arg_min(bid, qts) AS bid0 FROM q GROUP BY 1)
    SELECT t.event_id, coalesce(q.bid, f.bid0) AS bid FROM t ASOF LEFT JOIN q ON t.user_id = q.user_id AND t.ts >= q.qts LEFT JOIN f ON t.user_id = f.user_id""",
)
def asof_clamp(spark: SparkSession, d: str) -> DataFrame:
    return A.asof(trades(spark, d), quotes(spark, d), ["user_id"], "ts", "qts", ["bid"], clamp=True, prefix="").select("event_id", "bid")


@query("asof_stale", f"WITH {_Q} SELECT t.event_id, CASE WHEN epoch_us(t.ts) - epoch_us(q.qts) <= 21600000000 THEN q.bid END AS bid FROM t ASOF LEFT JOIN q ON t.user_id = q.user_id AND t.ts >= q.qts")
def asof_stale(spark: SparkSession, d: str) -> DataFrame:
    return A.asof(trades(spark, d), quotes(spark, d), ["user_id"], "ts", "qts", ["bid"], stale=21600, prefix="").select("event_id", "bid")


@query(
    "nearest_within",
    f"""WITH {_Q}, p AS (SELECT t.event_id, q.quote_id, q.bid, abs(epoch_us(t.ts) - epoch_us(q.qts)) AS gap, q.qts FROM t JOIN q ON t.user_id = q.user_id WHERE abs(epoch_us(t.ts) - epoch_us(q.qts)) <= 5400000000),
    b AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY gap, qts) = 1)
    SELECT t.event_id, b.quote_id, b.bid FROM t LEFT JOIN b ON t.event_id = b.event_id""",
)
def nearest_within(spark: SparkSession, d: str) -> DataFrame:
    return A.nearest(trades(spark, d), quotes(spark, d), ["user_id"], "ts", "qts", ["quote_id", "bid"], 5400, prefix="").select("event_id", "quote_id", "bid")


_ISSUE = """i AS (SELECT user_id, event_id AS issue_id, date_trunc('hour', ts) + INTERVAL 6 HOUR AS valid, ts AS issue, ts + INTERVAL 75 MINUTE AS available, value FROM events WHERE event_type IN ('view', 'click')),
    n AS (SELECT user_id, date_trunc('hour', ts) AS valid, date_trunc('hour', ts) - INTERVAL 4 HOUR AS decision FROM events)"""


@query(
    "asof_tritemporal",
    f"""WITH {_ISSUE}, p AS (SELECT DISTINCT n.user_id, n.valid, i.issue, i.value FROM n JOIN i ON n.user_id = i.user_id AND n.valid = i.valid AND i.available <= n.decision QUALIFY rank() OVER (PARTITION BY n.user_id, n.valid ORDER BY i.issue DESC) = 1)
    SELECT n.user_id, n.valid, p.issue, p.value FROM n LEFT JOIN p ON n.user_id = p.user_id AND n.valid = p.valid""",
)
def asof_tritemporal(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz")
    issues = e.where(F.col("event_type").isin("view", "click")).select("user_id", (hour + F.expr("INTERVAL 6 HOUR")).alias("valid"), F.col("ts").alias("issue"), (F.col("ts") + F.expr("INTERVAL 75 MINUTE")).alias("available"), "value")
    need = e.select("user_id", hour.alias("valid"), (hour - F.expr("INTERVAL 4 HOUR")).alias("decision"))
    return A.freshest_issue(need, issues, ["user_id", "valid"], "decision", "available", "issue", ["value"]).select("user_id", "valid", "issue", "value")


@query(
    "asof_priority",
    """WITH r AS (SELECT user_id, ts AS valid, ts + INTERVAL 10 MINUTE AS available, CASE WHEN event_type = 'view' THEN 0 ELSE 1 END AS rnk, value FROM events WHERE event_type <> 'error'),
    n AS (SELECT user_id, date_trunc('hour', ts) AS hr, date_trunc('hour', ts) + INTERVAL 30 MINUTE AS decision FROM events),
    p AS (SELECT n.*, r.rnk, r.valid, r.value FROM (SELECT DISTINCT * FROM n) n JOIN r ON n.user_id = r.user_id AND r.valid >= n.hr - INTERVAL 1 HOUR AND r.valid < n.hr + INTERVAL 1 HOUR AND r.available <= n.decision
      QUALIFY row_number() OVER (PARTITION BY n.user_id, n.hr ORDER BY r.rnk, r.valid DESC, r.value DESC) = 1)
    SELECT n.user_id, n.hr, p.rnk, p.value FROM n LEFT JOIN p ON n.user_id = p.user_id AND n.hr = p.hr""",
)
def asof_priority(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz")
    reports = e.where("event_type <> 'error'").select("user_id", F.col("ts").alias("valid"), (F.col("ts") + F.expr("INTERVAL 10 MINUTE")).alias("available"), F.when(F.col("event_type") == "view", 0).otherwise(1).alias("rnk"), "value")
    need = e.select("user_id", hour.alias("hr"), (hour + F.expr("INTERVAL 30 MINUTE")).alias("decision"))
    return A.best_source(need, reports, ["user_id"], "hr", "decision", "valid", "available", "rnk", ["value"]).select("user_id", "hr", "rnk", "value")


@query(
    "hour_bucket_join",
    """WITH h AS (SELECT date_trunc('hour', ts) AS hr, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1)
    SELECT e.event_id, h.n, h.total FROM events e LEFT JOIN h ON date_trunc('hour', e.ts) + INTERVAL 1 HOUR = h.hr""",
)
def hour_bucket_join(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "ts", "value")
    h = e.groupBy(F.date_trunc("hour", "ts").alias("hr")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return e.withColumn("hr", F.date_trunc("hour", "ts") + F.expr("INTERVAL 1 HOUR")).join(h, "hr", "left").select("event_id", "n", "total")


@query(
    "hour_offsets_join",
    """WITH h AS (SELECT user_id, date_trunc('hour', ts) AS hr, max(value) AS top FROM events GROUP BY 1, 2), b AS (SELECT event_id, user_id, date_trunc('hour', ts) AS hr FROM events WHERE event_type = 'signup'),
    g AS (SELECT b.*, CAST(o AS INTEGER) AS off FROM b, range(-1, 6) r(o))
    SELECT g.event_id, g.off, h.top FROM g LEFT JOIN h ON g.user_id = h.user_id AND g.hr + g.off * INTERVAL 1 HOUR = h.hr""",
)
def hour_offsets_join(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", F.date_trunc("hour", "ts").alias("hr"), "value")
    h = e.groupBy("user_id", "hr").agg(F.max("value").alias("top"))
    g = e.where("event_type = 'signup'").select("event_id", "user_id", "hr", F.explode(F.sequence(F.lit(-1), F.lit(5))).alias("off"))
    return g.withColumn("hr", F.col("hr") + F.make_interval(hours="off")).join(h, ["user_id", "hr"], "left").select("event_id", "off", "top")


@query(
    "lagged_join",
    """WITH x AS (SELECT user_id, CAST(ts AS DATE) AS day, round(sum(value), 4) AS total FROM events GROUP BY 1, 2)
    SELECT a.user_id, a.day, a.total, b.total AS lag_total FROM x a LEFT JOIN x b ON a.user_id = b.user_id AND a.day = b.day + 7""",
)
def lagged_join(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "events").groupBy("user_id", F.col("ts").cast("date").alias("day")).agg(F.round(F.sum("value"), 4).alias("total"))
    return A.lagged(x, x, ["user_id"], "day", 7, ["total"]).select("user_id", "day", "total", "lag_total")


@query(
    "snapshot_before",
    """WITH s AS (SELECT o_custkey, date_trunc('month', o_orderdate) AS month, round(sum(o_totalprice), 4) AS total FROM orders GROUP BY 1, 2)
    SELECT o.o_orderkey, s.total FROM orders o ASOF LEFT JOIN s ON o.o_custkey = s.o_custkey AND date_trunc('month', o.o_orderdate) > s.month""",
)
def snapshot_before(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.date_trunc("month", "o_orderdate").alias("at"), "o_totalprice")
    s = o.groupBy("o_custkey", F.col("at").alias("month")).agg(F.round(F.sum("o_totalprice"), 4).alias("total"))
    return A.asof(o.select("o_orderkey", "o_custkey", "at"), s, ["o_custkey"], "at", "month", ["total"], strict=True, prefix="").select("o_orderkey", "total")


@query(
    "fk_containment",
    """SELECT 'lineitem.l_orderkey' AS child, 'orders.o_orderkey' AS parent, count(DISTINCT l_orderkey) AS n, count(DISTINCT CASE WHEN l_orderkey IN (SELECT o_orderkey FROM orders) THEN l_orderkey END) AS n_found FROM lineitem
    UNION ALL SELECT 'orders.o_orderkey', 'lineitem.l_orderkey', count(DISTINCT o_orderkey), count(DISTINCT CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem) THEN o_orderkey END) FROM orders
    UNION ALL SELECT 'labels.doc_id', 'documents.doc_id', count(DISTINCT doc_id), count(DISTINCT CASE WHEN doc_id IN (SELECT doc_id FROM documents) THEN doc_id END) FROM labels""",
)
def fk_containment(spark: SparkSession, d: str) -> DataFrame:
    t = lambda n: table(spark, d, n)
    pairs = (("lineitem", "l_orderkey", "orders", "o_orderkey"), ("orders", "o_orderkey", "lineitem", "l_orderkey"), ("labels", "doc_id", "documents", "doc_id"))
    parts = [Q.containment(t(a), x, t(b), y, f"{a}.{x}", f"{b}.{y}") for a, x, b, y in pairs]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "anti_coverage",
    """WITH g AS (SELECT unnest(generate_series(min(CAST(ts AS DATE)), max(CAST(ts AS DATE)), INTERVAL 1 DAY))::DATE AS day FROM events), u AS (SELECT DISTINCT user_id FROM events)
    SELECT u.user_id, g.day FROM u, g WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = u.user_id AND CAST(e.ts AS DATE) = g.day)""",
)
def anti_coverage(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", F.col("ts").cast("date").alias("day"))
    return Q.missing_days(e, ["user_id"], "day")


@query("semi_anti", "SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000) AS big FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def semi_anti(spark: SparkSession, d: str) -> DataFrame:
    c, o = table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders")
    out = c.join(o.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")
    big = o.where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("b", F.lit(True))
    return out.join(big, "c_custkey", "left").select("c_custkey", F.coalesce("b", F.lit(False)).alias("big"))


@query(
    "overlap_history",
    """WITH w AS (SELECT user_id, CAST(ts AS DATE) AS day, list_sort(list(DISTINCT event_type)) AS kinds FROM events GROUP BY 1, 2),
    p AS (SELECT a.user_id, a.day, b.day AS past, len(list_intersect(a.kinds, b.kinds)) / CAST(len(list_distinct(list_concat(a.kinds, b.kinds))) AS DOUBLE) AS likeness FROM w a JOIN w b ON a.user_id = b.user_id AND b.day < a.day AND b.day >= a.day - 7)
    SELECT user_id, day, count(*) FILTER (likeness >= 0.5) AS n_alike, round(max(likeness), 6) AS best FROM p GROUP BY 1, 2""",
)
def overlap_history(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "events").groupBy("user_id", F.col("ts").cast("date").alias("day")).agg(F.collect_set("event_type").alias("kinds"))
    # seven days back at most: each row is sent to the days that may use it, then joined on equal keys
    back = w.select("user_id", F.explode(F.transform(F.sequence(F.lit(1), F.lit(7)), lambda i: F.date_add("day", i))).alias("day"), F.col("kinds").alias("past"))
    p = w.join(back, ["user_id", "day"])
    like = F.size(F.array_intersect("kinds", "past")) / F.size(F.array_union("kinds", "past"))
    return p.groupBy("user_id", "day").agg(F.count_if(like >= 0.5).alias("n_alike"), F.round(F.max(like), 6).alias("best"))


@query(
    "incremental_replace",
    """SELECT o_orderkey, o_totalprice, 'old' AS src FROM orders WHERE year(o_orderdate) NOT IN (1996, 1997) UNION ALL SELECT o_orderkey, round(o_totalprice * 2, 2), 'new' FROM orders WHERE year(o_orderdate) IN (1996, 1997)""",
)
def incremental_replace(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice", F.year("o_orderdate").alias("season"))
    new = o.where(F.col("season").isin(1996, 1997)).withColumn("o_totalprice", F.round(F.col("o_totalprice") * 2, 2))
    return Q.replace_partitions(o.withColumn("src", F.lit("old")), new.withColumn("src", F.lit("new")), ["season"]).select("o_orderkey", "o_totalprice", "src")
