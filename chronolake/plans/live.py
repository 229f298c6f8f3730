"""Streams over a replay of events; each gives what the batch SQL gives for its closed part."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from chronolake.plans.registry import query
from chronolake.streaming import live as L


@query(
    "stream_tumbling",
    """SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2 HAVING date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""",
)
def stream_tumbling(spark: SparkSession, d: str) -> DataFrame:
    out = L.drain(L.tumbling(L.replay(spark, d, "events"), "ts", "1 hour", "1 day", ["event_type"], "value"))
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 2).alias("total"))


@query(
    "stream_sessions",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g),
    a AS (SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS n FROM s GROUP BY user_id, k) SELECT * FROM a WHERE "end" <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""",
)
def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    out = L.drain(L.sessions(L.replay(spark, d, "events"), "ts", "1 hour", "6 hours", ["user_id"]))
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query("stream_dedupe", "SELECT event_id, user_id, value FROM events")
def stream_dedupe(spark: SparkSession, d: str) -> DataFrame:
    e = L.replay(spark, d, "events").select("event_id", "user_id", "value")
    return L.drain(L.once(e.union(L.replay(spark, d, "events").select("event_id", "user_id", "value")), ["event_id"]))


@query(
    "stream_changes",
    """SELECT user_id, ts, event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) WHERE p IS DISTINCT FROM event_type""",
)
def stream_changes(spark: SparkSession, d: str) -> DataFrame:
    e = L.replay(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id", "event_type")
    out = L.drain(L.changes(e, "user_id", ["ts", "event_id"], "event_type"))
    return out.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query(
    "stream_sequence_gate",
    """WITH x AS (SELECT user_id, event_id, (event_id * 7919) % 1000 AS seq FROM events) SELECT user_id, event_id, seq, coalesce(seq >= max(seq) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS ok FROM x""",
)
def stream_sequence_gate(spark: SparkSession, d: str) -> DataFrame:
    e = L.replay(spark, d, "events").select("user_id", "event_id", (F.col("event_id") * 7919 % 1000).alias("seq"))
    return L.drain(L.in_sequence(e, "user_id", ["event_id"], "seq"))


@query("stream_upsert", "SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def stream_upsert(spark: SparkSession, d: str) -> DataFrame:
    e = L.replay(spark, d, "events").select("user_id", "event_id", "ts", "value")
    return L.upsert_batches(e, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "value")
