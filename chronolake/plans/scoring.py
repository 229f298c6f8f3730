"""Skill, blends, folds, paired comparisons, concordance, deltas between versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from chronolake.operators import scoring as C
from chronolake.plans.registry import query
from chronolake.runtime import table

_E = "e AS (SELECT event_id, ts, value / 500 AS p, (event_id * 37 % 100) / 100.0 AS m, CAST(event_type = 'purchase' AS INT) AS y FROM events)"


def predictions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", "ts", (F.col("value") / 500).alias("p"), (F.col("event_id") * 37 % 100 / 100.0).alias("m"), (F.col("event_type") == "purchase").cast("int").alias("y"))


@query(
    "brier_skill",
    f"""WITH {_E}, s AS (SELECT count(*) AS n, avg(pow(p - y, 2)) AS model, avg(pow(m - y, 2)) AS market, avg(y) * (1 - avg(y)) AS base FROM e)
    SELECT n, round(model, 8) AS model, round(market, 8) AS market, round(base, 8) AS base, round(1 - model / market, 8) AS skill_market, round(1 - model / base, 8) AS skill_base FROM s""",
)
def brier_skill(spark: SparkSession, d: str) -> DataFrame:
    out = C.brier_skill(predictions(spark, d), "p", "y", "m")
    return out.select("n", *[F.round(c, 8).alias(c) for c in ("model", "market", "base", "skill_market", "skill_base")])


@query(
    "fold_recency_mean",
    """WITH f AS (SELECT year(o_orderdate) AS s, avg(o_totalprice) AS a, stddev_samp(o_totalprice) AS b FROM orders GROUP BY 1), x AS (SELECT min(s) AS lo, greatest(max(s) - min(s), 1) AS span FROM f), w AS (SELECT a, b, (s - lo) / CAST(span AS DOUBLE) + 0.1 AS w FROM f, x)
    SELECT round(sum(a * w) / sum(w), 4) AS a, round(sum(b * w) / sum(w), 4) AS b FROM w""",
)
def fold_recency_mean(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "orders").groupBy(F.year("o_orderdate").alias("s")).agg(F.avg("o_totalprice").alias("a"), F.stddev_samp("o_totalprice").alias("b"))
    return C.recency_mean(f, "s", ["a", "b"]).select(F.round("a", 4).alias("a"), F.round("b", 4).alias("b"))


@query(
    "blended_members",
    f"""WITH {_E}, k AS (SELECT event_id, CASE WHEN event_id % 5 > 0 THEN p END AS a, CASE WHEN event_id % 7 > 0 THEN m END AS b, CASE WHEN event_id % 3 > 0 THEN (p + m) / 2 END AS c, p * p AS d FROM e),
    w AS (SELECT *, (a IS NULL)::INT + (b IS NULL)::INT + (c IS NULL)::INT AS miss, CASE WHEN a IS NULL THEN 0 ELSE 0.4 END + CASE WHEN b IS NULL THEN 0 ELSE 0.3 END + CASE WHEN c IS NULL THEN 0 ELSE 0.2 END + 0.1 AS t FROM k)
    SELECT event_id, round(CASE WHEN miss / 4.0 <= 0.3 THEN (coalesce(a, 0) * 0.4 + coalesce(b, 0) * 0.3 + coalesce(c, 0) * 0.2 + d * 0.1) / t END, 13) AS blend FROM w""",
)
def blended_members(spark: SparkSession, d: str) -> DataFrame:
    some = lambda n, c: F.when(F.col("event_id") % n > 0, c)
    p, m = F.col("p"), F.col("m")
    return predictions(spark, d).select("event_id", F.round(C.blended([(some(5, p), 0.4), (some(7, m), 0.3), (some(3, (p + m) / 2), 0.2), (p * p, 0.1)]), 13).alias("blend"))


@query("inverted_signal", f"WITH {_E} SELECT event_id, round(CASE WHEN m > 0.51 THEN p WHEN m < 0.49 THEN 1 - p END, 6) AS signal FROM e")
def inverted_signal(spark: SparkSession, d: str) -> DataFrame:
    return predictions(spark, d).select("event_id", F.round(C.sided(F.col("p"), F.col("m")), 6).alias("signal"))


@query("paired_models", f"WITH {_E} SELECT count(*) AS n, round(avg(pow(p - y, 2)), 8) AS a, round(avg(pow(m - y, 2)), 8) AS b, round(avg(CAST(abs(p - y) < abs(m - y) AS INT)), 8) AS a_wins FROM e WHERE event_id % 3 = 0 AND event_id % 2 = 0")
def paired_models(spark: SparkSession, d: str) -> DataFrame:
    """The two models have predicted different thirds and halves of the events; the joint ids are the feature."""
    e = predictions(spark, d)
    out = C.paired(e.where("event_id % 3 = 0").select("event_id", "p", "y"), e.where("event_id % 2 = 0").select("event_id", "m"), "event_id", "p", "m", "y")
    return out.select("n", *[F.round(c, 8).alias(c) for c in ("a", "b", "a_wins")])


@query(
    "kendall_by_group",
    """WITH s AS (SELECT n_regionkey AS g, s_nationkey AS r, avg(s_acctbal) AS x, CAST(count(*) AS DOUBLE) AS y FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2)
    SELECT a.g AS g, round(avg(sign(a.x - b.x) * sign(a.y - b.y)), 8) AS tau FROM s a JOIN s b ON a.g = b.g AND a.r < b.r GROUP BY 1""",
)
def kendall_by_group(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    s = s.groupBy(F.col("n_regionkey").alias("g"), F.col("s_nationkey").alias("r")).agg(F.avg("s_acctbal").alias("x"), F.count(F.lit(1)).cast("double").alias("y"))
    return C.concordance(s, "g", "r", "x", "y").select("g", F.round("tau", 8).alias("tau"))


@query(
    "fold_behaviour",
    """WITH f AS (SELECT c_mktsegment AS k, year(o_orderdate) AS s, avg(o_totalprice) AS v FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
    g AS (SELECT *, v - lag(v) OVER (PARTITION BY k ORDER BY s) AS dv FROM f), t AS (SELECT *, sign(dv) * sign(lag(dv) OVER (PARTITION BY k ORDER BY s)) < 0 AS turn FROM g),
    a AS (SELECT k, count(*) AS n, stddev_samp(v) / abs(avg(v)) AS cv, avg(CAST(turn AS INT)) AS o FROM t GROUP BY 1)
    SELECT k, n, round(cv, 8) AS cv, round(o, 8) AS oscillation, CASE WHEN o > 0.6 THEN 'oscillating' WHEN cv > 0.05 THEN 'unstable' ELSE 'stable' END AS behaviour FROM a""",
)
def fold_behaviour(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_mktsegment").alias("k"), F.year("o_orderdate").alias("s")).agg(F.avg("o_totalprice").alias("v"))
    out = C.sign_changes(f, "k", "s", "v")
    kind = F.when(F.col("oscillation") > 0.6, "oscillating").when(F.col("cv") > 0.05, "unstable").otherwise("stable")
    return out.select("k", "n", F.round("cv", 8).alias("cv"), F.round("oscillation", 8).alias("oscillation"), kind.alias("behaviour"))


_COLS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query("correlation_pairs", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM lineitem" for i, a in enumerate(_COLS) for b in _COLS[i + 1 :]))
def correlation_pairs(spark: SparkSession, d: str) -> DataFrame:
    return C.correlations(table(spark, d, "lineitem"), list(_COLS)).select("a", "b", F.round("r", 6).alias("r"))


@query(
    "oof_alignment",
    "WITH k AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS pos FROM events), o AS (SELECT event_id, value FROM events WHERE event_type <> 'error') SELECT k.event_id, value FROM k LEFT JOIN o ON k.event_id = o.event_id",
)
def oof_alignment(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select("event_id").join(e.where("event_type <> 'error'").select("event_id", "value"), "event_id", "left")


@query("version_delta", "SELECT event_id, 'gone' AS kind FROM events WHERE event_type = 'error' AND event_id % 4 <> 0 UNION ALL SELECT event_id, 'new' FROM events WHERE event_id % 4 = 0 AND event_type <> 'view' AND event_type = 'error'")
def version_delta(spark: SparkSession, d: str) -> DataFrame:
    """Ids of one version that the other has not, both ways: the old one is without errors of every fourth id, the new one without all others."""
    e = table(spark, d, "events")
    old, new = e.where("event_type <> 'error' OR event_id % 4 <> 0").select("event_id"), e.where("event_type <> 'error' OR event_id % 4 = 0").select("event_id")
    gone, come = old.join(new, "event_id", "left_anti"), new.join(old, "event_id", "left_anti")
    return gone.withColumn("kind", F.lit("gone")).union(come.withColumn("kind", F.lit("new")))
