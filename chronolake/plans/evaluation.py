"""Probability scores, calibration, splits and rank statistics over stand-in predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from chronolake.operators import evaluation as E
from chronolake.plans.registry import query
from chronolake.runtime import table


def predictions(spark: SparkSession, d: str) -> DataFrame:
    """p from the value, y whether it is a purchase."""
    e = table(spark, d, "events")
    return e.select("event_id", "user_id", F.col("ts").cast("date").alias("day"), F.least(F.lit(0.99), F.greatest(F.lit(0.01), F.round(F.col("value") / 490, 3))).alias("p"), (F.col("event_type") == "purchase").cast("int").alias("y"), "value", "event_type")


_P = "x AS (SELECT event_id, user_id, CAST(ts AS DATE) AS day, least(0.99, greatest(0.01, round(value / 490, 3))) AS p, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS y, value, event_type FROM events)"


@query("logloss_brier", f"WITH {_P} SELECT day, count(*) AS n, round(avg(-(y * ln(p) + (1 - y) * ln(1 - p))), 6) AS logloss, round(avg((p - y) * (p - y)), 6) AS brier, round(avg(((p >= 0.5) = (y = 1))::INT), 6) AS accuracy, round(avg(y), 6) AS base FROM x GROUP BY 1")
def logloss_brier(spark: SparkSession, d: str) -> DataFrame:
    s = E.scores(predictions(spark, d), ["day"], "p", "y")
    return s.select("day", "n", *[F.round(c, 6).alias(c) for c in ("logloss", "brier", "accuracy", "base")])


@query("regression_scores", """WITH x AS (SELECT l_returnflag, l_quantity * 1500 AS f, l_extendedprice AS y FROM lineitem), e AS (SELECT *, y - f AS e FROM x)
    SELECT l_returnflag, round(avg(abs(e)), 4) AS mae, round(sqrt(avg(e * e)), 4) AS rmse, round(1 - sum(e * e) / (var_pop(y) * count(y)), 6) AS r2, round(avg(CASE WHEN abs(e) <= 1.5 THEN 0.5 * e * e ELSE 1.5 * (abs(e) - 0.75) END), 4) AS huber FROM e GROUP BY 1""")
def regression_scores(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem").select("l_returnflag", (F.col("l_quantity") * 1500).alias("f"), F.col("l_extendedprice").alias("y"))
    r = E.regression(x, ["l_returnflag"], "f", "y")
    return r.select("l_returnflag", F.round("mae", 4).alias("mae"), F.round("rmse", 4).alias("rmse"), F.round("r2", 6).alias("r2"), F.round("huber", 4).alias("huber"))


@query("calib_curve", f"WITH {_P} SELECT CAST(least(floor(p * 10), 9) AS INTEGER) AS bin, count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(y), 6) AS mean_y FROM x GROUP BY 1")
def calib_curve(spark: SparkSession, d: str) -> DataFrame:
    return E.calibration(predictions(spark, d), "p", "y", 10).select("bin", "n", F.round("mean_p", 6).alias("mean_p"), F.round("mean_y", 6).alias("mean_y"))


@query("calib_ece", f"WITH {_P}, c AS (SELECT least(floor(p * 15), 14) AS b, count(*) AS n, avg(p) AS mp, avg(y) AS my FROM x GROUP BY 1) SELECT round(sum(n * abs(mp - my)) / sum(n), 6) AS ece FROM c")
def calib_ece(spark: SparkSession, d: str) -> DataFrame:
    return E.ece(predictions(spark, d), "p", "y").select(F.round("ece", 6).alias("ece"))


@query("murphy_parts", f"WITH {_P}, c AS (SELECT least(floor(p * 10), 9) AS b, count(*) AS n, avg(p) AS mp, avg(y) AS my FROM x GROUP BY 1), o AS (SELECT avg(y) AS base, count(*) AS n_all FROM x) SELECT round(sum(n * (mp - my) ** 2) / max(n_all), 6) AS reliability, round(sum(n * (my - base) ** 2) / max(n_all), 6) AS resolution, round(max(base * (1 - base)), 6) AS uncertainty FROM c, o")
def murphy_parts(spark: SparkSession, d: str) -> DataFrame:
    return E.murphy(predictions(spark, d), "p", "y").select(*[F.round(c, 6).alias(c) for c in ("reliability", "resolution", "uncertainty")])


@query("auc_rank", f"WITH {_P}, r AS (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS r FROM x) SELECT round((sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)), 6) AS auc FROM r")
def auc_rank(spark: SparkSession, d: str) -> DataFrame:
    return E.auc(predictions(spark, d), "p", "y").select(F.round("auc", 6).alias("auc"))


@query("season_splits", "WITH s AS (SELECT DISTINCT year(o_orderdate) AS s FROM orders), p AS (SELECT a.s AS val, b.s AS train, count(*) OVER (PARTITION BY a.s) AS n FROM s a JOIN s b ON b.s < a.s) SELECT CAST(val AS INTEGER) AS val, CAST(train AS INTEGER) AS train FROM p WHERE n >= 2")
def season_splits(spark: SparkSession, d: str) -> DataFrame:
    return E.folds(table(spark, d, "orders").select(F.year("o_orderdate").alias("s")), "s", 2)


@query("date_split", "WITH d AS (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events), i AS (SELECT day, row_number() OVER (ORDER BY day) - 1 AS i, count(*) OVER () AS n FROM d) SELECT day, CASE WHEN i < floor(n * 0.8) THEN 'train' WHEN i < floor(n * 0.9) THEN 'val' ELSE 'test' END AS part FROM i")
def date_split(spark: SparkSession, d: str) -> DataFrame:
    return E.date_split(predictions(spark, d), "day")


@query("confidence_tiers", "WITH q AS (SELECT quantile_cont(value, 0.33) AS a, quantile_cont(value, 0.67) AS b FROM events) SELECT event_id, CASE WHEN value <= a THEN 'HIGH' WHEN value <= b THEN 'MEDIUM' ELSE 'LOW' END AS tier FROM events, q")
def confidence_tiers(spark: SparkSession, d: str) -> DataFrame:
    return E.tiers(predictions(spark, d), "value", 0.33, 0.67).select("event_id", "tier")


@query("bucket_brier", f"WITH {_P} SELECT CASE WHEN value < 50 THEN '0-50' WHEN value < 150 THEN '50-150' ELSE '150+' END AS bucket, count(*) AS n, round(sum(value * (p - y) ** 2) / sum(value), 6) AS weighted_brier FROM x GROUP BY 1")
def bucket_brier(spark: SparkSession, d: str) -> DataFrame:
    x = predictions(spark, d).withColumn("bucket", F.when(F.col("value") < 50, "0-50").when(F.col("value") < 150, "50-150").otherwise("150+"))
    return x.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("value") * F.pow(F.col("p") - F.col("y"), 2)) / F.sum("value"), 6).alias("weighted_brier"))


@query("ks_two_sample", "WITH p AS (SELECT value, count(*) FILTER (event_type = 'view') AS na, count(*) FILTER (event_type = 'purchase') AS nb FROM events GROUP BY 1), r AS (SELECT sum(na) OVER (ORDER BY value) / sum(na) OVER () AS ca, sum(nb) OVER (ORDER BY value) / sum(nb) OVER () AS cb FROM p) SELECT round(max(abs(ca - cb)), 6) AS ks FROM r")
def ks_two_sample(spark: SparkSession, d: str) -> DataFrame:
    return E.ks_distance(predictions(spark, d), "event_type", "view", "purchase", "value").select(F.round("ks", 6).alias("ks"))


@query("spearman_by_flag", """WITH r AS (SELECT l_returnflag, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0 AS a, rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_returnflag, l_extendedprice) - 1) / 2.0 AS b FROM lineitem)
    SELECT l_returnflag, round(corr(a, b), 6) AS rho FROM r GROUP BY 1""")
def spearman_by_flag(spark: SparkSession, d: str) -> DataFrame:
    return E.spearman(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice", ["l_returnflag"]).select("l_returnflag", F.round("rho", 6).alias("rho"))


@query("isotonic_bins", f"""WITH {_P}, g AS (SELECT round(p, 1) AS s, count(*) AS n, sum(y) AS t FROM x GROUP BY 1), f AS (SELECT a.s AS lo, c.s AS hi, sum(b.t) / sum(b.n) AS m FROM g a JOIN g c ON c.s >= a.s JOIN g b ON b.s BETWEEN a.s AND c.s GROUP BY 1, 2)
    SELECT g.s AS score, g.n, round((SELECT max(v) FROM (SELECT f.lo, min(f.m) AS v FROM f WHERE f.lo <= g.s AND f.hi >= g.s GROUP BY f.lo)), 6) AS fit FROM g""")
def isotonic_bins(spark: SparkSession, d: str) -> DataFrame:
    x = predictions(spark, d).withColumn("score", F.round("p", 1))
    return E.isotonic(x, "score", "y").select("score", "n", F.round("fit", 6).alias("fit"))


@query("pair_covariance", "SELECT CAST(year(l_shipdate) AS INTEGER) AS season, count(*) AS n, round(covar_samp(l_quantity, l_discount), 6) AS cov, round(corr(l_quantity, l_discount), 6) AS r, round((var_samp(l_quantity) + var_samp(l_discount) + 2 * covar_samp(l_quantity, l_discount)) / 4, 6) AS half_sum_var FROM lineitem GROUP BY 1")
def pair_covariance(spark: SparkSession, d: str) -> DataFrame:
    a, b = "l_quantity", "l_discount"
    return table(spark, d, "lineitem").groupBy(F.year("l_shipdate").alias("season")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.covar_samp(a, b), 6).alias("cov"), F.round(F.corr(a, b), 6).alias("r"), F.round((F.var_samp(a) + F.var_samp(b) + 2 * F.covar_samp(a, b)) / 4, 6).alias("half_sum_var")
    )
