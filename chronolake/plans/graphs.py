"""Ratings and components over nation contests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from chronolake.operators import prior as P, ratings as R
from chronolake.operators.graph import connected_components
from chronolake.plans.registry import query
from chronolake.plans.temporal import games
from chronolake.runtime import table

_G = """g AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, CAST(year(l_shipdate) AS INTEGER) AS season, s.s_nationkey AS home, c.c_nationkey AS away, l_quantity - 25 AS margin
    FROM lineitem JOIN supplier s ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer c ON o_custkey = c_custkey)"""


def contests(spark: SparkSession, d: str) -> DataFrame:
    return games(spark, d).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", F.year("l_shipdate").alias("season"), "home", "away", (F.col("hs") - 25).alias("margin"))


@query(
    "log5_form",
    f"""WITH x AS (SELECT o_custkey, o_orderkey, CASE WHEN count(o_totalprice) OVER f >= 5 THEN avg(CASE WHEN o_totalprice > 150000 THEN 1.0 ELSE 0.0 END) OVER f END AS p,
      CASE WHEN count(o_totalprice) OVER g >= 5 THEN avg(CASE WHEN o_totalprice > 150000 THEN 1.0 ELSE 0.0 END) OVER g END AS q FROM orders
      WINDOW f AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), g AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 40 PRECEDING AND 1 PRECEDING)),
    c AS (SELECT *, least(greatest(p, 0.01), 0.99) AS a, least(greatest(q, 0.01), 0.99) AS b FROM x WHERE p IS NOT NULL AND q IS NOT NULL)
    SELECT o_custkey, o_orderkey, round(a * (1 - b) / (a * (1 - b) + b * (1 - a)), 6) AS log5 FROM c""",
)
def log5_form(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", (F.col("o_totalprice") > 150000).cast("double").alias("won"))
    w = P.ordered(["o_custkey"], ["o_orderdate", "o_orderkey"])
    x = o.select("o_custkey", "o_orderkey", P.rolling("won", w, 20, 5).alias("p"), P.rolling("won", w, 40, 5).alias("q")).where("p IS NOT NULL AND q IS NOT NULL")
    return x.select("o_custkey", "o_orderkey", F.round(R.log5(F.col("p"), F.col("q")), 6).alias("log5"))


@query(
    "pythag_share",
    """WITH x AS (SELECT o_custkey, sum(o_totalprice) / 100000 AS s, sum(o_totalprice % 100000) / 100000 AS a, count(*) AS n FROM orders GROUP BY 1)
    SELECT o_custkey, round(CASE WHEN a = 0 THEN 1.0 ELSE pow(s, pow((s + a) / n, 0.287)) / (pow(s, pow((s + a) / n, 0.287)) + pow(a, pow((s + a) / n, 0.287))) END, 6) AS share FROM x""",
)
def pythag_share(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "orders").groupBy("o_custkey").agg((F.sum("o_totalprice") / 100000).alias("s"), (F.sum(F.col("o_totalprice") % 100000) / 100000).alias("a"), F.count(F.lit(1)).alias("n"))
    return x.select("o_custkey", F.round(R.pythagenpat(F.col("s"), F.col("a"), F.col("n")), 6).alias("share"))


@query(
    "baseruns_shape",
    """WITH x AS (SELECT l_orderkey, sum(l_quantity) AS ab, sum(l_quantity) / 4 AS h, sum(l_linenumber) AS bb, sum(l_discount) AS hr, sum(l_quantity) / 3 AS tb FROM lineitem GROUP BY 1),
    y AS (SELECT *, h + bb - hr AS a, (1.4 * tb - 0.6 * h - 3 * hr + 0.1 * bb) * 1.02 AS b FROM x) SELECT l_orderkey, round(a * b / nullif(b + ab - h, 0) + hr, 4) AS runs FROM y""",
)
def baseruns_shape(spark: SparkSession, d: str) -> DataFrame:
    q = F.sum("l_quantity")
    x = table(spark, d, "lineitem").groupBy("l_orderkey").agg(q.alias("ab"), (q / 4).alias("h"), F.sum("l_linenumber").alias("bb"), F.sum("l_discount").alias("hr"), (q / 3).alias("tb"))
    return x.select("l_orderkey", F.round(R.base_runs(*[F.col(c) for c in ("h", "bb", "hr", "tb", "ab")]), 4).alias("runs"))


def elo_matches(spark: SparkSession, d: str) -> DataFrame:
    """Contests of two nations, home and away, with the margins of a month in one: few enough for a fold a season."""
    g = contests(spark, d).groupBy("season", F.date_trunc("month", "l_shipdate").cast("date").alias("month"), "home", "away").agg(F.sum("margin").alias("margin"))
    return g.where("home <> away")


@query("elo_fold")
def elo_fold(spark: SparkSession, d: str) -> DataFrame:
    out = R.elo(elo_matches(spark, d).withColumns({"home_id": F.col("home"), "away_id": F.col("away")}), "season", ["month", "home_id", "away_id"], "home", "away", "margin")
    return out.select("season", "month", "home", "away", F.round("home_elo", 4).alias("home_elo"), F.round("away_elo", 4).alias("away_elo"))


@query("season_ratings")
def season_ratings(spark: SparkSession, d: str) -> DataFrame:
    out = R.rate(contests(spark, d), "season", "home", "away", "margin")
    return out.select("season", "side", *[F.round(c, 4).alias(c) for c in ("massey", "colley_like", "bradley_terry", "srs")])


@query(
    "pair_records",
    f"WITH {_G} SELECT season, home AS h, away AS a, count(*) AS n, sum(CASE WHEN margin > 0 THEN 1.0 WHEN margin = 0 THEN 0.5 ELSE 0.0 END)::DOUBLE AS won, round(sum(margin), 4) AS margin FROM g WHERE home <> away GROUP BY 1, 2, 3",
)
def pair_records(spark: SparkSession, d: str) -> DataFrame:
    return R.pair_table(contests(spark, d), "season", "home", "away", "margin").withColumn("margin", F.round("margin", 4))


@query("schedule_components")
def schedule_components(spark: SparkSession, d: str) -> DataFrame:
    """Components of all orders and lineitems; recursive SQL is too slow for them, so there is none."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), "o_custkey")
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), "l_partkey")
    return connected_components(o.join(li, "k").select(F.col("o_custkey").alias("src"), (-1 - F.col("l_partkey")).alias("dst")))
