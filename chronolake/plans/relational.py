"""Relational coverage on the star schema, nested data, scans and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from chronolake.functions import physics as X, scalar as S
from chronolake.plans.registry import query
from chronolake.runtime import table

_REV = "l_extendedprice * (1 - l_discount)"


@query(
    "tpch_q1",
    f"""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum({_REV}), 2) AS sum_disc, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
    FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""",
)
def tpch_q1(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").where("l_shipdate <= TIMESTAMP_NTZ '1998-09-02 00:00:00'")
    return li.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base"), F.round(F.sum(F.expr(_REV)), 2).alias("sum_disc"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count(F.lit(1)).alias("n")
    )


@query(
    "tpch_q3",
    f"""SELECT l_orderkey, round(sum({_REV}), 2) AS revenue, o_orderdate FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
    WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1997-03-15' AND l_shipdate > TIMESTAMP '1997-03-15' GROUP BY 1, 3 ORDER BY revenue DESC, l_orderkey LIMIT 10""",
)
def tpch_q3(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    o = table(spark, d, "orders").where("o_orderdate < TIMESTAMP_NTZ '1997-03-15 00:00:00'").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderdate")
    li = table(spark, d, "lineitem").where("l_shipdate > TIMESTAMP_NTZ '1997-03-15 00:00:00'").select("l_orderkey", F.expr(_REV).alias("r"))
    out = li.join(o.join(c, "o_custkey"), "l_orderkey").groupBy("l_orderkey", "o_orderdate").agg(F.round(F.sum("r"), 2).alias("revenue"))
    return out.orderBy(F.desc("revenue"), "l_orderkey").limit(10).select("l_orderkey", "revenue", "o_orderdate")


@query(
    "tpch_q5",
    f"""SELECT n_name, round(sum({_REV}), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey AND s_nationkey = c_nationkey
    JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY 1""",
)
def tpch_q5(spark: SparkSession, d: str) -> DataFrame:
    t = lambda n: table(spark, d, n)
    n = t("nation").join(t("region").where("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("nk"), "n_name")
    s = t("supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("nk")).join(n, "nk")
    oc = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("l_orderkey"), F.col("c_nationkey").alias("nk"))
    li = t("lineitem").select("l_orderkey", "l_suppkey", F.expr(_REV).alias("r"))
    return li.join(s, "l_suppkey").join(oc, ["l_orderkey", "nk"]).groupBy("n_name").agg(F.round(F.sum("r"), 2).alias("revenue"))


@query("tpch_q6", "SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem WHERE year(l_shipdate) = 1997 AND l_discount BETWEEN 0.03 AND 0.06 AND l_quantity < 24")
def tpch_q6(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").where("l_shipdate >= TIMESTAMP_NTZ '1997-01-01 00:00:00' AND l_shipdate < TIMESTAMP_NTZ '1998-01-01 00:00:00' AND l_discount BETWEEN 0.03 AND 0.06 AND l_quantity < 24")
    return li.agg(F.round(F.sum(F.col("l_extendedprice") * F.col("l_discount")), 2).alias("revenue"))


for _name, _kind in (("rollup_orders", "ROLLUP (o_orderstatus, o_orderpriority)"), ("cube_orders", "CUBE (o_orderstatus, o_orderpriority)"), ("grouping_sets_orders", "GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")):
    _sql = f"SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY {_kind}"

    def _grouped(spark: SparkSession, d: str, kind: str = _kind) -> DataFrame:
        o = table(spark, d, "orders")
        aggs = (F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
        cols = ("o_orderstatus", "o_orderpriority")
        if kind.startswith("ROLLUP"):
            return o.rollup(*cols).agg(*aggs)
        if kind.startswith("CUBE"):
            return o.cube(*cols).agg(*aggs)
        return o.groupingSets([[F.col(cols[0])], [F.col(cols[1])], []], F.col(cols[0]), F.col(cols[1])).agg(*aggs)

    query(_name, _sql)(_grouped)


@query(
    "set_operations",
    """SELECT 'both' AS part, count(*) AS n FROM (SELECT l_suppkey FROM lineitem WHERE l_discount > 0.05 INTERSECT SELECT l_suppkey FROM lineitem WHERE l_tax > 0.06)
    UNION ALL SELECT 'first', count(*) FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')""",
)
def set_operations(spark: SparkSession, d: str) -> DataFrame:
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    both = li.where("l_discount > 0.05").select("l_suppkey").intersect(li.where("l_tax > 0.06").select("l_suppkey"))
    first = o.where("o_orderstatus = 'F'").select("o_custkey").subtract(o.where("o_orderstatus = 'P'").select("o_custkey"))
    return both.agg(F.lit("both").alias("part"), F.count(F.lit(1)).alias("n")).unionByName(first.agg(F.lit("first").alias("part"), F.count(F.lit(1)).alias("n")))


@query("full_outer_merge", """WITH a AS (SELECT o_custkey, count(*) AS n_f FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), b AS (SELECT o_custkey, count(*) AS n_o FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)
    SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, n_f, n_o FROM a FULL JOIN b ON a.o_custkey = b.o_custkey""")
def full_outer_merge(spark: SparkSession, d: str) -> DataFrame:
    # two frames of one table merged on a key: one conditional aggregate, no join
    o = table(spark, d, "orders").where(F.col("o_orderstatus").isin("F", "O"))
    n = lambda s: F.nullif(F.count_if(F.col("o_orderstatus") == s), F.lit(0)).alias(f"n_{s.lower()}")
    return o.groupBy("o_custkey").agg(n("F"), n("O"))


@query("pivot_unpivot", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem WHERE l_linestatus IN ('O', 'F') GROUP BY 1, 2")
def pivot_unpivot(spark: SparkSession, d: str) -> DataFrame:
    wide = table(spark, d, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["O", "F"]).count()
    return wide.unpivot("l_returnflag", ["O", "F"], "l_linestatus", "n").where("n IS NOT NULL")


@query("json_extract", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(json_extract(props, '$.missing') AS BIGINT) AS missing FROM events")
def json_extract(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", F.from_json("props", "k BIGINT, missing BIGINT").alias("j"))
    return e.select("event_id", "j.k", "j.missing")


@query(
    "ticker_parse",
    r"""WITH t AS (SELECT o_orderkey, 'KX' || o_orderstatus || '-' || strftime(o_orderdate, '%y%m%d') || 'ABC' || substr(o_orderpriority, 3, 3) || '-T' || (o_custkey % 20) AS ticker FROM orders)
    SELECT o_orderkey, nullif(regexp_extract(ticker, '^KX([A-Z]+)-', 1), '') AS series, nullif(regexp_extract(ticker, '-([0-9]{6})[A-Z]', 1), '') AS day, CAST(nullif(regexp_extract(ticker, '-T([0-9]+)$', 1), '') AS INTEGER) AS strike FROM t""",
)
def ticker_parse(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    t = F.concat(F.lit("KX"), "o_orderstatus", F.lit("-"), F.date_format("o_orderdate", "yyMMdd"), F.lit("ABC"), F.substring("o_orderpriority", 3, 3), F.lit("-T"), (F.col("o_custkey") % 20).cast("string"))
    x = o.select("o_orderkey", t.alias("ticker"))
    return x.select("o_orderkey", S.extract("ticker", "^KX([A-Z]+)-").alias("series"), S.extract("ticker", "-([0-9]{6})[A-Z]").alias("day"), S.extract("ticker", "-T([0-9]+)$").cast("int").alias("strike"))


@query("coerce_sentinels", """SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_size END AS size_or_null, try_cast(CASE WHEN p_size % 5 = 0 THEN 'M' WHEN p_size % 5 = 1 THEN 'T' ELSE CAST(p_retailprice AS VARCHAR) END AS DOUBLE) IS NULL AS bad,
    CASE WHEN p_size % 5 = 0 THEN NULL WHEN p_size % 5 = 1 THEN 0.0 ELSE p_retailprice END AS amount FROM part""")
def coerce_sentinels(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").withColumn("raw", F.when(F.col("p_size") % 5 == 0, "M").when(F.col("p_size") % 5 == 1, "T").otherwise(F.col("p_retailprice").cast("string")))
    p = p.withColumn("s", F.when(F.col("p_size") % 7 == 0, -1).otherwise(F.col("p_size")))
    return p.select("p_partkey", S.missing("s", [-1]).alias("size_or_null"), F.expr("try_cast(raw AS DOUBLE)").isNull().alias("bad"), S.metar_number("raw").alias("amount"))


@query("haversine_hops", """WITH n AS (SELECT n_nationkey AS k, n_nationkey * 7.0 - 80 AS lat, n_nationkey * 14.0 - 170 AS lon FROM nation)
    SELECT CAST(a.k AS INTEGER) AS a, CAST(b.k AS INTEGER) AS b, round(2 * 6371 * asin(sqrt(least(1.0, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))), 3) AS km FROM n a JOIN n b ON b.k = a.k + 1""")
def haversine_hops(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), (F.col("n_nationkey") * 7.0 - 80).alias("lat"), (F.col("n_nationkey") * 14.0 - 170).alias("lon"))
    m = n.select((F.col("k") - 1).alias("k"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    return n.join(m, "k").select(F.col("k").cast("int").alias("a"), (F.col("k") + 1).cast("int").alias("b"), F.round(X.haversine(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")), 3).alias("km"))


@query("moist_air", """WITH x AS (SELECT event_id, value / 10 AS t, 20 + value % 80 AS rh, 950 + value / 10 AS p FROM events), y AS (SELECT *, 6.1094 * exp(17.625 * t / (t + 243.04)) AS es FROM x)
    SELECT event_id, round(((p - es * rh / 100) * 100 / (287.058 * (t + 273.15))) + (es * rh / 100 * 100 / (461.495 * (t + 273.15))), 6) AS density, round(es * (1 - rh / 100) / 10, 6) AS vpd FROM y""")
def moist_air(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "events").select("event_id", (F.col("value") / 10).alias("t"), (20 + F.col("value") % 80).alias("rh"), (950 + F.col("value") / 10).alias("p"))
    return x.select("event_id", F.round(X.air_density(F.col("t"), F.col("rh"), F.col("p")), 6).alias("density"), F.round(X.vapour_deficit(F.col("t"), F.col("rh")), 6).alias("vpd"))


@query("wind_along", "SELECT event_id, round(value / 20 * cos(radians(value - 45)), 6) AS along, round(value / 20 * sin(radians(value - 45)), 6) AS cross_wind FROM events")
def wind_along(spark: SparkSession, d: str) -> DataFrame:
    along, cross = X.rotate_wind(F.col("value") / 20, F.col("value"), F.lit(45.0))
    return table(spark, d, "events").select("event_id", F.round(along, 6).alias("along"), F.round(cross, 6).alias("cross_wind"))


@query("event_classes", """SELECT event_id, CASE WHEN contains(lower(event_type), 'pur') THEN 'buy' WHEN contains(event_type, 'i') THEN 'touch' ELSE 'other' END AS class, coalesce(CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3 END, 0) AS idx FROM events""")
def event_classes(spark: SparkSession, d: str) -> DataFrame:
    rules = [("pur", "buy"), ("i", "touch")]
    return table(spark, d, "events").select("event_id", S.keyword_class("event_type", rules, "other").alias("class"), S.vocabulary("event_type", {"view": 1, "click": 2, "purchase": 3}).alias("idx"))


@query("array_jaccard", """WITH w AS (SELECT vec_id, label, list_transform(embedding[1:8], lambda x: CAST(floor(x * 4) AS INTEGER)) AS s FROM embeddings)
    SELECT a.vec_id AS a, b.vec_id AS b, round(len(list_intersect(list_distinct(a.s), list_distinct(b.s))) / len(list_distinct(list_concat(a.s, b.s))), 6) AS likeness FROM w a JOIN w b ON b.vec_id = a.vec_id + 1""")
def array_jaccard(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 8), lambda x: F.floor(x * 4).cast("int")).alias("s"))
    b = w.select((F.col("vec_id") - 1).alias("vec_id"), F.col("s").alias("t"))
    return w.join(b, "vec_id").select(F.col("vec_id").alias("a"), (F.col("vec_id") + 1).alias("b"), F.round(F.size(F.array_intersect("s", "t")) / F.size(F.array_union("s", "t")), 6).alias("likeness"))


@query("top_k_per_group", "SELECT c_mktsegment, c_custkey, c_acctbal FROM customer QUALIFY row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) <= 3")
def top_k_per_group(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window as W

    w = W.partitionBy("c_mktsegment").orderBy(F.desc("c_acctbal"), "c_custkey")
    return table(spark, d, "customer").select("c_mktsegment", "c_custkey", "c_acctbal").withColumn("n", F.row_number().over(w)).where("n <= 3").drop("n")


@query("latest_per_key", "SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS last_order, max(o_orderdate) AS last_date FROM orders GROUP BY 1")
def latest_per_key(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("last_order"), F.max("o_orderdate").alias("last_date"))


@query("range_join_buckets", "SELECT b.lo, count(*) AS n, round(sum(value), 2) AS total FROM events JOIN (VALUES (0, 50), (50, 120), (120, 500)) b(lo, hi) ON value >= lo AND value < hi GROUP BY 1")
def range_join_buckets(spark: SparkSession, d: str) -> DataFrame:
    lo = F.when(F.col("value") < 50, 0).when(F.col("value") < 120, 50).when(F.col("value") < 500, 120)
    return table(spark, d, "events").select(lo.alias("lo"), "value").where("lo IS NOT NULL AND value >= 0").groupBy("lo").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))
