"""Remarks, clocks, presence, perspectives, trailing profiles and target families."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from chronolake.operators import profiles as R
from chronolake.plans.registry import query
from chronolake.runtime import table

_M = """m AS (SELECT event_id, ts, CASE WHEN event_id % 5 = 0 THEN 'RMK AO2' ELSE 'RMK PK WND ' || lpad(CAST(event_id * 7 % 360 AS VARCHAR), 3, '0') || lpad(CAST(event_id % 60 + 20 AS VARCHAR), 2, '0') || '/'
    || CASE WHEN event_id % 2 = 0 THEN lpad(CAST(event_id % 24 AS VARCHAR), 2, '0') ELSE '' END || lpad(CAST(event_id * 11 % 60 AS VARCHAR), 2, '0') || ' I1' || lpad(CAST(event_id % 50 AS VARCHAR), 3, '0') || ' 4/' || lpad(CAST(event_id % 40 AS VARCHAR), 3, '0') END AS report FROM events)"""


def reports(spark: SparkSession, d: str) -> DataFrame:
    digits = lambda s, n: F.lpad(F.expr(s).cast("string"), n, "0")
    clock = F.concat(F.when(F.col("event_id") % 2 == 0, digits("event_id % 24", 2)).otherwise(""), digits("event_id * 11 % 60", 2))
    full = F.concat(F.lit("RMK PK WND "), digits("event_id * 7 % 360", 3), digits("event_id % 60 + 20", 2), F.lit("/"), clock, F.lit(" I1"), digits("event_id % 50", 3), F.lit(" 4/"), digits("event_id % 40", 3))
    return table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), F.when(F.col("event_id") % 5 == 0, "RMK AO2").otherwise(full).alias("report"))


@query(
    "remark_values",
    f"""WITH {_M}, w AS (SELECT *, event_id % 5 > 0 AS has, CASE WHEN event_id % 2 = 0 THEN date_trunc('day', ts) + to_hours(CAST(event_id % 24 AS INT)) ELSE date_trunc('hour', ts) END + to_minutes(CAST(event_id * 11 % 60 AS INT)) AS t FROM m)
    SELECT event_id, CASE WHEN has THEN CAST(event_id * 7 % 360 AS DOUBLE) END AS direction, CASE WHEN has THEN CAST(event_id % 60 + 20 AS DOUBLE) END AS speed,
    CASE WHEN has THEN epoch_us(CASE WHEN t > ts THEN t - CASE WHEN event_id % 2 = 0 THEN INTERVAL 24 HOUR ELSE INTERVAL 1 HOUR END ELSE t END) END AS micros,
    CASE WHEN has THEN (event_id % 50) / 100.0::DOUBLE END AS ice, CASE WHEN has THEN CAST(event_id % 40 AS DOUBLE) END AS snow FROM w""",
)
def remark_values(spark: SparkSession, d: str) -> DataFrame:
    wind = R.peak_wind(F.col("report"), F.col("ts").cast("timestamp"))
    return reports(spark, d).select("event_id", wind["direction"].alias("direction"), wind["speed"].alias("speed"), F.unix_micros(wind["at"]).alias("micros"), R.ice(F.col("report"), 1).alias("ice"), R.snow_depth(F.col("report")).alias("snow"))


@query(
    "sky_cover",
    """WITH s AS (SELECT event_id, CASE event_id % 7 WHEN 0 THEN 0.0 WHEN 1 THEN 18.75 WHEN 2 THEN 43.75 WHEN 3 THEN 75.0 WHEN 4 THEN 100.0 WHEN 5 THEN 100.0 END::DOUBLE AS a, CASE event_id % 3 WHEN 0 THEN 18.75 WHEN 1 THEN 0.0 END::DOUBLE AS b FROM events)
    SELECT event_id, CASE WHEN a IS NULL THEN b WHEN b IS NULL THEN a ELSE greatest(a, b) END AS cover FROM s""",
)
def sky_cover(spark: SparkSession, d: str) -> DataFrame:
    pick = lambda names: F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("event_id") % len(names) + 1).cast("int"))
    a, b = pick(["CLR", "FEW", "sct ", "BKN", "OVC", "VV", "M"]), pick(["FEW", "SKC", ""])
    return table(spark, d, "events").select("event_id", R.sky_percent(a, b).alias("cover"))


@query(
    "decision_offset",
    """WITH b AS (SELECT event_id, user_id, ts, CASE WHEN event_id % 3 = 0 THEN ts WHEN event_id % 3 = 1 THEN ts + INTERVAL 10 MINUTE END AS clock, date_trunc('day', ts) + INTERVAL 9 HOUR AS start FROM events),
    h AS (SELECT *, floor((epoch_us(clock) - epoch_us(start)) / 3600000000) AS h FROM b)
    SELECT event_id, CAST(greatest(-1, least(5, coalesce(last_value(h IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 0))) AS BIGINT) AS "offset" FROM h""",
)
def decision_offset(spark: SparkSession, d: str) -> DataFrame:
    ts, third = F.col("ts").cast("timestamp"), F.col("event_id") % 3
    clocks = [F.when(third == 0, ts), F.when(third == 1, ts + F.expr("INTERVAL '10' MINUTE"))]
    start = F.date_trunc("day", ts) + F.expr("INTERVAL '9' HOUR")
    out = R.decision_offset(table(spark, d, "events"), "user_id", ["ts", "event_id"], clocks, start, -1, 5)
    return out.select("event_id", F.col("offset").cast("long").alias("offset"))


@query("edge_ratio", "SELECT s_suppkey, CASE WHEN s_suppkey % 4 > 0 THEN round(abs(s_acctbal / 1000 - 4.5) / (s_suppkey % 4), 6) END AS ratio FROM supplier")
def edge_ratio(spark: SparkSession, d: str) -> DataFrame:
    ratio = R.edge_ratio(F.col("s_acctbal") / 1000, F.lit(4.5), F.col("s_suppkey") % 4)
    return table(spark, d, "supplier").select("s_suppkey", F.round(ratio, 6).alias("ratio"))


@query(
    "availability_flags",
    "SELECT c_custkey, c_custkey % 6 > 0 AND c_mktsegment <> 'BUILDING' AS segment, c_custkey % 7 > 0 AND c_nationkey <> 0 AS nation FROM customer",
)
def availability_flags(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    c = table(spark, d, "customer").select("c_custkey", F.when(k % 6 == 0, " ").otherwise(F.col("c_mktsegment")).alias("segment"), F.when(k % 7 > 0, F.col("c_nationkey")).alias("nation"))
    return c.select("c_custkey", R.availability(c, {"segment": ["BUILDING"], "nation": [0]}).alias("s")).select("c_custkey", "s.segment", "s.nation")


@query(
    "perspective_view",
    """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber % 2 = 1 THEN l_quantity ELSE l_extendedprice END AS home, CASE WHEN l_linenumber % 2 = 1 THEN l_extendedprice ELSE l_quantity END AS away,
    CASE WHEN l_linenumber % 2 = 1 THEN l_quantity - 25 ELSE 25 - l_quantity END AS diff, CASE WHEN l_linenumber % 2 = 1 THEN l_discount ELSE 1 - l_discount END AS chance FROM lineitem""",
)
def perspective_view(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").alias("home"), F.col("l_extendedprice").alias("away"), (F.col("l_quantity") - 25).alias("diff"), F.col("l_discount").alias("chance"))
    return R.perspective(x, {"home": ("swap", "away"), "away": ("swap", "home"), "diff": ("negate", None), "chance": ("complement", None)}, F.col("l_linenumber") % 2 == 1)


@query(
    "settlement_agreement",
    """WITH o AS (SELECT user_id, event_id, CAST(value > 250 AS DOUBLE) AS y, CASE event_id % 4 WHEN 0 THEN 'Yes' WHEN 1 THEN 'no' WHEN 2 THEN 'YES' ELSE 'void' END AS r FROM events), f AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1)
    SELECT count(*) AS n, round(avg(CAST(y = CAST(lower(r) = 'yes' AS DOUBLE) AS DOUBLE)), 9) AS agreement FROM f WHERE lower(r) IN ('yes', 'no')""",
)
def settlement_agreement(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_id") % 4
    o = table(spark, d, "events").select("user_id", "event_id", (F.col("value") > 250).cast("double").alias("y"), F.when(kind == 0, "Yes").when(kind == 1, "no").when(kind == 2, "YES").otherwise("void").alias("r"))
    return R.settlement_agreement(o, "user_id", "event_id", "y", "r").withColumn("agreement", F.round("agreement", 9))


@query(
    "trailing_workload",
    """WITH g AS (SELECT user_id, CAST(ts AS DATE) AS day, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (event_type = 'error') AS DOUBLE) AS bad FROM events GROUP BY 1, 2)
    SELECT user_id, day, round(CASE WHEN sum(n) OVER w30 > 0 THEN sum(bad) OVER w30 * 9 / sum(n) OVER w30 END, 6) AS rate, round(count(*) OVER w3 / 3, 6) AS load_3, round(count(*) OVER w7 / 7, 6) AS load_7, round(count(*) OVER w14 / 14, 6) AS load_14 FROM g
    WINDOW w30 AS (PARTITION BY user_id ORDER BY day RANGE BETWEEN INTERVAL 30 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING), w3 AS (PARTITION BY user_id ORDER BY day RANGE BETWEEN INTERVAL 3 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING),
    w7 AS (PARTITION BY user_id ORDER BY day RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING), w14 AS (PARTITION BY user_id ORDER BY day RANGE BETWEEN INTERVAL 14 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING)""",
)
def trailing_workload(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).cast("double").alias("n"), F.count(F.when(F.col("event_type") == "error", 1)).cast("double").alias("bad"))
    out = R.trailing_profile(g, "user_id", "day", {"rate": ("bad", "n", 9.0)})
    return out.select("user_id", "day", *[F.round(c, 6).alias(c) for c in ("rate", "load_3", "load_7", "load_14")])


@query(
    "family_hint",
    """WITH v AS (SELECT event_type AS k, CAST(event_id % 2 AS DOUBLE) AS x FROM events WHERE event_type = 'click' UNION ALL SELECT event_type, value FROM events WHERE event_type = 'view' UNION ALL SELECT event_type, CAST(event_id % 4 AS DOUBLE) FROM events WHERE event_type = 'signup' UNION ALL SELECT event_type, CAST(event_id % 100 AS DOUBLE) FROM events WHERE event_type NOT IN ('click', 'view', 'signup'))
    SELECT k, count(*) AS n, CASE WHEN bool_and(x IN (0, 1)) THEN 'bernoulli' WHEN bool_and(abs(x - round(x)) <= 1e-8 AND x >= 0) AND var_pop(x) > avg(x) * 1.25 THEN 'negative_binomial' WHEN bool_and(abs(x - round(x)) <= 1e-8 AND x >= 0) THEN 'poisson' ELSE 'gaussian' END AS family FROM v GROUP BY 1""",
)
def family_hint(spark: SparkSession, d: str) -> DataFrame:
    k, i = F.col("event_type"), F.col("event_id")
    x = F.when(k == "click", (i % 2).cast("double")).when(k == "view", F.col("value")).when(k == "signup", (i % 4).cast("double")).otherwise((i % 100).cast("double"))
    return R.family_hint(table(spark, d, "events").select(k.alias("k"), x.alias("x")), "k", "x")


@query("season_dates", "SELECT y AS season, CAST(day AS DATE) AS day FROM (SELECT DISTINCT CAST(year(o_orderdate) AS INT) AS y FROM orders), LATERAL (SELECT unnest(generate_series(make_date(y, 3, 20), make_date(y, 10, 15), INTERVAL 7 DAY)) AS day)")
def season_dates(spark: SparkSession, d: str) -> DataFrame:
    years = table(spark, d, "orders").select(F.year("o_orderdate").alias("season")).distinct()
    return R.season_dates(years, "season", (3, 20), (10, 15), 7)


@query(
    "pit_histogram",
    """WITH o AS (SELECT o_orderkey, 2 + o_totalprice / 100000 AS m, 1.5 + o_orderkey % 5 AS a, o_orderkey * 7 % 12 AS y FROM orders),
    c AS (SELECT o_orderkey, sum(exp(lgamma(k + a) - lgamma(a) - lgamma(k + 1) + a * ln(a / (a + m)) + k * ln(m / (a + m)))) AS p FROM o JOIN range(0, 12) r(k) ON k <= y GROUP BY 1)
    SELECT CAST(least(floor(p * 10), 9) AS INT) AS bin, count(*) AS n FROM c GROUP BY 1""",
)
def pit_histogram(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    return R.pit_histogram(table(spark, d, "orders"), 2 + F.col("o_totalprice") / 100000, 1.5 + k % 5, k * 7 % 12)


_KM = "round(2 * 6371 * asin(sqrt(least(1.0, pow(sin(radians({b}lat - {a}lat) / 2), 2) + cos(radians({a}lat)) * cos(radians({b}lat)) * pow(sin(radians({b}lon - {a}lon) / 2), 2)))), 6)"


@query(
    "station_pair",
    f"""WITH v AS (SELECT c_custkey, c_custkey * 37 % 120 - 59.5 AS lat, c_custkey * 53 % 340 - 169.75 AS lon FROM customer), s AS (SELECT n_nationkey AS id, n_nationkey // 2 * 29 % 120 - 60 AS lat, n_nationkey // 2 * 71 % 340 - 170 AS lon FROM nation),
    d AS (SELECT c_custkey, s.*, {_KM.format(a="v.", b="s.")} AS km FROM v, s), r AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY km, id) AS k FROM d QUALIFY k <= 20),
    x AS (SELECT p.c_custkey, p.id AS "primary", p.km AS primary_km, b.id AS bid, b.km AS bkm FROM r p LEFT JOIN r b ON b.c_custkey = p.c_custkey AND {_KM.format(a="p.", b="b.")} >= 1 WHERE p.k = 1 QUALIFY row_number() OVER (PARTITION BY p.c_custkey ORDER BY b.k) = 1)
    SELECT c_custkey, "primary", round(primary_km, 3) AS primary_km, coalesce(bid, "primary") AS backup, round(coalesce(bkm, primary_km), 3) AS backup_km FROM x""",
)
def station_pair(spark: SparkSession, d: str) -> DataFrame:
    k, pos = F.col("c_custkey"), F.expr("CAST(n_nationkey DIV 2 AS INT)")
    venues = table(spark, d, "customer").select("c_custkey", (k * 37 % 120 - 59.5).alias("lat"), (k * 53 % 340 - 169.75).alias("lon"))
    stations = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), (pos * 29 % 120 - 60).cast("double").alias("lat"), (pos * 71 % 340 - 170).cast("double").alias("lon"))
    out = R.station_pair(venues, stations)
    return out.select("c_custkey", "primary", F.round("primary_km", 3).alias("primary_km"), "backup", F.round("backup_km", 3).alias("backup_km"))
