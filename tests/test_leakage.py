"""Prior-only operators must not move when the current row changes, and never show the future."""

import datetime as dt
import math

import pytest
from pyspark.sql import Window as W, functions as F

from chronolake.operators import asof as A, prior as P

POISON = 6666.0


def frame(spark, values):
    return spark.createDataFrame([("a", i, v) for i, v in enumerate(values)], "k string, i int, x double")


OPS = {
    "roll": lambda df: df.withColumn("f", P.rolling("x", P.ordered(["k"], ["i"]), 5, 3)),
    "std": lambda df: df.withColumn("f", P.rolling("x", P.ordered(["k"], ["i"]), 5, 3, "stddev_samp")),
    "ratio": lambda df: df.withColumn("f", P.rolling_ratio("x", "x", P.ordered(["k"], ["i"]), 5, 2)),
    "expanding": lambda df: df.withColumn("f", P.rolling("x", P.ordered(["k"], ["i"]), None, 3)),
    "ewma": lambda df: P.with_ewma(df, "x", ["k"], ["i"], 3.0, 2, "f"),
    "streak": lambda df: P.streak(df.withColumn("w", F.col("x") > 3), "w", ["k"], ["i"], "f"),
    "gap": lambda df: P.gap_since(df.withColumn("w", F.col("x") > 3), "w", ["k"], ["i"], "f"),
    "history": lambda df: df.withColumn("f", F.array_join(P.history("x", P.ordered(["k"], ["i"]), 3, F.lit(0.0)), ",")),
}


@pytest.mark.parametrize("name", sorted(OPS))
def test_current_row_does_not_count(spark, name):
    base = [1.0, 5.0, None, 4.0, 2.0, 7.0, 3.0, 8.0]
    for at in (0, 3, 6):
        moved = list(base)
        moved[at] = POISON
        a = {r.i: r.f for r in OPS[name](frame(spark, base)).collect()}
        b = {r.i: r.f for r in OPS[name](frame(spark, moved)).collect()}
        assert all(a[i] == b[i] for i in range(at + 1))


def test_rolling_by_hand(spark):
    got = [r.f for r in OPS["roll"](frame(spark, [1.0, None, 3.0, 5.0, 7.0, 9.0, 11.0])).orderBy("i").collect()]
    assert got == [None, None, None, None, 3.0, 4.0, 6.0]


def test_streak_by_hand(spark):
    df = spark.createDataFrame([("a", i, w) for i, w in enumerate([True, True, None, False, False, True])], "k string, i int, w boolean")
    got = [r.f for r in P.streak(df, "w", ["k"], ["i"], "f").orderBy("i").collect()]
    assert got == [None, 1, 2, 2, -1, -2]


def test_ewma_matches_the_definition_and_stays_finite(spark):
    xs = [float(i % 7) for i in range(4000)]
    got = [r.f for r in P.with_ewma(frame(spark, xs), "x", ["k"], ["i"], 1.0, 1, "f").orderBy("i").collect()]
    num = den = 0.0
    for i, x in enumerate(xs):
        if i:
            assert math.isclose(got[i], num / den, rel_tol=1e-9)
        num, den = num * 0.5 + x, den * 0.5 + 1


def test_calendar_window_leaves_the_day_out(spark):
    rows = [("a", 1, dt.date(2024, 5, 1), 1.0), ("a", 2, dt.date(2024, 5, 3), 10.0), ("a", 3, dt.date(2024, 5, 3), 20.0), ("a", 4, dt.date(2024, 5, 4), 5.0)]
    df = spark.createDataFrame(rows, "k string, i int, d date, x double")
    got = [r.f for r in df.withColumn("f", P.calendar_sum("x", ["k"], "d", 3)).orderBy("i").collect()]
    assert got == [0.0, 1.0, 1.0, 31.0]


def test_asof_edges(spark):
    left = spark.createDataFrame([("a", 1, 10), ("a", 2, 20), ("a", 3, 5), ("b", 4, 10), (None, 5, 10), ("a", 6, None)], "k string, id int, t int")
    right = spark.createDataFrame([("a", 10, 1.0), ("a", 15, 2.0), ("c", 9, POISON), ("a", None, POISON)], "k string, q int, x double")
    got = {r.id: r.x for r in A.asof(left, right, ["k"], "t", "q", ["x"], prefix="").collect()}
    assert got == {1: 1.0, 2: 2.0, 3: None, 4: None, 5: None, 6: None}
    strict = {r.id: r.x for r in A.asof(left, right, ["k"], "t", "q", ["x"], strict=True, prefix="").collect()}
    assert strict[1] is None and strict[2] == 2.0
    clamp = {r.id: r.x for r in A.asof(left, right, ["k"], "t", "q", ["x"], clamp=True, prefix="").collect()}
    assert clamp[3] == 1.0 and clamp[4] is None


def test_asof_never_looks_ahead(spark):
    left = spark.createDataFrame([(i, i * 10) for i in range(20)], "id int, t int").withColumn("k", F.lit(1))
    right = spark.range(20).select(F.lit(1).alias("k"), (F.col("id") * 10 + 5).cast("int").alias("q"), F.when(F.col("id") >= 10, POISON).otherwise(F.col("id")).alias("x"))
    assert all(r.x != POISON for r in A.asof(left, right, ["k"], "t", "q", ["x"], prefix="").where("t < 105").collect())


def test_tritemporal_needs_availability(spark):
    need = spark.createDataFrame([("v", 100, 50)], "k string, valid int, decision int")
    issues = spark.createDataFrame([("v", 100, 30, 40, 1.0), ("v", 100, 45, 55, POISON), ("v", 99, 49, 49, POISON)], "k string, valid int, issue int, available int, x double")
    row = A.freshest_issue(need, issues, ["k", "valid"], "decision", "available", "issue", ["x"]).first()
    assert (row.issue, row.x) == (30, 1.0)


def test_no_operator_frame_reaches_the_current_row_unasked():
    import inspect

    for name in ("before", "rolling", "rolling_ratio", "expanding_ratio_of_means"):
        assert ", 0)" not in inspect.getsource(getattr(P, name))
    assert W.currentRow == 0
