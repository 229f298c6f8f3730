"""Prior-only windows: a value on a row uses strictly earlier rows of the same entity.

All frames end before the current row unless a function says otherwise. ``order`` must be a
total order inside an entity. Nulls in a value are skipped by the aggregates and do not
count for ``least``; null keys form an entity of their own (filter them first if the
contract drops them). Functions give columns, so that columns with the same frame share
one sort and one exchange.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, WindowSpec, functions as F

Name = str | Column


def col(x: Name) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ordered(keys: Sequence[Name], order: Sequence[Name]) -> WindowSpec:
    return W.partitionBy(*keys).orderBy(*order)


def before(w: WindowSpec, rows: int | None = None) -> WindowSpec:
    """The last ``rows`` rows before the current one, or all of them."""
    return w.rowsBetween(W.unboundedPreceding if rows is None else -rows, -1)


def gated(value: Column, x: Column, frame: WindowSpec, least: int) -> Column:
    """``value`` if the frame has ``least`` non-null values of ``x``, else null."""
    return F.when(F.count(x).over(frame) >= least, value)


def rolling(x: Name, w: WindowSpec, rows: int | None, least: int, how: str = "avg") -> Column:
    """avg, sum, min, max, stddev_samp or count of the ``rows`` values before the current row (all: None)."""
    frame = before(w, rows)
    return gated(getattr(F, how)(col(x)).over(frame), col(x), frame, least)


def default_least(rows: int) -> int:
    return max(3, rows // 2)


def rolling_ratio(num: Name, den: Name, w: WindowSpec, rows: int | None, least: int, floor: float | None = None) -> Column:
    """Ratio of the sums of two values over the frame; a floor bounds the divisor from below, zero divisors give null."""
    frame = before(w, rows)
    below = F.sum(col(den)).over(frame)
    below = F.greatest(below, F.lit(floor)) if floor is not None else below
    return gated(F.try_divide(F.sum(col(num)).over(frame), below), col(den), frame, least)


def expanding_ratio_of_means(num: Name, den: Name, w: WindowSpec, least: int, floor: float) -> Column:
    """Expanding mean of one value over that of another, the divisor bounded from below."""
    frame = before(w)
    return gated(F.avg(col(num)).over(frame) / F.greatest(F.avg(col(den)).over(frame), F.lit(floor)), col(num), frame, least)


def with_ewma(df: DataFrame, x: str, keys: Sequence[str], order: Sequence[Name], halflife: float, least: int, name: str) -> DataFrame:
    """``df`` with the exponentially weighted mean of earlier values.

    Closed form: sum of x * 2**(i / halflife) over sum of 2**(i / halflife). Positions count
    in blocks of ``900 * halflife``, so that powers stay finite; a block adds the sums of the
    one before it, 2**-900 times, and what lies further back is below a double's resolution.
    """
    w = ordered(keys, order)
    block = int(900 * halflife)
    placed = df.withColumn("__i", F.row_number().over(w)).withColumn("__b", F.expr(f"__i DIV {block}"))
    weighed = placed.withColumn("__w", F.pow(F.lit(2.0), (F.col("__i") - F.col("__b") * block) / F.lit(float(halflife))))
    value = weighed.withColumn("__x", F.col("__w") * F.col(x)).withColumn("__v", F.when(F.col(x).isNotNull(), F.col("__w")))
    here = before(W.partitionBy(*keys, "__b").orderBy(*order))
    last = W.partitionBy(*keys).orderBy("__b").rangeBetween(-1, -1)
    shift = 2.0 ** (-block / halflife)
    total = lambda c: F.coalesce(F.sum(c).over(here), F.lit(0.0)) + F.coalesce(F.sum(c).over(last), F.lit(0.0)) * shift
    count = F.count(F.col(x)).over(before(w))
    return value.withColumn(name, F.when(count >= least, F.try_divide(total("__x"), total("__v")))).drop("__i", "__b", "__w", "__x", "__v")


def streak(df: DataFrame, won: str, keys: Sequence[str], order: Sequence[Name], name: str) -> DataFrame:
    """``df`` with the signed run of equal outcomes before each row; rows with a null outcome keep the run going."""
    w = ordered(keys, order)
    known = W.partitionBy(*keys, F.col(won).isNull()).orderBy(*order)
    step = df.withColumn("__p", F.row_number().over(known)).withColumn("__q", F.row_number().over(W.partitionBy(*keys, F.col(won).isNull(), won).orderBy(*order)))
    island = W.partitionBy(*keys, won, F.col(won).isNull(), F.col("__p") - F.col("__q")).orderBy(*order)
    run = step.withColumn("__run", F.when(F.col(won).isNotNull(), F.row_number().over(island) * F.when(F.col(won), 1).otherwise(-1)))
    return run.withColumn(name, F.last("__run", True).over(before(w))).drop("__p", "__q", "__run")


def calendar_sum(x: Name, keys: Sequence[Name], day: Name, days: int, how: str = "sum") -> Column:
    """Aggregate over the ``days`` calendar days before the current one, which is left out; 0 when there are none."""
    frame = W.partitionBy(*keys).orderBy(F.unix_date(col(day).cast("date"))).rangeBetween(-days, -1)
    return F.coalesce(getattr(F, how)(col(x)).over(frame), F.lit(0))


def days_since(day: Name, w: WindowSpec) -> Column:
    return F.date_diff(col(day).cast("date"), F.lag(col(day).cast("date")).over(w)).cast("long")


def pair_key(a: Name, b: Name) -> Column:
    """The same key for both orders of a pair; compared as text."""
    x, y = col(a).cast("string"), col(b).cast("string")
    return F.concat_ws("|", F.least(x, y), F.greatest(x, y))


def history(x: Name, w: WindowSpec, length: int, pad: Column) -> Column:
    """The last ``length`` values before the current row, padded on the left."""
    got = F.collect_list(F.coalesce(col(x), pad)).over(before(w, length))
    return F.concat(F.array_repeat(pad, F.lit(length) - F.size(got)), got)


def running_max(x: Name, floor: Name, w: WindowSpec) -> Column:
    """Running maximum of a value that is at least ``floor``; the current row counts."""
    return F.max(F.greatest(col(x), col(floor))).over(w.rowsBetween(W.unboundedPreceding, 0))


def fill_forward(x: Name, w: WindowSpec, default: Column) -> Column:
    """Last non-null value up to and with the current row."""
    return F.coalesce(F.last(col(x), True).over(w.rowsBetween(W.unboundedPreceding, 0)), default)


def trailing(x: Name, w: WindowSpec, rows: int, how: str = "sum") -> Column:
    """Aggregate over the last ``rows`` rows, the current one counted."""
    return getattr(F, how)(col(x)).over(w.rowsBetween(1 - rows, 0))


def gap_since(df: DataFrame, present: str, keys: Sequence[str], order: Sequence[Name], name: str) -> DataFrame:
    """``df`` with the number of consecutive rows without ``present`` just before each row; null on the first."""
    w = ordered(keys, order)
    mark = F.sum(F.when(F.col(present), 1).otherwise(0)).over(w.rowsBetween(W.unboundedPreceding, 0))
    run = df.withColumn("__g", mark)
    count = F.sum(F.when(F.col(present), 0).otherwise(1)).over(W.partitionBy(*keys, "__g").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return run.withColumn("__c", count).withColumn(name, F.lag("__c").over(w)).drop("__g", "__c")


def decay(age: Name, rate: float) -> Column:
    return F.exp(-F.lit(float(rate)) * col(age))


def average_rank(x: Name, keys: Sequence[Name] = (), descending: bool = False) -> Column:
    """Rank in which ties share the mean of their places."""
    by = col(x).desc() if descending else col(x).asc()
    w = W.partitionBy(*keys).orderBy(by)
    return F.rank().over(w) + (F.count(F.lit(1)).over(W.partitionBy(*keys, col(x))) - 1) / 2
