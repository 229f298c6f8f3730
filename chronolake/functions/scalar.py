"""Text, sentinel and vocabulary functions as columns."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import chain

from pyspark.sql import Column, functions as F


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def extract(x: Column | str, regex: str, group: int = 1) -> Column:
    """A regex group, null where it does not match."""
    return F.nullif(F.regexp_extract(col(x), regex, group), F.lit(""))


def missing(x: Column | str, sentinels: Sequence) -> Column:
    """Null where a value is one of the sentinels."""
    return F.when(~col(x).isin(*sentinels), col(x))


def number(x: Column | str) -> Column:
    """A double, null where the text is none, NaN or infinite."""
    v = col(x).try_cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)


def metar_number(x: Column | str) -> Column:
    """Report fields: M is missing, T a trace (0)."""
    return F.when(F.trim(col(x)) == "T", F.lit(0.0)).otherwise(number(x))


def keyword_class(x: Column | str, rules: Sequence[tuple[str, str]], other: str) -> Column:
    """Label of the first keyword that the lower-cased text contains."""
    low, out = F.lower(col(x)), None
    for word, label in rules:
        hit = low.contains(word)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(other)


def vocabulary(x: Column | str, index: dict[str, int]) -> Column:
    """Index of a trimmed text in a vocabulary, 0 when it is not there."""
    table = F.create_map(*[F.lit(v) for v in chain.from_iterable(index.items())])
    return F.coalesce(F.try_element_at(table, F.trim(col(x))), F.lit(0))


def hash_bucket(x: Column | str, n: int) -> Column:
    """Bucket 1..n-1 of a text by its hash; 0 for null."""
    return F.when(col(x).isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(col(x)), F.lit(n - 1)).cast("int") + 1)


def height_inches(x: Column | str) -> Column:
    """Inches of a height written like 5' 11"."""
    return extract(x, r"^\s*(\d+)'").cast("int") * 12 + F.coalesce(extract(x, r"'\s*(\d+)").cast("int"), F.lit(0))


def first_date(x: Column | str, formats: Sequence[str]) -> Column:
    """The first format that parses."""
    return F.coalesce(*[F.try_to_timestamp(col(x), F.lit(f)) for f in formats])


def line_outcome(kind: str, value: Column, line: Column, high: Column | None = None) -> Column:
    """Whether a value settles a line: above, below, exactly, at_least, between (ends count)."""
    if kind == "between":
        if high is None:
            raise ValueError("between takes two lines")
        return (value >= line) & (value <= high)
    tests = {"above": value > line, "below": value < line, "exactly": value == line, "at_least": value >= line}
    if kind not in tests:
        raise ValueError(f"unknown kind of line: {kind}")
    return tests[kind]
