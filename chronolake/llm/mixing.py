"""Mixing sources to target weights by Poisson replication.

Each source gets a mean repetition rate: its target share of the characters to draw over
the characters it has. A document's number of copies inverts the Poisson distribution with
that mean at a number in [0, 1) that is a hash of seed and id; so the copies of a document
depend on nothing but its id, text and rate. Copies are exploded and put in the order of
another hash: a global shuffle that can be repeated.

Weights: a dict of source weights (sources not named get ``other``), or none; then the
target shares are proportional to the square root of the sources' sizes. ``epochs`` is the
size of the mix in times of the input. A null source is a source of its own; null texts
have no characters and are drawn like others; repeated rows draw alike. A source without
characters is drawn at the rate ``epochs``. Empty table: no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from chronolake.llm.simhash import apart
from chronolake.runtime import materialize, width

SOURCES = 10_000
BITS = 52
PART = 64 << 20
WHOLE = 500.0  # exp(-rate) stays far from underflow


def unit(*parts: Column | str, salt: str) -> Column:
    """A number in [0, 1) from the first 13 hex digits of an MD5."""
    text = F.concat_ws(":", F.lit(salt), *[F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("-")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << BITS))


def poisson_count(u: Column, rate: Column) -> Column:
    """Smallest k whose Poisson probability of at most k exceeds ``u``, for rates up to ``WHOLE``."""
    top = (F.ceil(rate + 12 * F.sqrt(rate)) + 30).cast("int")
    step = lambda s, i: F.when(
        s["cdf"] > u, s
    ).otherwise(F.struct((s["k"] + 1).alias("k"), (s["p"] * rate / (s["k"] + 1)).alias("p"), (s["cdf"] + s["p"] * rate / (s["k"] + 1)).alias("cdf")))
    start = F.struct(F.lit(0).cast("int").alias("k"), F.exp(-rate).alias("p"), F.exp(-rate).alias("cdf"))
    return F.aggregate(F.sequence(F.lit(1), top), start, step, lambda s: s["k"])


def draws(key: Column | str, rate: Column, salt: str) -> Column:
    """The copies of a document; a rate over ``WHOLE`` is drawn as a sum of equal parts, each with its own hash."""
    parts = F.ceil(rate / WHOLE).cast("int")
    many = F.aggregate(F.sequence(F.lit(1), parts), F.lit(0), lambda n, i: n + poisson_count(unit(key, i, salt=salt), rate / parts))
    return F.when(rate <= WHOLE, poisson_count(unit(key, salt=salt), rate)).otherwise(many)


def rates(docs: DataFrame, weights: dict[str | None, float] | None = None, other: float = 0.0, epochs: float = 1.0) -> DataFrame:
    """(source, chars, rate): one row a source, from the characters of all documents."""
    per = docs.groupBy("source").agg(F.sum(F.coalesce(F.length("text"), F.lit(0)).cast("long")).alias("chars"))
    if weights is None:
        want = F.sqrt(F.col("chars").cast("double"))
    else:
        want = F.lit(float(other))
        for name, w in weights.items():
            want = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(w))).otherwise(want)
        want = F.when(F.col("chars") > 0, want).otherwise(0.0)
    per = per.withColumn("want", want)
    total = per.agg(F.sum("want").alias("all_want"), F.sum("chars").alias("all_chars"))
    share = F.try_divide(F.col("want"), F.col("all_want"))
    rate = F.when(F.col("chars") > 0, F.coalesce(share * epochs * F.col("all_chars") / F.col("chars"), F.lit(0.0))).otherwise(F.lit(float(epochs)))
    # both sides come from one row a source
    return per.join(F.broadcast(total)).select("source", "chars", rate.alias("rate"))


def with_rates(docs: DataFrame, table: DataFrame, salts: int = 64) -> DataFrame:
    """``docs`` with the rate of the source: a broadcast behind a check of its rows, else a salted join."""
    table = table.select(F.col("source").alias("__source"), F.col("rate").alias("__rate"))
    if table.limit(SOURCES + 1).count() <= SOURCES:
        return docs.join(F.broadcast(table), docs["source"].eqNullSafe(table["__source"]), "left").drop("__source")
    many = table.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = docs.withColumn("__s", F.pmod(F.xxhash64("doc_id", "text"), F.lit(salts)))
    return salted.join(many, salted["source"].eqNullSafe(many["__source"]) & (salted["__s"] == many["__salt"]), "left").drop("__source", "__s", "__salt")


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, other: float = 0.0, epochs: float = 1.0, seed: int = 11) -> DataFrame:
    """All columns of ``docs`` with ``copy`` (0..) and ``position`` (the shuffle's key), shuffled globally.

    Positions are even in [0, 1): partition i of n has those from i / n to (i + 1) / n, sorted,
    so the order is the same however many partitions there are. A partition has about
    ``PART`` bytes. Columns of these two names in ``docs`` are replaced; ``mix_documents`` keeps them.
    """
    spark = docs.sparkSession
    found = materialize(rates(docs, weights, other, epochs), "rates")
    rated = with_rates(docs, found)
    drawn = rated.withColumn("__n", draws("doc_id", F.col("__rate"), f"n{seed}")).where("__n > 0")
    copies = drawn.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
    placed = copies.withColumn("position", unit("doc_id", "copy", salt=f"p{seed}")).drop("__n", "__rate")
    expected = found.agg(F.sum(F.col("rate") * F.col("chars"))).first()[0] or 0.0
    parts = max(width(spark), int(expected // PART) + 1)
    return placed.repartitionById(parts, F.floor(F.col("position") * parts).cast("int")).sortWithinPartitions("position", "doc_id", "copy")


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The shuffled copies with the columns of ``docs`` alone, whatever their names; empty input gives no rows."""
    cols = docs.columns
    inner = apart(docs, ("doc_id", "text", "source"))
    return mix(inner, **options).select(*inner.columns).toDF(*cols)


#: DuckDB SQL of the default mix over documents: seed 11, square-root shares, one epoch.
ORACLE_MIX = """
WITH RECURSIVE per AS (
  SELECT source, sum(coalesce(length(text), 0))::BIGINT AS chars FROM documents GROUP BY source
), total AS (SELECT sum(sqrt(chars)) AS all_want, sum(chars) AS all_chars FROM per),
rate AS (SELECT source, CASE WHEN chars > 0 THEN sqrt(chars) / all_want * 1.0 * all_chars / chars ELSE 1.0 END AS rate FROM per, total),
u AS (
  SELECT d.*, r.rate, ('0x' || substr(md5('n11:' || coalesce(d.doc_id::VARCHAR, '-')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS u
  FROM documents d JOIN rate r ON d.source IS NOT DISTINCT FROM r.source
), walk AS (
  SELECT doc_id, u, rate, 0 AS k, exp(-rate) AS p, exp(-rate) AS cdf FROM (SELECT DISTINCT doc_id, u, rate FROM u)
  UNION ALL
  SELECT doc_id, u, rate, k + 1, p * rate / (k + 1), cdf + p * rate / (k + 1) FROM walk
  WHERE cdf <= u AND k < ceil(rate + 12 * sqrt(rate)) + 30
), n AS (SELECT doc_id, rate, max(k) AS n FROM walk GROUP BY doc_id, rate),
copies AS (
  SELECT u.doc_id, u.text, u.lang, u.source, u.n_chars, unnest(range(0, n.n))::INTEGER AS copy
  FROM u JOIN n ON u.doc_id IS NOT DISTINCT FROM n.doc_id AND u.rate = n.rate
)
SELECT doc_id, text, lang, source, n_chars, copy,
  ('0x' || substr(md5('p11:' || coalesce(doc_id::VARCHAR, '-') || ':' || copy), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS position
FROM copies
"""
