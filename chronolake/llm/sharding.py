"""Sharding by a Feistel permutation of global row numbers, with cycle walking.

Every row gets its number 0..N-1 in document order. A keyed Feistel network permutes
``a * b >= N`` numbers (``a = ceil(sqrt N)``, ``b = ceil(N / a)``); numbers that land
outside are walked on through the network until they land inside, which keeps it a
permutation of 0..N-1. Shard and slot follow from the permuted number by division, so
they can be computed for any row number without looking at another row.

Nulls: a null id sorts first, a null text counts no bytes and has the checksum of the
empty text. Repeated rows each take a place of their own. Empty input: no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from chronolake.operators.order import dense_row_numbers

PRIME = 2_147_483_647
ROUNDS = 8
WALKS = 64


def round_keys(seed: int) -> list[tuple[int, int]]:
    """Multiplier and increment of each round, from a linear congruential sequence."""
    keys, x = [], (seed * 2_654_435_761 + 12_345) % PRIME
    for _ in range(ROUNDS):
        x = (x * 48_271 + 11) % PRIME
        y = (x * 48_271 + 13) % PRIME
        keys.append((x % 1_000_000_007 + 1, y % 1_000_000_007 + 1))
        x = y
    return keys


def sides(n: int) -> tuple[int, int]:
    a = max(1, math.isqrt(max(n, 1)))
    a += a * a < n
    return a, max(1, -(-n // a))


def feistel_sql(x: str, n: int, seed: int) -> str:
    """SQL text of one pass of the network over the number ``x``; nested subexpressions, no state."""
    a, b = sides(n)
    left, right = f"(({x}) DIV {b})", f"(({x}) % {b})"
    pair = f"named_struct('l', {left}, 'r', {right})"
    for i, (mul, add) in enumerate(round_keys(seed)):
        src, dst, size = ("r", "l", a) if i % 2 == 0 else ("l", "r", b)
        mixed = f"((p.{src} * {mul}L + {add}L) % {PRIME}L)"
        value = f"((p.{dst} + ({mixed} * {mixed} + {mixed}) % {PRIME}L) % {size})"
        pair = f"transform(array({pair}), p -> named_struct('l', {value if dst == 'l' else 'p.l'}, 'r', {value if dst == 'r' else 'p.r'}))[0]"
    return f"transform(array({pair}), p -> p.l * {b} + p.r)[0]"


def permute(row: Column | str, n: int, seed: int) -> Column:
    """The place of row number ``row`` among 0..n-1. A walk that does not end raises, it never drops."""
    name = row if isinstance(row, str) else "__row"
    walked = f"aggregate(sequence(1, {WALKS}), {feistel_sql(name, n, seed)}, (v, i) -> CASE WHEN v < {n} THEN v ELSE {feistel_sql('v', n, seed)} END)"
    return F.expr(f"transform(array({walked}), v -> CASE WHEN v < {n} THEN v ELSE CAST(raise_error('cycle walk did not end') AS BIGINT) END)[0]")


def permute_int(row: int, n: int, seed: int) -> int:
    """The same permutation for one number on the driver: finds a row's place without Spark."""
    a, b = sides(n)
    while True:
        left, right = divmod(row, b)
        for i, (mul, add) in enumerate(round_keys(seed)):
            m = ((right if i % 2 == 0 else left) * mul + add) % PRIME
            f = (m * m + m) % PRIME
            left, right = ((left + f) % a, right) if i % 2 == 0 else (left, (right + f) % b)
        row = left * b + right
        if row < n:
            return row


def shard(docs: DataFrame, n_shards: int = 40, seed: int = 7, keep: list[str] | None = None) -> DataFrame:
    """One output row for each row of ``docs``: ``keep`` columns, size, text_crc32, row, shard, slot.

    Shard sizes in rows differ by one at most; slots run 0.. without gaps in each shard. Of the
    ``keep`` columns those with the name of an own one give way to it.
    """
    keep = ["doc_id"] if keep is None else keep
    slim = docs.select(
        *[F.col(c).alias(f"__k{i}") for i, c in enumerate(keep)],
        F.col("doc_id").alias("__id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 16).alias("size"),
        F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).cast("long").alias("text_crc32"),
    )
    numbered, n = dense_row_numbers(slim, [F.col("__id"), F.col("text_crc32"), F.col("size")], "row")
    placed = numbered.withColumn("place", permute("row", max(n, 1), seed))
    own = {
        "size": F.col("size"), "text_crc32": F.col("text_crc32"), "row": F.col("row"),
        "shard": (F.col("place") % n_shards).cast("int"), "slot": F.expr(f"place DIV {n_shards}").cast("long"),
    }
    return placed.select(*[F.col(f"__k{i}").alias(c) for i, c in enumerate(keep) if c not in own], *[v.alias(c) for c, v in own.items()])
