"""A sieve of fixed size before a join: wide rows that cannot have a partner are not shuffled.

``sieve`` marks the keys of one side in ``BITS`` bits; ``sifted`` tells by them which rows of
the other side may have a partner. It keeps every row that has one and others by chance, so
an exact join has to follow. The table of bits is broadcast: it has ``BITS / 8`` bytes at
most, whatever the input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from chronolake.runtime import materialize

BITS = 1900 << 15  # the broadcast table stays below 8 MiB, whatever is marked
BLOCK = 1 << 15  # bits a row, those of bitmap_construct_agg


def place(key: Column) -> Column:
    return F.pmod(key, F.lit(BITS))


def sieve(keys: DataFrame, key: Column) -> DataFrame:
    """(block, bits) of the hashes ``key`` of ``keys``, written to the shared folder. A hash of null marks nothing."""
    at = keys.select(place(key).alias("at")).where("at IS NOT NULL").select(F.expr(f"at DIV {BLOCK}").alias("block"), F.expr(f"at % {BLOCK}").alias("at"))
    # dealt by block first: a task hands on single bits, not whole blocks of them
    return materialize(at.repartition("block").groupBy("block").agg(F.bitmap_construct_agg("at").alias("bits")), "sieve")


def sifted(df: DataFrame, bits: DataFrame, key: Column, name: str = "may") -> DataFrame:
    """``df`` with a boolean ``name``: false only if no key of the sieve has the hash ``key``."""
    at = df.withColumn("__at", place(key))
    at = at.join(F.broadcast(bits.select(F.col("block").alias("__block"), "bits")), F.expr(f"__at DIV {BLOCK}") == F.col("__block"), "left")
    byte = F.conv(F.hex(F.expr(f"substring(bits, CAST(__at % {BLOCK} DIV 8 AS INT) + 1, 1)")), 16, 10).cast("int")
    bit = byte.bitwiseAND(F.expr("shiftleft(1, CAST(__at % 8 AS INT))")) != 0
    return at.withColumn(name, F.coalesce(bit, F.lit(False))).drop("__at", "__block", "bits")
