"""Snapshot folders, aligned chunks, appended columns, idempotent ingest and line tapes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from chronolake.sources.scan import conform

DAMAGED = "_damaged"


def snapshots(spark: SparkSession, path: str, schema: T.StructType, flat: Mapping[str, str], as_json: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Rows of the whole-file JSON documents below ``path`` (nested fields flattened by ``flat``: name to field, ``as_json`` as text), and the files that could not be read, with what was read of them."""
    with_mark = T.StructType([*schema.fields, T.StructField(DAMAGED, T.StringType())])
    read = spark.read.schema(with_mark).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", DAMAGED).json(path)
    read = read.withColumn("file", F.input_file_name())
    good = read.where(F.col(DAMAGED).isNull())
    cols = [F.col(f).alias(n) for n, f in flat.items()] + [F.to_json(c).alias(c) for c in as_json]
    return good.select("file", *cols), read.where(F.col(DAMAGED).isNotNull()).select("file", *schema.names)


def write_aligned(chunks: Sequence[DataFrame], path: str) -> None:
    """Appends chunks of differing columns in the first one's schema: missing columns are null, others go, types are cast (null if that fails)."""
    for chunk in chunks:
        conform(chunk, chunks[0].schema, {T.StringType: None, T.LongType: None, T.BooleanType: None}).write.mode("append").parquet(path)


def append_columns(store: DataFrame, features: DataFrame, keys: Sequence[str], gates: Mapping[str, Column] | None = None, least_known: float = 0.0) -> DataFrame:
    """``store`` with the columns of ``features`` by key; columns of the same name are replaced, so that a second call changes nothing.

    Rows and their number stay. Refused (ValueError): repeated keys in ``features``, a known
    value that breaks its gate, a column of which less than ``least_known`` of the store's rows are known.
    """
    new = [c for c in features.columns if c not in keys]
    if features.groupBy(*keys).count().where("count > 1").limit(1).count():
        raise ValueError("repeated keys")
    out = store.drop(*new).join(features, list(keys), "left")
    known = {c: F.avg(F.col(c).isNotNull().cast("double")).alias(f"known_{c}") for c in new}
    broken = {c: F.count(F.when(F.col(c).isNotNull() & ~gate, 1)).alias(f"broken_{c}") for c, gate in (gates or {}).items()}
    found = out.agg(*known.values(), *broken.values()).first().asDict()
    bad = [k for k, v in found.items() if v is not None and (v > 0 if k.startswith("broken_") else v < least_known)]
    if bad:
        raise ValueError(f"refused: {', '.join(sorted(bad))}")
    return out


def pending(wanted: DataFrame, ledger: DataFrame, key: str, tries: int = 3) -> DataFrame:
    """The distinct ids that no ledger row (``key``, ok) has completed and that failed fewer than ``tries`` times."""
    over = ledger.groupBy(key).agg(F.max(F.col("ok").cast("int")).alias("__ok"), F.count(F.lit(1)).alias("__n")).where((F.col("__ok") == 1) | (F.col("__n") >= tries))
    return wanted.select(key).where(F.col(key).isNotNull()).distinct().join(over.select(key), key, "left_anti")


def ingest(rows: DataFrame, path: str, ledger: str, key: str, batch: str) -> None:
    """Writes one batch of rows to its own folder and then notes its ids; a batch that is run again replaces itself."""
    folder = f"{path}/batch={batch}"
    rows.write.mode("overwrite").parquet(folder)
    done = rows.sparkSession.read.schema(rows.schema).parquet(folder).select(key, F.lit(True).alias("ok")).distinct()
    done.write.mode("overwrite").parquet(f"{ledger}/batch={batch}")


def append_lines(df: DataFrame, path: str, day: str) -> None:
    """Appends rows as JSON lines, a folder a day; nothing that is there changes."""
    df.write.mode("append").partitionBy(day).json(path)
