"""Stateful streams: replay of a table, closed windows, change publishing, sequence gates, upserts."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from chronolake.runtime import shared_dir, ship


def replay(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A stream of the files of table ``name`` below ``folder``."""
    ship(spark)
    path = f"{folder}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())
    reader = spark.readStream.schema(schema)
    if fs.getFileStatus(fs_path).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there, into files of the shared folder, and reads them back."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").outputMode(mode).option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def tumbling(events: DataFrame, time: str, late: str, width: str, keys: list[str], value: str) -> DataFrame:
    """Count and sum of each closed window and key; a window closes when the watermark passes its end."""
    marked = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    agg = marked.groupBy(F.window(time, width), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return agg.select(F.col("window.start").alias("start"), *keys, "n", "total")


def sessions(events: DataFrame, time: str, late: str, gap: str, keys: list[str]) -> DataFrame:
    """Start, end and size of each closed session of a key."""
    marked = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    agg = marked.groupBy(F.session_window(time, gap), *keys).agg(F.count(F.lit(1)).alias("n"))
    return agg.select(*keys, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def once(events: DataFrame, keys: list[str], time: str | None = None, late: str | None = None) -> DataFrame:
    """The first row of each key; with a watermark, state is kept for ``late`` only."""
    if time is None:
        return events.dropDuplicates(keys)
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def keyed_state(events: DataFrame, keys: list[str], output: str, state: str, step: Callable[[tuple, pd.DataFrame, tuple | None], tuple[pd.DataFrame, tuple]]) -> DataFrame:
    """A state machine per key: ``step`` maps (key, rows, state or none) to (rows out, state)."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches))
        out, new = step(key, rows, held.get if held.exists else None)
        held.update(new)
        yield out

    return events.groupBy(*keys).applyInPandasWithState(run, output, state, "append", GroupStateTimeout.NoTimeout)


def changes(events: DataFrame, key: str, order: list[str], value: str, heartbeat: float | None = None) -> DataFrame:
    """(key, order.., value) of the rows at which a key's value changes, the first included, or ``heartbeat`` seconds after the last publication."""
    kinds = {f.name: f.dataType.simpleString() for f in events.schema}
    cols = [key, *order, value]

    def step(k: tuple, rows: pd.DataFrame, held: tuple | None) -> tuple[pd.DataFrame, tuple]:
        rows = rows.sort_values(order)
        last, at = held if held else (None, float("-inf"))
        keep = []
        for v, t in zip(rows[value], rows[order[0]]):
            seconds = pd.Timestamp(t).timestamp()
            publish = v != last or heartbeat is not None and seconds - at >= heartbeat
            keep.append(publish)
            if publish:
                last, at = v, seconds
        return rows.loc[keep, cols], (last, float(at))

    return keyed_state(events.select(*cols), [key], ", ".join(f"{c} {kinds[c]}" for c in cols), f"last {kinds[value]}, at double", step)


def in_sequence(events: DataFrame, key: str, arrival: list[str], sequence: str) -> DataFrame:
    """(key, arrival.., sequence, ok): whether a row's sequence number is at least all that its key has shown."""
    kinds = {f.name: f.dataType.simpleString() for f in events.schema}
    cols = [key, *arrival, sequence]

    def step(k: tuple, rows: pd.DataFrame, held: tuple | None) -> tuple[pd.DataFrame, tuple]:
        rows = rows.sort_values(arrival)
        top = rows[sequence].cummax()
        before = top.shift(1)
        if held:
            before = before.fillna(held[0]).clip(lower=held[0])
        out = rows[cols].assign(ok=before.isna() | (rows[sequence] >= before))
        return out, (int(max(top.iloc[-1], held[0]) if held else top.iloc[-1]),)

    return keyed_state(events.select(*cols), [key], ", ".join(f"{c} {kinds[c]}" for c in cols) + ", ok boolean", "top long", step)


def upsert_batches(stream: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Latest row of each key after all micro-batches; each batch writes a new version, so a retry changes nothing."""
    from chronolake.operators.quality import keep_last

    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/upsert-{uuid.uuid4().hex}"

    def write(batch: DataFrame, n: int) -> None:
        old = batch.sparkSession.read.schema(batch.schema).parquet(f"{base}/v{n - 1}") if n else None
        rows = batch if old is None else batch.unionByName(old)
        keep_last(rows, keys, order).write.mode("overwrite").parquet(f"{base}/v{n}")
        write.last = n

    write.last = -1
    stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/v{write.last}")
