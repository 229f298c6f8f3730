"""Catalog scans, schema drift, nested feeds and typed sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from chronolake.operators.quality import keep_last


class Catalog:
    """Logical tables over Parquet folders, partitioned by season or by other key folders."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root, self.paths = spark, root.rstrip("/"), {}

    def register(self, table: str, path: str) -> Catalog:
        self.paths[table] = path
        return self

    def read(self, table: str, columns: Sequence[str] | None = None, **partitions: Sequence) -> DataFrame:
        """The table, pruned to partitions (``season=[2023, 2024]``) and projected; corrupt files are skipped, schemas merged.

        A column that the caller names and the table lacks raises.
        """
        if table not in self.paths:
            raise KeyError(f"unknown table: {table}")
        df = self.spark.read.option("mergeSchema", "true").option("ignoreCorruptFiles", "true").option("basePath", f"{self.root}/{self.paths[table]}").parquet(f"{self.root}/{self.paths[table]}")
        for key, values in partitions.items():
            df = df.where(F.col(key).isin(*values))
        if columns is not None:
            lost = [c for c in columns if c not in df.columns]
            if lost:
                raise ValueError(f"{table} has no columns {lost}")
            df = df.select(*columns)
        return df


def seasons(first: int, last: int) -> list[int]:
    if last < first:
        raise ValueError("the last season lies before the first")
    return list(range(first, last + 1))


def normalise(df: DataFrame, sentinels: dict[str, Sequence] | None = None) -> DataFrame:
    """NaN and infinities to null in float columns; named sentinels to null."""
    out = []
    for f in df.schema:
        c: Column = F.col(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)
        if sentinels and f.name in sentinels:
            c = F.when(~c.isin(*sentinels[f.name]), c)
        out.append(c.alias(f.name))
    return df.select(*out)


def unify(frames: Sequence[DataFrame], aliases: dict[str, Sequence[str]]) -> DataFrame:
    """Union of frames of several writer generations; each alias list becomes the first of its columns that is set."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    for name, olds in aliases.items():
        have = [c for c in olds if c in out.columns]
        if have:
            out = out.withColumn(name, F.coalesce(*have)).drop(*[c for c in have if c != name])
    return out


def conform(df: DataFrame, schema: T.StructType, defaults: dict[type, object] | None = None) -> DataFrame:
    """Columns cast to a schema; missing ones take the default of their type, values that do not cast become null."""
    fill = {T.StringType: "None", T.LongType: -1, T.DoubleType: None, T.BooleanType: False} | (defaults or {})
    cols = []
    for f in schema:
        if f.name in df.columns:
            cols.append(F.col(f.name).try_cast(f.dataType).alias(f.name))
        else:
            cols.append(F.lit(fill.get(type(f.dataType))).cast(f.dataType).alias(f.name))
    return df.select(*cols)


def write_partitioned(df: DataFrame, path: str, keys: Sequence[str], mode: str = "append") -> None:
    """Typed sink: rows gathered by partition key, so that each folder gets few files."""
    df.repartition(*keys).write.mode(mode).partitionBy(*keys).parquet(path)


def upsert_version(df: DataFrame, old: str | None, new: str, keys: Sequence[str], order: Sequence[str]) -> None:
    """Writes ``new``: the rows of ``old`` and ``df``, the last of each key."""
    rows = df if old is None else df.sparkSession.read.parquet(old).unionByName(df, allowMissingColumns=True)
    keep_last(rows, keys, order).write.mode("overwrite").parquet(new)


GAME = T.StructType([
    T.StructField("game_pk", T.LongType()),
    T.StructField("plays", T.ArrayType(T.StructType([
        T.StructField("about", T.StructType([T.StructField("inning", T.StringType()), T.StructField("half", T.StringType())])),
        T.StructField("events", T.ArrayType(T.StructType([T.StructField("type", T.StringType()), T.StructField("speed", T.StringType())]))),
        T.StructField("runners", T.ArrayType(T.StructType([T.StructField("id", T.LongType()), T.StructField("credits", T.ArrayType(T.StringType()))]))),
    ]))),
])


def flatten_feed(raw: DataFrame, body: str = "body") -> dict[str, DataFrame]:
    """Plays, events, runners and credits of nested JSON games; malformed documents give no rows, bad numbers null."""
    games = raw.select(F.from_json(body, GAME).alias("g")).where("g.game_pk IS NOT NULL")
    plays = games.select("g.game_pk", F.posexplode_outer("g.plays").alias("play_index", "p")).where("p IS NOT NULL")
    inning = F.col("p.about.inning").try_cast("int").alias("inning")
    events = plays.select("game_pk", "play_index", inning, F.posexplode("p.events").alias("event_index", "e"))
    runners = plays.select("game_pk", "play_index", F.posexplode("p.runners").alias("runner_index", "r"))
    return {
        "plays": plays.select("game_pk", "play_index", inning, F.coalesce("p.about.half", F.lit("None")).alias("half")),
        "events": events.select("game_pk", "play_index", "inning", "event_index", F.coalesce("e.type", F.lit("None")).alias("type"), F.col("e.speed").try_cast("double").alias("speed")),
        "runners": runners.select("game_pk", "play_index", "runner_index", F.col("r.id").alias("runner_id")),
        "credits": runners.select("game_pk", "play_index", "runner_index", F.explode("r.credits").alias("credit")),
    }


def hourly(df: DataFrame, keys: Sequence[str], time: str, values: Sequence[str]) -> DataFrame:
    """Parallel arrays to rows."""
    return df.select(*keys, F.explode(F.arrays_zip(time, *values)).alias("z")).select(*keys, "z.*")


def daily_to_hourly(df: DataFrame, day: str, name: str = "hour") -> DataFrame:
    """Each day repeated for its 24 hours."""
    return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(23)))).withColumn(name, F.col(day).cast("timestamp") + F.make_interval(hours=name))


def members(df: DataFrame, columns: Sequence[str], name: str) -> DataFrame:
    """Mean and population deviation over ensemble member columns."""
    xs = F.filter(F.array(*columns), lambda x: x.isNotNull())
    n = F.size(xs)
    mean = F.try_divide(F.aggregate(xs, F.lit(0.0), lambda a, x: a + x), n.cast("double"))
    dev = F.sqrt(F.try_divide(F.aggregate(xs, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)), n.cast("double")))
    return df.withColumns({f"{name}_mean": mean, f"{name}_std": dev}).drop(*columns)
