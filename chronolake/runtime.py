"""Session helpers: table access, and lineage cuts that survive lost executors."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_LOCAL_DIRS: dict[str, str] = {}
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python, once an application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    top = Path(__file__).resolve().parent
    if top.is_dir():
        to = Path(tempfile.mkdtemp(prefix="chronolake-code-")) / "chronolake_code.zip"
        with zipfile.ZipFile(to, "w") as z:
            for f in sorted(top.rglob("*.py")):
                z.write(f, f.relative_to(top.parent))
        spark.sparkContext.addPyFile(str(to))
    _SHIPPED.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` below ``sf_dir``; any path that Spark can read."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    ``spark.checkpoint.dir`` of the session; where it is unset, a folder below the
    warehouse on a cluster and a temporary folder in local mode (tests).
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_DIRS:
        if spark.sparkContext.master.startswith("local-cluster") or not spark.sparkContext.master.startswith("local"):
            _LOCAL_DIRS[app] = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_chronolake"
        else:
            _LOCAL_DIRS[app] = "file://" + tempfile.mkdtemp(prefix="chronolake-")
    return _LOCAL_DIRS[app]


def materialize(df: DataFrame, tag: str = "t") -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: cuts lineage, computes once.

    The files outlive lost executors; remove them with :func:`drop_materialized`.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_materialized(df: DataFrame) -> None:
    """Deletes the files behind a frame that :func:`materialize` returned."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if folder.startswith(shared_dir(spark).replace("file://", "file:")) or folder.startswith(shared_dir(spark)):
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def width(spark: SparkSession) -> int:
    """Number of shuffle partitions that the session asks for."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
