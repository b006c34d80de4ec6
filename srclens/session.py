"""Session defaults and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_ROOTS: dict[str, str] = {}
_MADE: list[str] = []


def local_session(cpus: str = "8", app: str = "srclens") -> SparkSession:
    """Session for tests and the bench; on a cluster the caller brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus).replace("*", "8"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_root(spark: SparkSession) -> str:
    """Folder that every executor can reach, taken from ``spark.checkpoint.dir``.

    Only a local master without that setting gets a temporary folder; a cluster
    without it is an error, since a folder of one machine would not survive the
    loss of that machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_ROOTS:
        _LOCAL_ROOTS[app] = tempfile.mkdtemp(prefix="srclens-")
    return _LOCAL_ROOTS[app]


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder, never used before."""
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


def drop_written(spark: SparkSession) -> None:
    """Delete every table this process wrote under the shared folder; DataFrames that read one are dead then.

    Call it when the results of a session are stored.
    """
    to_path = spark._jvm.org.apache.hadoop.fs.Path
    while _MADE:
        path = to_path(_MADE.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write once, read back: later readers do not recompute the lineage."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
