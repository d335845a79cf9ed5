"""Session, table access and lineage cuts."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: dict[str, SparkSession] = {}


def session(cores: str | int = "*", memory: str = "8g", partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]").appName("parcelforge")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: what spark.checkpoint.dir names. Where it is unset, a local session, which is one
    machine, gets a temporary folder, and a cluster an error."""
    app = spark.sparkContext.applicationId
    known = next((f for f in _made if f.endswith(f"/parcelforge-{app}")), None)
    if known:
        return known
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        local = spark.sparkContext.master.split("[")[0] == "local"
        if not local:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="parcelforge-")
    folder = f"{base.rstrip('/')}/parcelforge-{app}"
    _made[folder] = spark
    atexit.register(_remove, folder)
    return folder


def _remove(path: str) -> None:
    spark = next((s for f, s in _made.items() if path.startswith(f)), None)
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has ended; a local folder can still go
        if path.startswith("file:"):
            import shutil

            shutil.rmtree(path.removeprefix("file://").removeprefix("file:"), ignore_errors=True)


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write df into the shared folder and read it back: the lineage ends there, and a lost executor costs nothing.

    The caller may drop() the table once nothing reads it; what is left goes when the driver exits.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def spread(df: DataFrame) -> DataFrame:
    """df in at least as many partitions as there are cores, for work that costs far more than moving its rows; left as it is if it has them."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def drop(df: DataFrame | None) -> None:
    """Remove the files behind a table that cut() made."""
    if df is not None and getattr(df, "_cut_path", None):
        _remove(df._cut_path)


def repo_root() -> str:
    return os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
