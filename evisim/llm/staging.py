"""Written intermediate tables in the folder that all executors share, instead of lineage that grows."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders of this driver's sessions, each with what it has staged; they are deleted when the driver ends.
_folders: dict[str, tuple[SparkSession, str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only a local session without that setting gets a folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='evisim-')}")
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def run_dir(spark: SparkSession) -> str:
    """This application's own folder in the shared one."""
    key = f"{spark.sparkContext.applicationId}|{shared_dir(spark)}"
    if key not in _folders:
        _folders[key] = (spark, f"{shared_dir(spark)}/evisim-{uuid.uuid4().hex}")
    return _folders[key][1]


@atexit.register
def _clean() -> None:
    for spark, path in _folders.values():
        with contextlib.suppress(Exception):  # a session that has ended can't delete; the folder's owner may
            _delete(spark, path)


def new_path(spark: SparkSession, label: str) -> str:
    return f"{run_dir(spark)}/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """Writes df once to the shared folder and reads it back: later steps don't recompute it, and a lost executor costs a reread."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Deletes staged tables that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_staged_at", None)
        if path is not None:
            _delete(df.sparkSession, path)
