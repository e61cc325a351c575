"""Written tables in the folder that all executors share: iterations cut their lineage with them."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders of this driver's sessions; they are deleted when it ends.
_folders: dict[str, tuple[SparkSession, str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """This application's folder in that of spark.checkpoint.dir; a local session without the setting gets one of its own."""
    sc = spark.sparkContext
    if sc.applicationId not in _folders:
        base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
        if not base:
            if not (sc.master == "local" or sc.master.startswith("local[")):
                raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
            base = f"file://{tempfile.mkdtemp(prefix='evisim-')}"
        _folders[sc.applicationId] = (spark, f"{base.rstrip('/')}/evisim-{uuid.uuid4().hex}")
    return _folders[sc.applicationId][1]


def written(df: DataFrame) -> DataFrame:
    """df, written once and read back. A checkpoint would keep its plan's estimate of size, which a loop multiplies without end."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@atexit.register
def _clean() -> None:
    for spark, path in _folders.values():
        with contextlib.suppress(Exception):  # a session that has ended can't delete
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
