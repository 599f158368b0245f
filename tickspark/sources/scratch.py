"""A folder for tables that are written and read again, where every executor sees it."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[object, str]] = []


def checkpoint_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only where that is unset and everything runs in one process, as in tests."""
    sc = spark.sparkContext
    have = sc._jsc.sc().getCheckpointDir()
    if have.isDefined():
        return have.get()
    own = spark.conf.get("spark.checkpoint.dir", None)
    if own is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        own = tempfile.mkdtemp(prefix="checkpoint")
    sc.setCheckpointDir(own)
    return sc._jsc.sc().getCheckpointDir().get()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it is deleted when the driver's Python ends."""
    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_clear)
    _made.append((spark, path))
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written once in the shared folder: what is read several times is computed once."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _clear() -> None:
    for spark, path in _made:
        try:
            remove(spark, path)
        except Exception:  # the JVM may be gone already; the folder is the session's own
            return
