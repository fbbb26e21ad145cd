"""Intermediate tables in the folder that all executors share.

``spark.checkpoint.dir`` names that folder on a cluster.  Tables are Parquet, so a
lost executor costs a re-read and never the work that led to the table.  What no
plan reads any more is deleted where that is known; tables behind a DataFrame that
was returned stay until clear() is called, or the folder is emptied.
"""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder, from the session's settings.

    Only a session that runs all tasks in its own process (local[n]) gets a
    temporary folder if nothing is set; on a cluster that is an error.
    """
    sc = spark.sparkContext
    found = sc.getConf().get(_KEY) or spark.conf.get(_KEY, None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError(f"{_KEY} has to name a folder that the driver and all executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="tidewire-"))
        found = sc.getCheckpointDir()
    return found.rstrip("/")


def _own(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tidewire/{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{_own(spark)}/{uuid.uuid4().hex}/{name}"


def stage(df: DataFrame, name: str, done: Iterable[DataFrame] = ()) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there.  Staged tables in ``done`` are then deleted."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tidewire_path = path
    for old in done:
        discard(old)
    return out


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def discard(df: DataFrame) -> None:
    """Delete a staged table that nothing will read again."""
    if path := getattr(df, "_tidewire_path", None):
        _delete(df.sparkSession, path)


def clear(spark: SparkSession) -> None:
    """Delete all staged tables and archives of this application; DataFrames that read them are dead then."""
    _delete(spark, _own(spark))


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished steps, which it does some time after their plans are collected."""
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.5)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
