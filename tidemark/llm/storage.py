"""Intermediate tables in the folder that driver and executors share.

``spark.checkpoint.dir`` names it. Writing a table there cuts the lineage and
survives the loss of executors, because every executor can read it again. The
shuffle files of the step that wrote it are no longer needed then and go at once,
and the tables between a job's steps go with the end of the job (``settled``), so
that the disk holds one step of a job and not all of them.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.session import shared_folder

#: Spark's setting to delete the shuffle files of an execution when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class _Jobs(threading.local):
    """The tables that the open ``settled`` calls of a thread have written, innermost last."""

    def __init__(self):
        self.tables: list[list[DataFrame]] = []


_jobs = _Jobs()


def place(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/tidemark/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` to the shared folder and return a DataFrame that reads it back."""
    spark = df.sparkSession
    at = place(spark, name)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", compression).parquet(at)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(at)
    out._tidemark_path = at  # for discard()
    if _jobs.tables:
        _jobs.tables[-1].append(out)
    return out


def settled(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """Write the result of ``make`` and delete all tables that ``materialise`` wrote on the way, also if it fails."""
    mine: list[DataFrame] = []
    _jobs.tables.append(mine)
    try:
        out = materialise(make(), name)
        mine.pop()
    finally:
        _jobs.tables.pop()
        for table in mine:
            discard(table)
    if _jobs.tables:
        _jobs.tables[-1].append(out)
    return out


def discard(df: DataFrame) -> None:
    """Delete a table that ``materialise`` wrote and that nothing reads any more."""
    spark = df.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(df._tidemark_path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
