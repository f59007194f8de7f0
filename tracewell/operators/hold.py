"""Intermediate tables of a query, written to the folder that driver and executors share.

A written table is read again by a plan of one scan: lineage and plans stay small however many steps a query has, lost executors cost nothing
that is done, and no heap is taken.  Tables belong to the query that was running; ``begin()`` starts a new one and deletes those of
queries before the last two, whose results may still be read.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

_KEPT = 2
#: Shuffle files go when the table that they were made for is written, not when the driver's garbage happens to be collected.
_CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_QUERIES: list[list[tuple[SparkSession, str | Broadcast]]] = [[]]


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where none is set, a temporary one in local mode, and an error on a cluster."""
    context = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or getattr(context, "_tracewell_shared", None)
    if not path:
        current = context._jsc.sc().getCheckpointDir()
        if current.isDefined():
            path = current.get()
        elif context.master.startswith("local") and "cluster" not in context.master:
            path = tempfile.mkdtemp(prefix="tracewell-")
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context._tracewell_shared = path
    return path


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def hold(df: DataFrame) -> DataFrame:
    """The rows of df, computed now and read from a table.  What is read once should not be held."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/held-{uuid.uuid4().hex}"
    _QUERIES[-1].append((spark, path))
    before = spark.conf.get(_CLEANED, None)
    spark.conf.set(_CLEANED, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(_CLEANED) if before is None else spark.conf.set(_CLEANED, before)
    held = spark.read.schema(df.schema).parquet(path)
    held._held = path
    return held


def release(*tables: DataFrame) -> None:
    """Deletes tables that hold() returned and nothing reads any more."""
    for df in tables:
        entry = (df.sparkSession, df._held)
        for query in _QUERIES:
            if entry in query:
                query.remove(entry)
        remove(*entry)


def share(spark: SparkSession, value: object) -> Broadcast:
    """A broadcast value of the running query; what is read after its release is sent anew."""
    sent = spark.sparkContext.broadcast(value)
    _QUERIES[-1].append((spark, sent))
    return sent


def begin(kept: int = _KEPT) -> None:
    """A new query begins: of earlier ones only the last are kept."""
    while len(_QUERIES) > kept:
        for spark, what in _QUERIES.pop(0):
            if spark.sparkContext._jsc is None:  # stopped since
                continue
            if isinstance(what, Broadcast):
                what.unpersist()
            else:
                remove(spark, what)
    _QUERIES.append([])
