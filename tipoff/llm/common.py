"""Shared helpers: lineage cuts in the cluster's shared folder, and table access."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset (local tests), a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        found = f"file://{tempfile.mkdtemp(prefix='tipoff-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write a result to the shared folder and read it back: later reads survive lost
    executors, cost no recomputation and prune columns."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tipoff/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 1000, size: str = "4m") -> None:
    """Whole texts go to Python a thousand rows and 4 MB at a time, unless the session sets
    rows itself: at the defaults, long texts fill an executor's memory.

    Tracebacks stay whole: some kinds of Python nodes ask for short ones and some don't, and
    Spark keeps a pool of workers (and their daemon) for each, idle ones for a minute."""
    spark.conf.set("spark.sql.execution.pyspark.udf.simplifiedTraceback.enabled", "false")
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) == 10_000:
        spark.conf.set(key, rows)
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


_KEPT: dict = {}


def kept(group: str, key, make):
    """Tables that a worker process keeps between tasks, made once. It keeps those of one
    operator at a time: when another one's task comes, the former's go."""
    if _KEPT.get("group") != group:
        _KEPT.clear()
        _KEPT["group"] = group
    if key not in _KEPT:
        _KEPT[key] = make()
    return _KEPT[key]


def tidy(group: str | None = None) -> None:
    """Gives memory that a worker has freed back to the system: workers live on between
    tasks, and several share an executor's limit. With `group`, other operators' tables go."""
    if group is not None and _KEPT.get("group") != group:
        _KEPT.clear()
        _KEPT["group"] = group
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries lack it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
