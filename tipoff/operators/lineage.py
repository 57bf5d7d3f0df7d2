"""Lineage cuts in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one where it is unset, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        base = f"file://{tempfile.mkdtemp(prefix='tipoff-')}"
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/tipoff"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: writes to the shared folder and reads back."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
