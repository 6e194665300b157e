"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, tag: str) -> str:
    """A fresh path under spark.checkpoint.dir; under a local folder only where a local session names none (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = f"file://{tempfile.mkdtemp(prefix='placeflow-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return f"{path.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def spread(df: DataFrame, *by: str) -> DataFrame:
    """Dealt by columns to some tasks for each core, ahead of costly work on narrow rows: a file of few bytes or row groups
    is read by few tasks, and adaptive execution would join small partitions again."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, *by)


def kept(df: DataFrame, path: str) -> DataFrame:
    """Written and read back: cuts lineage and survives lost executors."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
