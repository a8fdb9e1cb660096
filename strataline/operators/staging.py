"""Cutting lineage between the levels of an iterative plan."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one where a local session has none, as in tests."""
    have = spark.conf.get("spark.checkpoint.dir", None)
    if not have:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        have = getattr(spark, "_level_folder", None) or tempfile.mkdtemp(prefix="levels-")
        spark._level_folder = have
    return have.rstrip("/")


def settle(df: DataFrame, name: str = "level") -> DataFrame:
    """df written as Parquet in the shared folder and read again."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def bounded_batches(spark: SparkSession, most: str = "4m") -> Iterator[None]:
    """Arrow batches of the plans run inside are bounded in bytes, unless the session has its own bound: rows may be long."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    own = spark._jsparkSession.sessionState().conf().settings().get(key)
    if own is None:
        spark.conf.set(key, most)
    try:
        yield
    finally:
        if own is None:
            spark.conf.unset(key)
