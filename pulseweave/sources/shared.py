"""Paths and tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession) -> str:
    """A new path under spark.checkpoint.dir; a temporary one in a local session without that setting."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{(root or 'file://' + tempfile.mkdtemp()).rstrip('/')}/events-{uuid.uuid4().hex}"


@contextmanager
def settled(df: DataFrame) -> Iterator[DataFrame]:
    """The rows written once and read from there, so that several questions do not work them out again; deleted at the end."""
    spark, path = df.sparkSession, shared_path(df.sparkSession)
    df.write.parquet(path)
    try:
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
