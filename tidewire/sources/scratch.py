"""A folder for tables that queries write and read again: the cluster's shared one, else (on one machine) a temporary one."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """This application's folder. Without ``spark.checkpoint.dir`` executors elsewhere couldn't read it, so that only a
    local master may do without."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: executors share no folder")
        at = "file://" + tempfile.mkdtemp(prefix="tidewire-")
    return f"{at.rstrip('/')}/tidewire/{spark.sparkContext.applicationId}"


def scratch(spark: SparkSession, name: str) -> str:
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, rows_per_file: int = 0) -> DataFrame:
    """``df`` written to the folder and read back: what is random or numbered in it is fixed from then on, whatever
    executors are lost. ``rows_per_file``: at most so many (0: any number)."""
    spark = df.sparkSession
    at = scratch(spark, name)
    df.write.option("maxRecordsPerFile", rows_per_file).parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def store_of(path: str):
    """(file system, path in it), for reading outside Spark's own readers."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)
