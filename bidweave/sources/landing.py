"""Landed pages as files: what a fetcher has brought in, one folder for each source.

A page is a row (source, page, reported, body). The folder lies where the session's executors all
reach it; a plan that reads one portal opens that portal's folder alone, and only the columns it names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no shared folder (tests, local runs).
LOCAL_DEFAULT = "/tmp/checkpoints"
PAGE = "page int, reported long, body string, source string"


def folder(spark: SparkSession, label: str) -> str:
    """A new folder's place, in the shared folder that the session names; LOCAL_DEFAULT where it names none."""
    base = spark.conf.get("spark.checkpoint.dir", "") or LOCAL_DEFAULT
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def drop_at_end(spark: SparkSession, path: str) -> None:
    """Have a folder deleted when the driver ends."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)


def land(pages: DataFrame, path: str) -> DataFrame:
    """Write pages to ``path`` and return them as they are read from there."""
    spark = pages.sparkSession
    pages.select("page", "reported", "body", "source").write.mode("append").partitionBy("source").parquet(path)
    return landed(spark, path)


def landed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PAGE).parquet(path)
