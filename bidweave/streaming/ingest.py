"""Incremental ingestion: landed JSON lines are merged into a bucketed table, batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import content_hash
from ..operators.cdc import last_wins
from ..operators.changes import next_rows
from .buckets import BUCKETS, BucketedTable


def read_version(spark: SparkSession, table: str, version: int, key: str = "id") -> DataFrame:
    return BucketedTable(spark, table, [key]).current(version)


def merge_into(table: str, key: str = "id", position: str = "position", watched: tuple[str, ...] = ("title", "status"), buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """A batch writer: batch n makes the next version, in which only the buckets of its keys are new; a repeated
    batch changes nothing. Of a key's rows the last counts, and its change is noted beside the version."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = last_wins(batch, [key], position).drop("first_position")
        told = [c for c in rows.columns if c not in (key, position, "seen_at")]
        rows = rows.withColumn("content_hash", content_hash(*told))
        seen = [T.StructField(f"{n}_seen_at", T.TimestampType()) for n in ("first", "last")]
        own = BucketedTable(spark, table, [key], T.StructType([*rows.schema.fields, *seen]), buckets)
        step = lambda stored, incoming, closing: next_rows(stored, incoming, closing, [key], list(watched), F.col("new.seen_at"), F.lit("feed"))
        own.apply(f"batch-{number}", rows, rows.select(key).where("false"), step)

    return write


def start(spark: SparkSession, folder: str, schema: str, table: str, checkpoint: str, files_at_once: int = 100) -> StreamingQuery:
    """Merge all landed files, then stop (a scheduled run starts it again)."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).json(folder)
    return stream.writeStream.foreachBatch(merge_into(table)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
