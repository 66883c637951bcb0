"""Substring search with live wildcards over a table of 3-grams.

Every text is taken apart into its distinct 3-grams once; the postings (gram, field, key) are kept by a hash of the gram, so a
search reads the folders of its own grams alone. What a pattern holds between its wildcards gives the grams that a
match must have: candidates are the keys that have all of them in one field, and LIKE decides. A pattern without
three letters in a row has no gram, so for it the records are read as they are.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SIZE = 3
BUCKETS = 64
POSTING = "gram string, field string, key long, bucket int"


def grams_of(text: Column) -> Column:
    """Distinct 3-grams of a text in lower case; none of a shorter one."""
    low = F.lower(text)
    starts = F.when(F.length(low) >= SIZE, F.sequence(F.lit(1), F.length(low) - SIZE + 1))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(low, i, F.lit(SIZE))))


def bucket_of(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


def write(records: DataFrame, fields: list[str], path: str, key: str = "id") -> None:
    """The postings of ``fields``, as Parquet by bucket, sorted so that a gram stands in few row groups.

    Postings are dealt by bucket, and a bucket of more than a task's worth to several: the sort of a task does not grow with the records.
    """
    texts = records.select(F.col(key).cast("long").alias("key"), F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields))).alias("t"))
    rows = texts.select(F.explode(grams_of(F.col("t.text"))).alias("gram"), "t.field", "key").withColumn("bucket", bucket_of(F.col("gram")))
    rows.hint("rebalance", F.col("bucket")).sortWithinPartitions("bucket", "gram").write.partitionBy("bucket").parquet(path)


def grams_of_pattern(pattern: str) -> list[str]:
    """3-grams that every match of ``pattern`` holds: those of what stands between its wildcards; a backslash takes the next sign as it is."""
    runs, run, at = [], "", 0
    while at < len(pattern):
        sign = pattern[at]
        if sign == "\\" and at + 1 < len(pattern):
            at += 1
            run += pattern[at]
        elif sign in "%_":
            runs.append(run)
            run = ""
        else:
            run += sign
        at += 1
    low = [r.lower() for r in [*runs, run]]
    return sorted({r[i : i + SIZE] for r in low for i in range(len(r) - SIZE + 1)})


def candidates(spark: SparkSession, path: str, pattern: str) -> DataFrame | None:
    """``key`` of the records that can match, or nothing where the pattern has no gram."""
    wanted = grams_of_pattern(pattern)
    if not wanted:
        return None
    buckets = [r[0] for r in spark.createDataFrame([(g,) for g in wanted], "gram string").select(bucket_of(F.col("gram"))).distinct().collect()]
    found = spark.read.schema(POSTING).parquet(path).where(F.col("bucket").isin(*buckets) & F.col("gram").isin(*wanted))
    return found.groupBy("key", "field").agg(F.count_distinct("gram").alias("n")).where(F.col("n") == len(wanted)).select("key").distinct()


def search(records: DataFrame, fields: list[str], path: str, text: str, key: str = "id") -> DataFrame:
    """The records one of whose ``fields`` holds ``text``, in any letters' case; its % and _ are wildcards."""
    pattern = f"%{re.sub(r'(?<!\\)\\$', r'\\\\', text)}%"
    able = candidates(records.sparkSession, path, pattern)
    rows = records if able is None else records.join(able.withColumnRenamed("key", key), key, "left_semi")
    match = F.lit(False)
    for field in fields:
        match = match | F.coalesce(F.col(field).ilike(pattern), F.lit(False))
    return rows.where(match)
