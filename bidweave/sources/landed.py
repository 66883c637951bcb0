"""Landed payloads to records: CSV, JSON pages, label-delimited text and simple HTML rows.

Network connectors are out of scope; each reader takes files or a table of payloads that a fetcher
has landed, and gives rows with a common core: external_id, title, agency, due_at, status, url.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dates import DATE_RULES
from ..functions.text import agency_name, squeezed, state_code, trimmed

NOT_OFFERED = ("Award Notice", "Sale of Surplus Property")


def read_csv(spark: SparkSession, path: str, required: Sequence[str] = ()) -> DataFrame:
    """A feed with a header, quotes and line ends inside quotes; all columns as text."""
    rows = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', mode="PERMISSIVE", encoding="UTF-8")
    rows = rows.toDF(*(c.lstrip("﻿") for c in rows.columns))
    missing = set(required) - set(rows.columns)
    if missing:
        raise ValueError(f"missing columns: {', '.join(sorted(missing))}")
    return rows


def federal_records(rows: DataFrame) -> DataFrame:
    """The federal feed's rows that can still be bid on."""
    kept = rows.where(trimmed(F.col("NoticeId")).isNotNull())
    kept = kept.where((F.lower(F.coalesce(trimmed(F.col("Active")), F.lit("yes"))) == "yes") & ~F.coalesce(F.col("Type").isin(*NOT_OFFERED), F.lit(False)))
    department = F.col("`Department/Ind.Agency`")
    return kept.select(
        F.trim("NoticeId").alias("external_id"),
        trimmed(F.col("Title")).alias("title"),
        agency_name(F.concat_ws(".", trimmed(department), trimmed(F.col("Sub-Tier")), trimmed(F.col("Office"))), F.col("Office"), F.col("Sub-Tier"), department).alias("agency"),
        F.to_utc_timestamp(F.try_to_timestamp(F.substring("ResponseDeadLine", 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss")), "UTC").alias("due_at"),
        state_code(F.col("PopState")).alias("state_code"),
        trimmed(F.col("NaicsCode")).alias("naics"),
        trimmed(F.col("SetASide")).alias("set_aside"),
    )


def page_keys(total: Column, size: int) -> Column:
    """Page numbers that cover ``total`` rows."""
    return F.when(total > 0, F.sequence(F.lit(0), (F.ceil(total / size) - 1).cast("int"))).otherwise(F.array().cast("array<int>"))


def json_records(payloads: DataFrame, item: str, schema: T.StructType, body: str = "body", keep: Sequence[str] = ()) -> DataFrame:
    """Items of the array ``item`` of JSON pages, one row each."""
    whole = T.StructType([T.StructField(item, T.ArrayType(schema))])
    parsed = payloads.select(*keep, F.from_json(body, whole).alias("_page"))
    return parsed.select(*keep, F.posexplode(f"_page.{item}").alias("position", "item")).select(*keep, "position", "item.*")


def bag_value(bag: str, name: str) -> Column:
    """Value of a named attribute in an array of (Name, Value) structs."""
    return F.get(F.filter(bag, lambda a: a["Name"] == name), F.lit(0))["Value"]


def dotnet_date(c: Column) -> Column:
    """``/Date(milliseconds)/``."""
    return F.timestamp_millis(F.nullif(F.regexp_extract(c, r"/Date\((-?\d+)", 1), F.lit("")).cast("long"))


def labelled(c: Column, label: str, following: Sequence[str]) -> Column:
    """Text after ``label`` up to the next of the ``following`` labels."""
    ends = "|".join([*following, "$"])
    return trimmed(squeezed(F.regexp_extract(c, rf"(?is){label}\s*:?\s*(.*?)\s*(?={ends})", 1)))


def label_chunks(payloads: DataFrame, first_label: str, body: str = "body", keep: Sequence[str] = ()) -> DataFrame:
    """Texts of label-delimited pages, one chunk for each ``first_label``."""
    return payloads.select(*keep, F.posexplode(F.split(body, first_label)).alias("position", "chunk")).where("position > 0")


def html_rows(payloads: DataFrame, body: str = "body", keep: Sequence[str] = ()) -> DataFrame:
    """Cells of table rows, tags dropped, with the first link of each row."""
    rows = F.regexp_extract_all(body, F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), F.lit(1))
    each = payloads.select(*keep, F.posexplode(rows).alias("position", "row"))
    cells = F.transform(F.regexp_extract_all("row", F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]>"), F.lit(1)), lambda c: squeezed(F.regexp_replace(c, "<[^>]+>", " ")))
    link = F.nullif(F.regexp_extract("row", r"""(?is)href=["']([^"']+)""", 1), F.lit(""))
    return each.select(*keep, "position", cells.alias("cells"), link.alias("href"))


def with_addenda(rows: DataFrame, page: str, bid: str = "bid_number", position: str = "position") -> DataFrame:
    """Rows without a bid number belong to the last bid above them; one row for each bid."""
    above = F.last(bid, ignorenulls=True).over(Window.partitionBy(page).orderBy(position).rowsBetween(Window.unboundedPreceding, 0))
    tied = rows.withColumn("_bid", above).where("_bid is not null")
    addenda = F.sort_array(F.collect_list(F.when(F.col(bid).isNull(), F.struct(position, "title"))))
    main = F.max(F.when(F.col(bid).isNotNull(), F.col("title")))
    return tied.groupBy(page, F.col("_bid").alias(bid)).agg(main.alias("title"), F.transform(addenda, lambda a: a["title"]).alias("addenda"))


def due(c: Column, source: str) -> Column:
    return DATE_RULES[source].read(c)
