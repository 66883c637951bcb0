"""Keyed snapshots: classification by hash, field changes, merge, closing, and distinct rules.

A snapshot is compared with the stored records by one join on the key. Tables are rewritten, since
no merging table format is at hand; the caller writes the result as a new version.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def one_for_each_key(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in ``order``."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def last_wins(rows: DataFrame, keys: list[str], position: str) -> DataFrame:
    """The last row of each key, at the position of its first."""
    latest = rows.groupBy(*keys).agg(F.max_by(F.struct("*"), position).alias("row"), F.min(position).alias("first_position"))
    return latest.select("row.*", "first_position")


def first_wins(rows: DataFrame, keys: list[str], position: str) -> DataFrame:
    return one_for_each_key(rows, keys, F.asc(position))


def most_certain_wins(rows: DataFrame, keys: list[str], confidence: str, position: str) -> DataFrame:
    """The first of the rows of greatest confidence of each key."""
    return one_for_each_key(rows, keys, F.desc(confidence), F.asc(position))


def classify(stored: DataFrame, incoming: DataFrame, key: str = "id", digest: str = "content_hash") -> DataFrame:
    """``key`` and ``change``: new, changed, unchanged, or absent from the snapshot."""
    a = stored.select(F.col(key), F.col(digest).alias("old_hash"), F.lit(True).alias("was"))
    b = incoming.select(F.col(key), F.col(digest).alias("new_hash"), F.lit(True).alias("comes"))
    both = a.join(b, key, "full")
    change = (  # a digest may be null, so the sides tell what is absent
        F.when(F.col("was").isNull(), "new").when(F.col("comes").isNull(), "absent")
        .when(~F.col("old_hash").eqNullSafe(F.col("new_hash")), "changed").otherwise("unchanged")
    )
    return both.select(key, change.alias("change"))


def field_changes(stored: DataFrame, incoming: DataFrame, fields: list[str], key: str = "id") -> DataFrame:
    """Changed records with the names of their changed fields; none named if only other fields differ."""
    old = stored.select(key, F.struct(*fields).alias("before"), F.col("content_hash").alias("old_hash"))
    new = incoming.select(key, F.struct(*fields).alias("after"), F.col("content_hash").alias("new_hash"))
    joined = old.join(new, key).where("old_hash <> new_hash")
    differing = F.array_compact(F.array(*(F.when(~F.col(f"before.{f}").eqNullSafe(F.col(f"after.{f}")), f) for f in fields)))
    summary = F.when(F.size(differing) == 0, "record changed").otherwise(F.concat(F.lit("changed: "), F.array_join(differing, ", ")))
    return joined.select(key, F.array_join(differing, ",").alias("fields"), summary.alias("summary"))


def carried_forward(incoming: DataFrame, stored: DataFrame, column: str, key: str = "id") -> DataFrame:
    """Empty lists of the snapshot keep the stored ones."""
    old = stored.select(key, F.col(column).alias("_old"))
    kept = F.when(F.coalesce(F.size(column), F.lit(0)) <= 0, F.coalesce("_old", F.col(column))).otherwise(F.col(column))
    return incoming.join(old, key, "left").withColumn(column, kept).drop("_old")


def merge(stored: DataFrame, incoming: DataFrame, seen_at: Column, close_missing: bool = False, key: str = "id") -> DataFrame:
    """The next version: incoming rows replace stored ones but keep ``first_seen_at``; with
    ``close_missing`` (only after a complete sweep) open records that are absent are closed."""
    first = stored.select(key, F.col("first_seen_at").alias("_first"))
    fresh = incoming.join(first, key, "left").withColumns({"first_seen_at": F.coalesce("_first", seen_at), "last_seen_at": seen_at}).drop("_first")
    rest = stored.join(incoming.select(key), key, "left_anti")
    if close_missing:
        rest = rest.withColumn("status", F.when(F.col("status") == "open", "closed").otherwise(F.col("status")))
    return fresh.unionByName(rest.select(fresh.columns))


def close_stale(records: DataFrame, start: Column) -> DataFrame:
    """Open records that were not seen since ``start`` are closed."""
    return records.withColumn("status", F.when((F.col("status") == "open") & (F.col("last_seen_at") < start), "closed").otherwise(F.col("status")))


def merge_people(stored: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """New values where there are any, old ones elsewhere; the greater confidence."""
    old = stored.select(*keys, *(F.col(c).alias(f"old_{c}") for c in ("email", "phone", "confidence")))
    both = old.join(incoming, keys, "full")
    return both.select(*keys, F.coalesce("email", "old_email").alias("email"), F.coalesce("phone", "old_phone").alias("phone"), F.greatest("confidence", "old_confidence").alias("confidence"))


def reconcile_names(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Names of a list against stored agencies: updates where a stored name is unique, else inserts."""
    unique = stored.groupBy(F.lower("agency").alias("_name")).agg(F.count("*").alias("_n"), F.min("agency_id").alias("_agency"))
    joined = incoming.join(unique, F.lower(incoming["name"]) == F.col("_name"), "left")
    action = F.when(F.col("_n").isNull(), "insert").when(F.col("_n") == 1, "update").otherwise("ambiguous")
    return joined.select("name", action.alias("action"), F.when(F.col("_n") == 1, F.col("_agency")).alias("agency_id"))


def run_log(changes: DataFrame) -> DataFrame:
    kinds = ("new", "changed", "unchanged", "absent")
    return changes.agg(*(F.count_if(F.col("change") == k).alias(f"{k}_records") for k in kinds))


def is_complete(reported: Column, *counts: Column) -> Column:
    """All counts of a sweep agree with the number that its source reports."""
    return reduce(Column.__and__, [c == reported for c in counts])
