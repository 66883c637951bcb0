"""Sources registered before a sync, marked after it, and which listed portals and projects count."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import stable_uuid

#: What an unstated place and kind stand for.
PLACE, KIND = "United States", "portal"

TAKEN = ("source_name", "base_url", "jurisdiction", "source_type")


def _or(c: Column, other: str) -> Column:
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(other))


def registered(stored: DataFrame, incoming: DataFrame, as_of: datetime) -> DataFrame:
    """A new version of the sources: of a known key the oldest row takes the stated values and becomes
    active, an unknown key gives a row of its own whose id follows from the key.

    One full join on the id serves both, since a new key's id may be taken already. Of rows of
    ``incoming`` with one key the greatest counts; rows without a key are no sources.
    """
    oldest = stored.groupBy("adapter_key").agg(F.min(F.struct("created_at", "id")).alias("o")).select("adapter_key", F.col("o.id").alias("id"))
    stated = incoming.where("adapter_key is not null").groupBy("adapter_key").agg(F.max(F.struct(*TAKEN)).alias("s"))
    keyed = stated.join(oldest, "adapter_key", "left").select(F.coalesce("id", stable_uuid(F.col("adapter_key"))).alias("id"), F.col("id").isNull().alias("by_key"), F.col("adapter_key").alias("new_key"), "s")
    both = stored.withColumn("held", F.lit(True)).join(keyed, "id", "full")
    told, new = F.col("new_key").isNotNull(), F.col("held").isNull()
    values = {"jurisdiction": _or(F.col("s.jurisdiction"), PLACE), "source_type": _or(F.col("s.source_type"), KIND), "source_name": F.col("s.source_name"), "base_url": F.col("s.base_url")}
    return both.select(
        "id", F.when(told & F.col("by_key"), F.col("new_key")).otherwise(F.col("adapter_key")).alias("adapter_key"),
        *(F.when(told, v).otherwise(F.col(n)).alias(n) for n, v in values.items()),
        (told | F.coalesce("active", F.lit(False))).alias("active"),
        F.when(new, 100).otherwise(F.col("health_score")).alias("health_score"),
        F.when(new, F.lit(as_of)).otherwise(F.col("last_success_at")).alias("last_success_at"),
        F.when(new, F.lit(as_of)).otherwise(F.col("created_at")).alias("created_at"),
    )


def after_sync(stored: DataFrame, synced: DataFrame, as_of: datetime) -> DataFrame:
    """Sources with the success of those whose ``id`` is in ``synced``: full health, no error."""
    done = F.col("done").isNotNull()
    marked = stored.join(synced.select("id", F.lit(True).alias("done")).distinct(), "id", "left")
    fresh = {"health_score": F.lit(100), "last_success_at": F.lit(as_of), "last_error": F.lit(None)}
    return marked.select(*(F.when(done, fresh[c]).otherwise(F.col(c)).alias(c) if c in fresh else F.col(c) for c in stored.columns))


def usable_projects(projects: DataFrame) -> DataFrame:
    """Projects with an id and a title that are no drafts, libraries, templates or intakes."""
    unset = [~F.coalesce(F.col(c), F.lit(False)) for c in ("isPrivate", "isLibrary", "isTemplate", "isIntake")]
    stated = (F.coalesce("id", F.lit(0)) != 0) & (F.regexp_replace(F.coalesce("title", F.lit("")), r"^\s+|\s+$", "") != "")
    return projects.where(stated & unset[0] & unset[1] & unset[2] & unset[3])


def directory_entries(entries: DataFrame) -> DataFrame:
    """Entries of the directory that are governments of the United States and not switched off."""
    active, vendor = F.coalesce("isActive", F.lit(True)), F.coalesce("isVendor", F.lit(False))
    return entries.where(active & ~vendor & (F.col("countryCode") == "US") & (F.coalesce("government.code", F.lit("")) != ""))
