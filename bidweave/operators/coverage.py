"""Source coverage by state, and agency activity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def source_counts(sources: DataFrame, opportunities: DataFrame) -> DataFrame:
    """Records of every source, sources without any included."""
    counts = opportunities.groupBy("source_id").agg(F.count("*").alias("records"), F.count_if(F.col("status") == "open").alias("open_records"), F.max("due_at").alias("last_due"))
    joined = sources.join(counts, "source_id", "left")
    return joined.select("source_id", "source_family", "adapter_key", "registry_state", F.coalesce("records", F.lit(0)).alias("records"), F.coalesce("open_records", F.lit(0)).alias("open_records"), "last_due")


def effective_status(registry: Column, open_records: Column) -> Column:
    return (
        F.when(registry == "blocked", "blocked")
        .when((open_records > 0) & (registry == "live"), "live")
        .when((open_records > 0) | (registry == "partial"), "partial")
        .otherwise("queued")
    )


# Sources whose key does not end in their state's code, and the families that count for states.
STATE_OF_SOURCE = {"indiana_idoa": "in", "tennessee_cpo_public": "tn"}
STATE_FAMILIES = ("periscope_", "jaggaer_", "peoplesoft_")


def source_state(adapter: Column) -> Column:
    """Lower-case code of the state that a source belongs to: what follows its key's last underline, or one of two exceptions."""
    named = F.create_map(*(F.lit(x) for pair in STATE_OF_SOURCE.items() for x in pair))
    return F.coalesce(named[adapter], F.when(adapter.contains("_"), F.element_at(F.split(adapter, "_"), -1)))


def is_state_source(adapter: Column, family: Column) -> Column:
    """Whether a source counts for the coverage of states."""
    named = adapter.isin(*STATE_OF_SOURCE)
    for start in STATE_FAMILIES:
        named = named | adapter.like(f"{start.rstrip('_')}_%")  # the underline stands for any one character
    return (family == "sled") | named


def state_coverage(registry: DataFrame, counted: DataFrame) -> DataFrame:
    """Each registry state with the sources whose adapter key ends in its code."""
    keyed = counted.withColumn("of_state", source_state(F.col("adapter_key")))  # the suffix rule as an equi-join
    joined = registry.join(keyed, F.lower(registry["state"]) == keyed["of_state"], "left")
    rolled = joined.groupBy("state", "registry_status").agg(
        F.count("source_id").alias("sources"),
        F.coalesce(F.sum("open_records"), F.lit(0)).alias("open_records"),
        F.max("last_due").alias("last_due"),
    )
    return rolled.withColumn("effective_status", effective_status(F.col("registry_status"), F.col("open_records")))


def coverage_summary(states: DataFrame) -> DataFrame:
    counts = {s: F.count_if(F.col("effective_status") == s).alias(s) for s in ("live", "partial", "blocked", "queued")}
    return states.agg(*counts.values(), F.sum("open_records").alias("open_records"))


def discovery_by_source(records: DataFrame) -> DataFrame:
    """What a document scan found, by source; ``records`` carry their document state."""
    return records.groupBy("adapter_key").agg(
        F.count("*").alias("scanned"), F.count_if(F.col("identified") > 0).alias("with_documents"), F.coalesce(F.sum("identified"), F.lit(0)).alias("documents")
    )


def agency_activity(agencies: DataFrame, opportunities: DataFrame, limit: int = 100) -> DataFrame:
    counts = opportunities.groupBy("agency_id").agg(F.count_if(F.col("status") == "open").alias("open_count"), F.count("*").alias("total_count"), F.max("due_at").alias("last_due"))
    joined = agencies.join(counts, "agency_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("open_count", "total_count")})
    return joined.orderBy(F.desc("open_count"), "agency", "agency_id").limit(limit)


def agencies_by_people(agencies: DataFrame, opportunities: DataFrame, people: DataFrame, as_of: Column, limit: int = 100) -> DataFrame:
    """Agencies with most known people first, then those with most records that can still be bid on, then by name."""
    known = people.groupBy("agency_id").agg(F.count("*").alias("people"))
    live = F.count_if((F.col("status") == "open") & (F.col("due_at").isNull() | (F.col("due_at") >= as_of)))
    counts = opportunities.groupBy("agency_id").agg(live.alias("open_count"), F.count("*").alias("total_count"))
    joined = agencies.join(known, "agency_id", "left").join(counts, "agency_id", "left")
    joined = joined.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("people", "open_count", "total_count")})
    return joined.orderBy(F.desc("people"), F.desc("open_count"), "agency", "agency_id").limit(limit)


def top_people(people: DataFrame, k: int = 6) -> DataFrame:
    """The ``k`` most certain people of each agency, in order."""
    rank = F.row_number().over(Window.partitionBy("agency_id").orderBy(F.desc("confidence"), "full_name", "person_id"))
    return people.withColumn("rank", rank).where(F.col("rank") <= k)


def people_json(people: DataFrame, k: int = 6) -> DataFrame:
    """The same as one ordered JSON array for each agency."""
    top = top_people(people, k).groupBy("agency_id").agg(F.sort_array(F.collect_list(F.struct("rank", "full_name", "title", "confidence"))).alias("people"))
    return top.select("agency_id", F.to_json("people").alias("people"))


def vertical_totals(agencies: DataFrame, people: DataFrame) -> DataFrame:
    have = people.select("agency_id").distinct().withColumn("enriched", F.lit(True))
    flagged = agencies.join(have, "agency_id", "left")
    return flagged.groupBy("agency_type").agg(
        F.count("*").alias("total"), F.count("website").alias("with_website"), F.count("enriched").alias("enriched")
    )
