"""Current inventory: lists, search, counts and document state.

Dimensions are joined as they are; Spark broadcasts the ones that are small. Documents are
aggregated before they are joined, so the join never multiplies records.
"""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import listing_confidence, next_step, package_state
from ..functions.text import location

ANALYZED = ("complete", "extracted", "analyzed")
STATES = ("identified", "fetched", "analyzed", "missing")


def is_current(as_of: datetime) -> Column:
    return (F.col("status") == "open") & (F.col("due_at").isNull() | (F.col("due_at") >= F.lit(as_of)))


def of_family(family: str) -> Column:
    return F.lit(True) if family == "all" else F.col("source_family") == family


def document_state(documents: DataFrame) -> DataFrame:
    """Counts of a record's documents by state."""
    return documents.groupBy("opportunity_id").agg(
        F.count("*").alias("identified"),
        F.count("fetched_at").alias("fetched"),
        F.count_if(F.col("extraction_status").isin(*ANALYZED)).alias("analyzed"),
        F.count_if("is_missing").alias("missing"),
    )


def with_document_state(records: DataFrame, documents: DataFrame) -> DataFrame:
    state = document_state(documents)
    joined = records.join(state, records["id"] == state["opportunity_id"], "left").drop("opportunity_id")
    return joined.withColumns({c: F.coalesce(c, F.lit(0)) for c in STATES})


def current(opportunities: DataFrame, agencies: DataFrame, sources: DataFrame, as_of: datetime, family: str = "all") -> DataFrame:
    """Open, unexpired records with their agency and source."""
    records = opportunities.where(is_current(as_of))
    return records.join(agencies, "agency_id").join(sources, "source_id").where(of_family(family))


def by_due_date(records: DataFrame, limit: int) -> DataFrame:
    return records.orderBy(F.asc_nulls_last("due_at"), "id").limit(max(1, min(limit, 500)))


def listing(records: DataFrame, documents: DataFrame, limit: int = 50) -> DataFrame:
    """The next records to fall due, with confidence and package state."""
    whole = with_document_state(by_due_date(records, limit), documents)
    return whole.select(
        "id", "agency", "title", "due_at", "estimated_value", *STATES,
        location(F.col("city"), F.col("state_code")).alias("location"),
        listing_confidence().alias("confidence"),
        package_state().alias("package_state"),
        next_step().alias("next_step"),
    )


SEARCHED = ("title", "description", "agency", "external_id", "solicitation_type")


def matches_text(query: str) -> Column:
    """Case-blind LIKE over each searched column; ``%`` and ``_`` in the query stay wildcards."""
    pattern = F.lit(f"%{query}%")
    fields = [F.col(c) for c in SEARCHED] + [F.array_join("naics_codes", " "), F.col("psc_code")]
    return reduce(Column.__or__, [F.coalesce(F.ilike(f, pattern), F.lit(False)) for f in fields])


def matches_joined(query: str) -> Column:
    """LIKE over all text of a record at once, so that a match may run across columns."""
    fields = ["title", "description", "agency", "external_id"]
    whole = F.concat_ws(" ", *(F.coalesce(c, F.lit("")) for c in fields), F.array_join("naics_codes", " "), F.col("psc_code"))
    return F.like(F.lower(whole), F.lit(f"%{query.lower()}%"))


def search(records: DataFrame, query: str = "", state: str = "", limit: int = 100) -> DataFrame:
    """A page of matches, each with the number of all matches."""
    found = records.where(matches_text(query)) if query else records
    found = found.where(F.col("state_code") == state) if state else found
    total = found.agg(F.count("*").alias("total"))  # one row
    return by_due_date(found, limit).join(F.broadcast(total)).select("id", "title", "agency", "due_at", "state_code", "total")


def family_counts(records: DataFrame) -> DataFrame:
    return records.agg(
        F.count_if(F.col("source_family") == "federal").alias("federal"),
        F.count_if(F.col("source_family") == "sled").alias("sled"),
    )


LOCAL_TYPES = ("municipal", "municipality", "county", "local_agency")


def market_counts(records: DataFrame) -> DataFrame:
    """Records by market segment; kinds outside the segments are counted in none."""
    kind = F.col("agency_type")
    return records.agg(
        F.count_if(kind == "k12").alias("k12"),
        F.count_if(kind == "higher_ed").alias("higher_ed"),
        F.count_if(kind.isin("state", "state_agency")).alias("state"),
        F.count_if(kind.isin(*LOCAL_TYPES)).alias("local"),
        F.count_if(kind == "authority").alias("authorities"),
    )


def proof_counters(records: DataFrame, documents: DataFrame, sources: DataFrame) -> DataFrame:
    live = records.agg(F.count("*").alias("open_records"), F.count_if(F.col("due_at").isNotNull()).alias("with_deadline"), F.countDistinct("agency_id").alias("agencies"))
    docs = documents.agg(F.count("*").alias("documents"))
    return live.join(F.broadcast(docs)).join(F.broadcast(sources.agg(F.count("*").alias("sources"))))
