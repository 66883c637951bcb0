"""Document packages: file names, their summary, lifecycle, and requirements that a portal states itself."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import first_match

SUMMARY_DOCUMENTS, SUMMARY_REQUIREMENTS = 50, 20

#: Categories of requirements that a portal states, in order; what matches none is OTHER_REQUIREMENT.
API_CATEGORIES = (
    ("insurance", "(?i)insurance|insured|liability|workers.? compensation"),
    ("bonding", "(?i)bond|bonding"),
    ("certification", "(?i)certif|affidavit|registration|disclosure|questionnaire"),
    ("pricing", "(?i)price|pricing|fee|cost"),
    ("evaluation", "(?i)evaluation|award|score|weight"),
    ("technical", "(?i)scope|technical|training|specification|service"),
    ("submission_requirement", "(?i)submit|submission|proposal|bid package|return with"),
)
OTHER_REQUIREMENT = "other_requirement"
#: Fixed value: words that make a portal's text a requirement.
LOOKS_REQUIRED = r"(?i)\b(shall|must|required|submit|failure to|will be cause|shall provide|shall include)\b"
#: States of a document after what happened to it.
STATUS_AFTER = {
    "found": "cataloged", "fetched": "fetched", "failed": "fetch_failed", "retry": "cataloged", "too_large": "fetch_too_large", "invalid": "fetch_invalid",
    "no_text": "text_empty", "text": "text_extracted", "analyzed": "analyzed",
}


def safe_filename(value: Column) -> Column:
    """File name with its strange characters put as dashes."""
    kept = F.regexp_replace(F.regexp_replace(value, r"\+", " "), "[^a-zA-Z0-9._() -]+", "-")
    return F.coalesce(F.nullif(F.trim(F.regexp_replace(kept, r"\s+", " ")), F.lit("")), F.lit("document"))


def normalized_filename(value: Column) -> Column:
    return F.lower(safe_filename(value))


def disposition_filename(header: Column) -> Column:
    """File name of a Content-Disposition header: the encoded form first, then the plain one."""
    encoded = F.nullif(F.regexp_extract(header, r"(?i)filename\*=UTF-8''([^;]+)", 1), F.lit(""))
    plain = F.nullif(F.regexp_extract(header, r'(?i)filename="?([^";]+)"?', 1), F.lit(""))
    return F.coalesce(F.try_url_decode(F.replace(encoded, F.lit("+"), F.lit("%2B"))), encoded, plain)


def document_url(key: Column, storage_key: Column, source_url: Column) -> Column:
    """Own address of a stored document, else that of its source."""
    return F.when(storage_key != "", F.concat(F.lit("/api/documents/file/"), key.cast("string"))).otherwise(source_url)


def document_summary(docs: DataFrame, key: str = "opportunity_id", most: int = SUMMARY_DOCUMENTS) -> DataFrame:
    """Counts of each record's documents and the first of them, last fetched first: one pass and one shuffle.

    ``docs`` have id, filename, fetched_at, extraction_status, is_missing, storage_key and source_url. Documents that share an id
    stand in the order of what is shown of them.
    """
    url = document_url(F.col("id"), F.col("storage_key"), F.col("source_url"))
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc_nulls_last("fetched_at"), "filename", "id", url, "extraction_status"))
    shown = F.struct("place", "id", "filename", url.alias("url"), "extraction_status", "fetched_at")
    placed = docs.withColumn("place", place)
    return placed.groupBy(key).agg(
        F.count("*").alias("identified"), F.count("fetched_at").alias("fetched"), F.count_if(F.col("extraction_status").isin("complete", "extracted", "analyzed")).alias("analyzed"),
        F.count_if("is_missing").alias("missing"), F.sort_array(F.collect_list(F.when(F.col("place") <= most, shown))).alias("documents"),
    )


def requirement_evidence(requirements: DataFrame, docs: DataFrame, key: str = "opportunity_id", most: int = SUMMARY_REQUIREMENTS) -> DataFrame:
    """The first mandatory requirements of each record with the document each stands in; those without one are left out.

    Of one requirement's documents, where several share an id, the names and then the addresses give the order.
    """
    named = docs.select(F.col("id").alias("document_id"), "filename", document_url(F.col("id"), F.col("storage_key"), F.col("source_url")).alias("url"))
    joined = requirements.where("mandatory").join(named, "document_id")
    place = F.row_number().over(Window.partitionBy(key).orderBy("created_at", "id", "filename", "url"))
    return joined.withColumn("place", place).where(F.col("place") <= most)


def with_acquire_job(docs: DataFrame, jobs: DataFrame) -> DataFrame:
    """Documents with the state of their acquire job, where they have one."""
    acquire = jobs.where("stage = 'acquire'").select(F.col("document_id").alias("id"), F.col("state").alias("job_state"))
    return docs.join(acquire, "id", "left")


def ready_to_extract(jobs: DataFrame, docs: DataFrame, opportunities: DataFrame, now, k: int = 24) -> DataFrame:
    """The next extract jobs whose document is a fetched PDF of a current record."""
    waiting = jobs.where((F.col("stage") == "extract") & (F.col("state") == "pending") & (F.col("run_after") <= F.lit(now)))
    fetched = docs.where((F.col("extraction_status") == "fetched") & F.col("storage_key").isNotNull() & F.lower("filename").endswith(".pdf"))
    open_ones = opportunities.where((F.col("status") == "open") & (F.col("due_at").isNull() | (F.col("due_at") >= F.lit(now)))).select(F.col("id").alias("opportunity_id"))
    named = fetched.select(F.col("id").alias("document_id"), "opportunity_id", "filename").join(open_ones, "opportunity_id", "left_semi")
    return waiting.join(named, "document_id").orderBy("priority", "run_after", "id").limit(k)


def api_category(content: Column) -> Column:
    return first_match(content, API_CATEGORIES, OTHER_REQUIREMENT)


def looks_required(content: Column) -> Column:
    return content.rlike(LOOKS_REQUIRED)


def status_after(status: Column, event: Column) -> Column:
    """State of a document after an event; an unknown event changes nothing."""
    return F.coalesce(F.create_map(*(F.lit(x) for pair in STATUS_AFTER.items() for x in pair))[event], status)


def without_text_requirements(requirements: DataFrame, read_again: DataFrame) -> DataFrame:
    """``requirements`` less those once read from the text of documents (``document_id``) that are read again.

    Those of no document, and those of another source, never go, so they stay out of the join: their keys would all meet in one task.
    """
    able = F.coalesce((F.col("source") == "document_text") & F.col("document_id").isNotNull(), F.lit(False))
    stale = read_again.select("document_id")
    return requirements.where(~able).unionByName(requirements.where(able).join(stale, "document_id", "left_anti").select(*requirements.columns))


def merged_maps(left: Column, right: Column) -> Column:
    """Union of two maps, the right one's values winning; null counts as empty."""
    none = F.create_map().cast("map<string,string>")
    a, b = F.coalesce(left, none), F.coalesce(right, none)
    return F.map_concat(F.map_filter(a, lambda k, _: ~F.array_contains(F.map_keys(b), k)), b)


def current(records: DataFrame, now, grace_hours: int = 0) -> DataFrame:
    """Records that are not past due, or not by more than ``grace_hours``."""
    return records.where(F.col("due_at").isNull() | (F.col("due_at") >= F.lit(now) - F.expr(f"interval {int(grace_hours)} hours")))


def unioned(tables: Iterable[DataFrame]) -> DataFrame:
    first, *others = tables
    for other in others:
        first = first.unionByName(other)
    return first
