"""Job queue transitions as pure functions of the job table; one writer applies them in batches."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import DECISION_RANKS, DOCUMENT_RANKS, TYPE_RANKS, backoff_seconds, first_match

#: Errors after which no attempt is left.
ERROR_PERMANENT = "^(http_(400|401|404|410)|too_large_runtime_cap|invalid_payload)$"
ERROR_CLOSED = "opportunity_closed_or_expired"
LEASE_MINUTES = 10


def _later(now: datetime, seconds: Column) -> Column:
    return F.timestamp_seconds(F.unix_seconds(F.lit(now).cast("timestamp")) + seconds)


def _freed(jobs: DataFrame, out: Column, columns: dict[str, Column]) -> DataFrame:
    """``columns`` where ``out`` holds, and the lease of those jobs given up."""
    free = {c: F.when(~out, F.col(c)) for c in ("leased_until", "lease_owner") if c in jobs.columns}
    return jobs.withColumns({c: F.when(out, value).otherwise(F.col(c)) for c, value in columns.items()} | free)


def _waiting() -> Column:
    return F.when(F.col("attempts") >= F.col("max_attempts"), "dead").otherwise("pending")


def expire_leases(jobs: DataFrame, now: datetime) -> DataFrame:
    """Leases that ran out go back to pending after their backoff, or die at the last attempt."""
    out = F.coalesce((F.col("state") == "leased") & (F.col("leased_until") < F.lit(now)), F.lit(False))
    return _freed(jobs, out, {"run_after": _later(now, backoff_seconds(F.col("attempts"))), "last_error": F.coalesce("last_error", F.lit("lease expired")), "state": _waiting()})


def retry(jobs: DataFrame, failures: DataFrame, now: datetime) -> DataFrame:
    """Failed jobs (``id``, ``error``) wait twice as long after each attempt; some errors use up all attempts."""
    joined = jobs.join(failures.select("id", "error"), "id", "left")
    failed, final = F.col("error").isNotNull(), F.col("error").rlike(ERROR_PERMANENT)
    return _freed(joined, failed, {
        "run_after": F.when(final, F.col("run_after")).otherwise(_later(now, backoff_seconds(F.col("attempts")))),
        "last_error": F.substring("error", 1, 1000),
        "state": F.when(final, "dead").otherwise(_waiting()),
        "attempts": F.when(final, F.col("max_attempts")).otherwise(F.col("attempts")),
    }).drop("error")


def finish(jobs: DataFrame, done: DataFrame) -> DataFrame:
    flagged = jobs.join(done.select("id").distinct().withColumn("_done", F.lit(True)), "id", "left")
    return _freed(flagged, F.coalesce("_done", F.lit(False)), {"state": F.lit("done")}).drop("_done")


def claim(jobs: DataFrame, now: datetime, k: int, owner: str = "worker") -> DataFrame:
    """The next ``k`` jobs to run, leased to ``owner`` and one attempt on; a top-k over what is ready."""
    ready = jobs.where((F.col("state") == "pending") & (F.col("run_after") <= F.lit(now)))
    return ready.orderBy("priority", "run_after", "id").limit(k).withColumns({
        "state": F.lit("leased"), "leased_until": _later(now, F.lit(60 * LEASE_MINUTES)), "lease_owner": F.lit(owner), "attempts": F.col("attempts") + 1,
    })


#: What an enqueue leaves as it is, by policy; everything else becomes pending.
KEPT = {"continue": ("done", "leased"), "force": (), "force_extract": ("done",), "package": ("done", "leased")}
#: Policies that give dead jobs new attempts.
REVIVING = ("force", "package")


def enqueue(jobs: DataFrame, wanted: DataFrame, policy: str, keys: tuple[str, ...] = ("document_id", "stage")) -> DataFrame:
    """Upsert of ``wanted`` (keys, ``priority``): the lesser priority stays. A forced job to acquire a
    document starts again whatever its state, one to extract it only if it was not done."""
    asked = wanted.groupBy(*keys).agg(F.min("priority").alias("asked"))
    both = jobs.join(asked, list(keys), "full")
    known, want = F.col("state").isNotNull(), F.col("asked").isNotNull()
    kept = known & (~want | F.col("state").isin(*KEPT[policy])) if KEPT[policy] else known & ~want
    attempts = F.when(~known, 0).when((F.lit(policy in REVIVING)) & want & (F.col("state") == "dead"), 0).otherwise(F.col("attempts"))
    return both.select(
        *keys,
        F.when(kept, F.col("state")).otherwise("pending").alias("state"),
        F.least("priority", "asked").alias("priority"),
        attempts.alias("attempts"),
    )


def expire_for_closed(jobs: DataFrame, closed: DataFrame, key: str = "opportunity_id") -> DataFrame:
    """Waiting jobs of closed records are given up; leased ones run to their end."""
    gone = closed.select(key).distinct().withColumn("_gone", F.lit(True))
    out = F.coalesce(F.col("_gone") & (F.col("state") == "pending"), F.lit(False))
    return _freed(jobs.join(gone, key, "left"), out, {"state": F.lit("dead"), "last_error": F.lit(ERROR_CLOSED)}).drop("_gone")


def job_counts(jobs: DataFrame, key: str = "opportunity_id") -> DataFrame:
    return jobs.groupBy(key).agg(F.count_if(F.col("state").isin("pending", "leased")).alias("active"), F.count_if(F.col("state") == "dead").alias("dead"))


def document_order(filename: Column) -> Column:
    return first_match(filename, DOCUMENT_RANKS, "9").cast("int")


def decision_order(filename: Column, document_type: Column) -> Column:
    """Rank of a package document when a decision is asked for: its name first, then its type."""
    name, kind = F.lower(F.coalesce(filename, F.lit(""))), F.lower(F.coalesce(document_type, F.lit("")))
    return first_match(name, DECISION_RANKS, first_match(kind, TYPE_RANKS, "9")).cast("int")


def candidates(records: DataFrame, group: str, most: int = 20) -> DataFrame:
    """Up to ``most`` records of each group, soonest due first."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.asc_nulls_last("due_at"), "id"))
    return records.withColumn("rank", rank).where(F.col("rank") <= most)


def shard_of_hour(index: Column, hour: int, shards: int = 5) -> Column:
    return F.pmod(index, F.lit(shards)) == hour % shards


def is_stale(last_run: Column, now: datetime, days: int = 30) -> Column:
    return last_run.isNull() | (last_run < F.lit(now) - F.expr(f"interval {days} days"))
