"""The next version of a keyed table and its change rows, from one full join.

Every key of either side comes out once, with the row it has from now on and, where something changed,
what: an update (the digests differ; before and after are the fields that are watched) or a closing (a complete
sweep no longer lists it). New keys have no change row. Which keys may be closed is the caller's to
say, from a sweep that is complete.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHANGE = "struct<change_type:string,summary:string,before:string,after:string,evidence:string>"


def _as_json(**fields: Column) -> Column:
    return F.to_json(F.struct(*(c.alias(n) for n, c in fields.items())), {"ignoreNullFields": "false"})


def next_rows(stored: DataFrame, incoming: DataFrame, closing: DataFrame, keys: list[str], watched: list[str], seen_at: Column, name: Column) -> DataFrame:
    """The columns of ``stored``, and ``change`` (null where nothing changed). ``stored`` has the columns of ``incoming``, first_seen_at and
    last_seen_at; both have status and content_hash; ``closing`` has the keys; ``name`` is what a source is called in summaries."""
    own = [c for c in incoming.columns if c not in keys]
    old = stored.select(*keys, F.struct(*own, "first_seen_at", "last_seen_at").alias("old"))
    new = incoming.select(*keys, F.struct(*own).alias("new"))
    both = old.join(new, keys, "full").join(closing.select(*keys, F.lit(True).alias("close")).distinct(), keys, "left")
    comes, was = F.col("new").isNotNull(), F.col("old").isNotNull()
    closes = was & ~comes & F.coalesce("close", F.lit(False)) & (F.col("old.status") == "open")
    differs = was & comes & ~F.col("old.content_hash").eqNullSafe(F.col("new.content_hash"))
    changed = [F.when(~F.col(f"old.{f}").eqNullSafe(F.col(f"new.{f}")), f) for f in watched]
    fields = F.array_join(F.array_compact(F.array(*changed)), ", ")
    update = F.struct(
        F.lit("source_update").alias("change_type"), F.concat(name, F.when(fields == "", " record changed").otherwise(F.concat(F.lit(" changed: "), fields))).alias("summary"),
        _as_json(**{f: F.col(f"old.{f}") for f in watched}).alias("before"), _as_json(**{f: F.col(f"new.{f}") for f in watched}).alias("after"), _as_json(**{k: F.col(k) for k in keys}).alias("evidence"),
    )
    closed = F.struct(
        F.lit("source_closed").alias("change_type"), F.concat(name, F.lit(" no longer lists this as open")).alias("summary"), _as_json(status=F.lit("open")).alias("before"), _as_json(status=F.lit("closed")).alias("after"),
        _as_json(**{k: F.col(k) for k in keys}, complete_sweep=F.lit(True)).alias("evidence"),
    )
    value = lambda c: F.when(comes, F.col(f"new.{c}")).when(closes & F.lit(c == "status"), F.lit("closed") if c == "status" else None).otherwise(F.col(f"old.{c}"))
    return both.select(
        *keys, *(value(c).alias(c) for c in own), F.coalesce("old.first_seen_at", seen_at).alias("first_seen_at"), F.when(comes, seen_at).otherwise(F.col("old.last_seen_at")).alias("last_seen_at"),
        F.when(differs, update).when(closes, closed).cast(CHANGE).alias("change"), (comes & ~was).alias("is_new"), comes.alias("was_seen"),
    )


def run_counts(rows: DataFrame) -> DataFrame:
    """What a run has seen, added, changed and closed, as one row."""
    kind = F.col("change.change_type")
    return rows.agg(F.count_if("was_seen").alias("records_seen"), F.count_if("is_new").alias("records_new"), F.count_if(kind.isNotNull()).alias("records_changed"), F.count_if(kind == "source_closed").alias("records_closed"))
