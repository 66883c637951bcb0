"""Sweeps of a source: whether all that it reports has been read, and what may be closed after that.

The counts of a sweep are one aggregated row for each source. A sweep that is not complete neither
writes nor closes anything: ``checked`` makes the plan itself fail, ``complete_only`` leaves its source out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

#: What must hold of a sweep's counts, by the kind of its gate.
EXACT, SOME, PARSED, NONE = "exact", "some", "parsed", "none"


def counted(pages: DataFrame, items: DataFrame, records: DataFrame, gates: dict[str, str], key: str = "item_key") -> DataFrame:
    """One row for each source: pages, what it reports (least and greatest over its pages), rows read, their
    keys and distinct keys, records made, its gate, and whether the sweep is ``complete``.

    ``pages`` has source, page and ``reported`` (null on pages that report nothing), ``items`` source and ``key``,
    ``records`` source. A source without one page is not there.
    """
    told = pages.groupBy("source").agg(F.count_distinct("page").alias("pages"), F.min("reported").alias("reported"), F.max("reported").alias("most_reported"), F.max("page").alias("last_page"))
    read = items.groupBy("source").agg(F.count("*").alias("rows"), F.count(key).alias("keys"), F.count_distinct(key).alias("unique_keys"))
    made = records.groupBy("source").agg(F.count("*").alias("records"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    joined = told.join(read, "source", "left").join(made, "source", "left")
    for name in ("rows", "keys", "unique_keys", "records"):
        joined = joined.withColumn(name, zero(F.col(name)))
    gate = F.coalesce(F.create_map(*(F.lit(x) for pair in gates.items() for x in pair))[F.col("source")], F.lit(NONE))
    gap = F.col("last_page") != F.col("pages") - 1  # pages are numbered from 0
    reports = F.coalesce((F.col("reported") == F.col("most_reported")) & (F.col("reported") >= 0), F.lit(False))
    exact = reports & ~gap & (F.col("rows") == F.col("reported")) & (F.col("keys") == F.col("rows")) & (F.col("unique_keys") == F.col("rows"))
    parsed = reports & ~gap & (F.col("unique_keys") == F.col("reported")) & (F.col("records") == F.col("reported"))
    complete = F.when(gate == EXACT, exact).when(gate == PARSED, parsed).when(gate == SOME, ~gap & (F.col("records") > 0)).otherwise(True)
    return joined.select("source", gate.alias("gate"), "pages", "reported", "rows", "keys", "unique_keys", "records", complete.alias("complete"))


def failure(source: Column) -> Column:
    parts = [F.lit("sweep of "), source, F.lit(" is not complete: reported "), F.coalesce(F.col("reported").cast("string"), F.lit("nothing"))]
    for name in ("rows", "unique_keys", "records"):
        parts += [F.lit(f", {name.replace('_', ' ')} "), F.col(name).cast("string")]
    return F.concat(*parts)


def checked(records: DataFrame, sweeps: DataFrame) -> DataFrame:
    """``records`` by a plan that fails, with the counts, if the sweep of one of their sources is not complete."""
    state = sweeps.select(F.col("source").alias("_s"), "complete", "reported", "rows", "unique_keys", F.col("records"))
    joined = records.join(F.broadcast(state), records["source"] == F.col("_s"), "left")  # one row for each source
    passed = F.when(F.coalesce("complete", F.lit(False)), True).otherwise(F.raise_error(failure(records["source"])).cast("boolean"))
    return joined.where(passed).select(*records.columns)


def complete_only(records: DataFrame, sweeps: DataFrame) -> DataFrame:
    """``records`` of the sources whose sweep is complete."""
    return records.join(F.broadcast(sweeps.where("complete").select("source")), "source", "left_semi")


def closable(stored: DataFrame, records: DataFrame, sweeps: DataFrame, closing: list[str]) -> DataFrame:
    """Open stored records that a complete sweep no longer lists, of the sources in ``closing`` alone."""
    able = sweeps.where(F.col("complete") & F.col("source").isin(*closing)).select("source")
    open_ones = stored.where("status = 'open' and external_id is not null").join(F.broadcast(able), "source", "left_semi")
    return open_ones.join(records.select("source", "external_id"), ["source", "external_id"], "left_anti")


def observed(items: DataFrame, name: str, key: str = "item_key") -> tuple[DataFrame, Observation]:
    """``items`` with an observation of their number and keys, read once an action on them has run: for a
    single source, counts without a second pass."""
    seen = Observation(name)
    return items.observe(seen, F.count("*").alias("rows"), F.count(key).alias("keys")), seen
