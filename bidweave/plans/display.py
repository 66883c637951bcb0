"""Registered queries: what is shown of a record in words, and how agencies and sources are listed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions import rules, text
from ..operators import coverage, inventory, postings
from ..sources import landing
from .catalog import Tables, query
from .views import AS_OF

_MATCH = """case when coalesce(identified, 0) = 0 then 'No bid-package documents have been identified yet.' when missing > 0 then missing || ' identified package document' || case missing when 1 then ' is' else 's are' end || ' marked missing.'
 when fetched < identified then (identified - fetched) || ' identified package document' || case identified - fetched when 1 then ' is' else 's are' end || ' still awaiting acquisition.'
 when analyzed < fetched then (fetched - analyzed) || ' fetched package document' || case fetched - analyzed when 1 then ' is' else 's are' end || ' still awaiting analysis.'
 else 'All currently identified package documents have been analyzed; package completeness still needs source confirmation.' end"""
_PACKAGE = """case when coalesce(identified, 0) = 0 then 'No bid-package documents have been identified yet.'
 when missing > 0 then missing || ' of ' || identified || ' identified package document' || case identified when 1 then '' else 's' end || ' ' || case missing when 1 then 'is' else 'are' end || ' marked missing.'
 when fetched < identified then (identified - fetched) || ' of ' || identified || ' identified package document' || case identified when 1 then '' else 's' end || ' ' || case identified - fetched when 1 then 'has' else 'have' end || ' not yet been fetched.'
 when analyzed < fetched then (fetched - analyzed) || ' of ' || fetched || ' fetched package document' || case fetched when 1 then '' else 's' end || ' ' || case fetched - analyzed when 1 then 'has' else 'have' end || ' not yet been analyzed.'
 else 'All currently identified package documents have been analyzed; package completeness is not yet verified.' end"""


def _with_documents(t: Tables):
    return inventory.with_document_state(t.opportunities, t.documents)


@query("x20_match_uncertainty", f"select id, {_MATCH} uncertainty from opp left join ds on opportunity_id = id")
def x20_match_uncertainty(spark, sf_dir):
    return _with_documents(Tables(spark, sf_dir)).select("id", rules.match_uncertainty().alias("uncertainty"))


@query("x19_display_money", "select o_orderkey, case when v < 0 and round(-v) > 0 then '-' else '' end || '$' || format('{:,}', round(abs(v))::bigint) shown from (select o_orderkey, case when o_orderkey % 5 = 0 then -o_totalprice when o_orderkey % 7 = 0 then (o_orderkey % 100) / 200.0 else o_totalprice end v from orders)")
def x19_display_money(spark, sf_dir):
    key = F.col("o_orderkey")
    value = F.when(key % 5 == 0, -F.col("o_totalprice")).when(key % 7 == 0, (key % 100) / 200.0).otherwise(F.col("o_totalprice"))
    return Tables(spark, sf_dir).raw("orders").select("o_orderkey", text.shown_money(value).alias("shown"))


@query("p14_federal_messages", f"""select id, concat_ws('; ', case when due_at is not null then 'Response deadline published by SAM.gov' end, case when set_aside <> '' then 'Set-aside: ' || set_aside end, case when len(naics_codes) > 0 then 'NAICS ' || naics_codes[1] end, case when coalesce(fetched, 0) > 0 then fetched || ' linked resource' || case fetched when 1 then '' else 's' end || ' identified by SAM.gov' end) verified,
 concat_ws('; ', case when due_at is null then 'Response deadline not present in the stored SAM.gov record' end, case when coalesce(set_aside, '') = '' then 'Set-aside status not stated in the stored feed record' end, case when len(naics_codes) = 0 then 'NAICS code not present in the stored feed record' end, {_PACKAGE}) uncertain from opp left join ds on opportunity_id = id""")  # fmt: skip
def p14_federal_messages(spark, sf_dir):
    verified, uncertain = rules.federal_messages(F.col("fetched"))
    return _with_documents(Tables(spark, sf_dir)).select("id", F.array_join(verified, "; ").alias("verified"), F.array_join(uncertain, "; ").alias("uncertain"))


@query("p14_state_messages", f"""select id, concat_ws('; ', case when due_at is not null then 'Response deadline published by ' || source_name end, case when id % 3 > 0 then 'Solicitation ' || external_id end) verified,
 concat_ws('; ', case when due_at is null then 'Response deadline is not stated in the public listing' end, {_PACKAGE}) uncertain from opp join src using (source_id) left join ds on opportunity_id = id""")  # fmt: skip
def p14_state_messages(spark, sf_dir):
    t = Tables(spark, sf_dir)
    rows = _with_documents(t).join(t.sources.select("source_id", "source_name"), "source_id")
    verified, uncertain = rules.state_messages(F.col("source_name"), F.when(F.col("id") % 3 > 0, F.col("external_id")))
    return rows.select("id", F.array_join(verified, "; ").alias("verified"), F.array_join(uncertain, "; ").alias("uncertain"))


@query("o6_agencies_by_people", """, pe as (select s_suppkey % 40 agency_id, count(*) people from supplier group by 1), oc as (select agency_id, count(*) filter (where status = 'open' and (due_at is null or due_at >= timestamp '1998-01-01')) open_count, count(*) total_count from opp group by 1)
 select agency_id, agency, coalesce(people, 0) people, coalesce(open_count, 0) open_count, coalesce(total_count, 0) total_count from ag left join pe using (agency_id) left join oc using (agency_id) order by people desc nulls last, open_count desc nulls last, agency, agency_id limit 100""")  # fmt: skip
def o6_agencies_by_people(spark, sf_dir):
    t = Tables(spark, sf_dir)
    people = t.raw("supplier").select((F.col("s_suppkey") % 40).alias("agency_id"))
    listed = coverage.agencies_by_people(t.agencies, t.opportunities, people, F.lit(AS_OF))
    return listed.select("agency_id", "agency", "people", "open_count", "total_count")


_KEYS_SQL = "case source_id % 5 when 0 then 'periscopeX' || source_id when 1 then 'jaggaer_' || source_id when 2 then 'indiana_idoa' when 3 then 'peoplesoft' else adapter_key end"


@query("a5_state_source_counts", f", named as (select source_id, source_family, {_KEYS_SQL} adapter_key, registry_state from src) select source_id, source_family, adapter_key, registry_state, count(id) records, count(id) filter (where status = 'open') open_records, max(due_at) last_due from named left join opp using (source_id) where source_family = 'sled' or adapter_key in ('indiana_idoa', 'tennessee_cpo_public') or adapter_key like 'periscope_%' or adapter_key like 'jaggaer_%' or adapter_key like 'peoplesoft_%' group by all")
def a5_state_source_counts(spark, sf_dir):
    """The underlines of the rules are wildcards, so that a key with another sign in that place counts too."""
    t, n = Tables(spark, sf_dir), F.col("source_id")
    key = F.when(n % 5 == 0, F.concat(F.lit("periscopeX"), n)).when(n % 5 == 1, F.concat(F.lit("jaggaer_"), n)).when(n % 5 == 2, "indiana_idoa").when(n % 5 == 3, "peoplesoft").otherwise(F.col("adapter_key"))
    named = t.sources.withColumn("adapter_key", key)
    return coverage.source_counts(named.where(coverage.is_state_source(F.col("adapter_key"), F.col("source_family"))), t.opportunities)


#: A rare term, one with both wildcards, one without a gram, one that is nowhere.
TERMS = ("9_31", "ORDER%77", "s_e%12", "1_", "no such term")


@query("f4_posted_search", " union all ".join(f"select '{t}' term, id from opp where title ilike '%{t}%' or description ilike '%{t}%' or external_id ilike '%{t}%'" for t in TERMS))
def f4_posted_search(spark, sf_dir):
    """Each term over all records, which are put down once beside their postings."""
    fields, path = ["title", "description", "external_id"], landing.folder(spark, "postings")
    made = Tables(spark, sf_dir).opportunities.select("id", *fields)
    made.write.parquet(f"{path}/records")
    records = spark.read.schema(made.schema).parquet(f"{path}/records")
    postings.write(records, fields, f"{path}/grams")
    landing.drop_at_end(spark, path)
    found = [postings.search(records, fields, f"{path}/grams", t).select(F.lit(t).alias("term"), "id") for t in TERMS]
    return reduce(lambda a, b: a.union(b), found)
