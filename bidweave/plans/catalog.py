"""The registry of named queries; each has its DuckDB counterpart beside it where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import classify, dates, rules, text
from ..operators import cdc, coverage, decision, documents, evidence, inventory, match, queue
from ..sources import landed
from . import views
from .views import AS_OF, SQL

FLAGSHIP = "k1_profile_match"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Register a query, with its SQL over the views of ``views.SQL``."""

    def register(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = run
        if sql is not None:
            ORACLE_SQL[name] = f"with {SQL}{sql}" if sql.startswith(",") else f"with {SQL} {sql}"
        return run

    return register


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.agencies, self.sources = views.agencies(spark, sf_dir), views.sources(spark, sf_dir)
        self.opportunities, self.documents = views.opportunities(spark, sf_dir), views.documents(spark, sf_dir)
        self.raw = lambda name: views.table(spark, sf_dir, name)

    def current(self, family: str = "all") -> DataFrame:
        return inventory.current(self.opportunities, self.agencies, self.sources, AS_OF, family)


# -- inventory ------------------------------------------------------------------------------------

_STATE = "coalesce(identified, 0) identified, coalesce(fetched, 0) fetched, coalesce(analyzed, 0) analyzed, coalesce(missing, 0) missing"
_CONFIDENCE = """least(78, case when source_family = 'federal' then 38 else 42 end + case when due_at is not null then 10 else 0 end + case when external_id <> '' then 7 else 0 end
 + case when len(naics_codes) > 0 then 5 else 0 end + case when set_aside <> '' then 5 else 0 end + case when city <> '' or state_code <> '' then 5 else 0 end + case when identified > 0 then 7 else 0 end)::int"""


def _listing_sql(family: str) -> str:
    return f"""select id, agency, title, due_at, estimated_value, identified, fetched, analyzed, missing,
 case when city <> '' and state_code <> '' then city || ', ' || state_code else coalesce(nullif(city, ''), nullif(state_code, ''), 'Location not stated') end as location, {_CONFIDENCE} confidence,
 case when identified = 0 then 'No bid-package documents have been identified yet.'
  when missing > 0 then missing || ' of ' || identified || ' identified package document' || case identified when 1 then '' else 's' end || ' ' || case missing when 1 then 'is' else 'are' end || ' marked missing.'
  when fetched < identified then (identified - fetched) || ' of ' || identified || ' identified package document' || case identified when 1 then '' else 's' end || ' ' || case identified - fetched when 1 then 'has' else 'have' end || ' not yet been fetched.'
  when analyzed < fetched then (fetched - analyzed) || ' of ' || fetched || ' fetched package document' || case fetched when 1 then '' else 's' end || ' ' || case fetched - analyzed when 1 then 'has' else 'have' end || ' not yet been analyzed.'
  else 'All currently identified package documents have been analyzed; package completeness is not yet verified.' end package_state,
 case when identified = 0 then 'Open the original source and locate the bid package or solicitation documents.' when missing > 0 then 'Resolve the missing package documents before making a Pursue / Watch / Walk decision.'
  when fetched < identified then 'Acquire the remaining identified package documents.' when analyzed < fetched then 'Analyze the remaining fetched package documents.' else 'Review verified requirements and confirm package completeness before deciding Pursue / Watch / Walk.' end next_step
 from (select cur.*, {_STATE} from cur left join ds on id = opportunity_id) where '{family}' in ('all', source_family) order by due_at nulls last, id limit 500"""


@query("o1_current_federal", _listing_sql("federal"))
def o1_current_federal(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return inventory.listing(t.current("federal"), t.documents, 500)


@query("o1_current_sled", _listing_sql("sled"))
def o1_current_sled(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return inventory.listing(t.current("sled"), t.documents, 500)


@query("a1_document_state", "select * from ds")
def a1_document_state(spark, sf_dir):
    return inventory.document_state(Tables(spark, sf_dir).documents)


_SEARCH = "title ilike '%{0}%' or description ilike '%{0}%' or agency ilike '%{0}%' or external_id ilike '%{0}%' or solicitation_type ilike '%{0}%' or array_to_string(naics_codes, ' ') ilike '%{0}%' or psc_code ilike '%{0}%'"


@query("f4_search_inventory", f", hit as (select * from cur where {_SEARCH.format('r_d')}) select id, title, agency, due_at, state_code, count(*) over () total from hit order by due_at nulls last, id limit 100")
def f4_search_inventory(spark, sf_dir):
    """The wildcard in the query term stays one."""
    return inventory.search(Tables(spark, sf_dir).current(), "r_d")


@query("f4_search_in_state", f", hit as (select * from cur where ({_SEARCH.format('widget')}) and state_code = '07') select id, title, agency, due_at, state_code, count(*) over () total from hit order by due_at nulls last, id limit 100")
def f4_search_in_state(spark, sf_dir):
    return inventory.search(Tables(spark, sf_dir).current(), "widget", "07")


@query("f5_joined_search", """select id, title from cur where lower(coalesce(title, '') || ' ' || coalesce(description, '') || ' ' || coalesce(agency, '') || ' ' || coalesce(external_id, '') || ' ' || array_to_string(naics_codes, ' ') || ' ' || psc_code) like '%ring customer%'""")
def f5_joined_search(spark, sf_dir):
    return Tables(spark, sf_dir).current().where(inventory.matches_joined("ring Customer")).select("id", "title")


@query("a2_inventory_counts", "select count(*) filter (where source_family = 'federal') federal, count(*) filter (where source_family = 'sled') sled from cur")
def a2_inventory_counts(spark, sf_dir):
    return inventory.family_counts(Tables(spark, sf_dir).current())


@query("a3_market_counts", """select count(*) filter (where agency_type = 'k12') k12, count(*) filter (where agency_type = 'higher_ed') higher_ed, count(*) filter (where agency_type in ('state', 'state_agency')) state,
 count(*) filter (where agency_type in ('municipal', 'municipality', 'county', 'local_agency')) as local, count(*) filter (where agency_type = 'authority') authorities from cur where source_family = 'sled'""")
def a3_market_counts(spark, sf_dir):
    return inventory.market_counts(Tables(spark, sf_dir).current("sled"))


@query("a4_proof_counters", "select count(*) open_records, count(due_at) with_deadline, count(distinct agency_id) agencies, (select count(*) from doc) documents, (select count(*) from src) sources from cur")
def a4_proof_counters(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return inventory.proof_counters(t.current(), t.documents, t.sources)


@query("j1_opportunity_detail", f"select id, agency, source_name, status, {_STATE} from opp join ag using (agency_id) join src using (source_id) left join ds on id = opportunity_id where id = 1")
def j1_opportunity_detail(spark, sf_dir):
    t = Tables(spark, sf_dir)
    one = t.opportunities.where("id = 1").join(t.agencies, "agency_id").join(t.sources, "source_id")
    return inventory.with_document_state(one, t.documents.where("opportunity_id = 1")).select("id", "agency", "source_name", "status", *inventory.STATES)


# -- match ----------------------------------------------------------------------------------------

PROFILE = match.Profile(naics=("Brand#7", "Brand#12"), psc=("ECONOMY",), terms=("red w_dget", "blue"), territories=("03", "07", "11"), certifications=("SDVOSB",), statuses=("hubzone",), least_value=50_000, most_value=300_000)

_SCORED = """, scored as (select *, lower(coalesce(title, '') || ' ' || coalesce(description, '')) txt, list_has_any(naics_codes, ['Brand#7', 'Brand#12']) n, psc_code = 'ECONOMY' p from cur),
flags as (select *, (txt like '%red w_dget%' or txt like '%blue%') t, coalesce(state_code in ('03', '07', '11'), false) h, coalesce(set_aside is not null and (lower(set_aside) like '%sdvosb%' or lower(set_aside) like '%hubzone%'), false) s,
 estimated_value is not null and estimated_value >= 50000 and estimated_value <= 300000 v from scored),
points as (select *, 80 + case when set_aside is not null then 10 else 0 end + case when estimated_value is not null then 10 else 0 end possible_points,
 case when n or p then 40 else 0 end + case when t then 25 else 0 end + case when h then 15 else 0 end + case when s then 10 else 0 end + case when v then 10 else 0 end earned_points,
 list_filter([case when n then 'NAICS match' when p then 'PSC match' end, case when t then 'Capability match' end, case when h then state_code || ' territory' end, case when s then 'Set-aside fit' end, case when v then 'Target contract range' end], lambda x: x is not null) reasons from flags),
ranked as (select *, round(100.0 * earned_points / possible_points)::int match_score, array_to_string(reasons, '; ') match_reasons from points)"""


def _scored(t: Tables) -> DataFrame:
    return match.score(t.current(), PROFILE)


@query("k1_profile_match", f"{_SCORED}, best as (select * from ranked where match_score >= 45 order by match_score desc, due_at nulls last, id limit 500) select id, agency, title, due_at, match_score, match_reasons, {_STATE} from best left join ds on id = opportunity_id")
def k1_profile_match(spark, sf_dir):
    t = Tables(spark, sf_dir)
    best = match.ranked(_scored(t), 45, 500)
    whole = inventory.with_document_state(best, t.documents)
    return whole.select("id", "agency", "title", "due_at", "match_score", F.array_join("match_reasons", "; ").alias("match_reasons"), *inventory.STATES)


@query("k2_match_points", f"{_SCORED} select id, possible_points, earned_points, match_score, match_reasons from ranked")
def k2_match_points(spark, sf_dir):
    return _scored(Tables(spark, sf_dir)).select("id", "possible_points", "earned_points", "match_score", F.array_join("match_reasons", "; ").alias("match_reasons"))


@query("a15_feed_headline", f"{_SCORED}, best as (select * from ranked where match_score >= 45 order by match_score desc, due_at nulls last, id limit 50), w as (select best.*, {_STATE} from best left join ds on id = opportunity_id) select max(match_score) best, count(*) filter (where match_score >= 80) strong, round(avg({_CONFIDENCE}))::int mean_confidence from w")
def a15_feed_headline(spark, sf_dir):
    t = Tables(spark, sf_dir)
    whole = inventory.with_document_state(match.ranked(_scored(t)), t.documents)
    return match.headline(whole.withColumn("confidence", rules.listing_confidence()))


# -- coverage and people --------------------------------------------------------------------------

_REGISTRY_SQL = "reg as (select lpad(n_nationkey::varchar, 2, '0') state, case n_nationkey % 5 when 0 then 'blocked' when 1 then 'partial' when 2 then 'planned' else 'live' end registry_status, r_name family from nation join region on n_regionkey = r_regionkey)"


def _registry(t: Tables) -> DataFrame:
    kind = F.pmod("n_nationkey", F.lit(5))
    status = F.when(kind == 0, "blocked").when(kind == 1, "partial").when(kind == 2, "planned").otherwise("live")
    joined = t.raw("nation").join(t.raw("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.select(F.lpad(F.col("n_nationkey").cast("string"), 2, "0").alias("state"), status.alias("registry_status"), F.col("r_name").alias("family"))


_COUNTED = ", sc as (select source_id, source_family, adapter_key, registry_state, count(id) records, count(id) filter (where status = 'open') open_records, max(due_at) last_due from src left join opp using (source_id) group by all)"


@query("a5_source_counts", f"{_COUNTED} select * from sc")
def a5_source_counts(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return coverage.source_counts(t.sources, t.opportunities)


_COVERED = f"{_COUNTED}, {_REGISTRY_SQL}, cov as (select state, registry_status, count(source_id) sources, coalesce(sum(open_records), 0)::bigint open_records, max(last_due) last_due from reg left join sc on adapter_key like '%\\_' || state escape '\\' group by 1, 2), eff as (select *, case when registry_status = 'blocked' then 'blocked' when open_records > 0 and registry_status = 'live' then 'live' when open_records > 0 or registry_status = 'partial' then 'partial' else 'queued' end effective_status from cov)"


def _coverage(t: Tables) -> DataFrame:
    return coverage.state_coverage(_registry(t), coverage.source_counts(t.sources, t.opportunities))


@query("a6_state_coverage", f"{_COVERED} select * from eff")
def a6_state_coverage(spark, sf_dir):
    return _coverage(Tables(spark, sf_dir))


@query("a7_coverage_summary", f"{_COVERED} select count(*) filter (where effective_status = 'live') live, count(*) filter (where effective_status = 'partial') partial, count(*) filter (where effective_status = 'blocked') blocked, count(*) filter (where effective_status = 'queued') queued, sum(open_records)::bigint open_records from eff")
def a7_coverage_summary(spark, sf_dir):
    return coverage.coverage_summary(_coverage(Tables(spark, sf_dir)))


@query("a8_registry_families", f", {_REGISTRY_SQL} select family, registry_status, count(*) states, array_to_string(list_sort(list(state)), ',') state_list from reg group by 1, 2")
def a8_registry_families(spark, sf_dir):
    grouped = _registry(Tables(spark, sf_dir)).groupBy("family", "registry_status")
    return grouped.agg(F.count("*").alias("states"), F.array_join(F.sort_array(F.collect_list("state")), ",").alias("state_list"))


@query("a9_agencies_by_state", "select agency_state, count(*) agencies, sum(count(*)) over ()::bigint total from ag where agency_type = 'k12' group by 1")
def a9_agencies_by_state(spark, sf_dir):
    k12 = Tables(spark, sf_dir).agencies.where("agency_type = 'k12'")
    total = k12.agg(F.count("*").alias("total"))  # one row
    return k12.groupBy("agency_state").agg(F.count("*").alias("agencies")).join(F.broadcast(total))


@query("a10_agency_activity", "select agency_id, agency, agency_type, website, agency_state, count(id) filter (where status = 'open') open_count, count(id) total_count, max(due_at) last_due from ag left join opp using (agency_id) group by all order by open_count desc, agency, agency_id limit 100")
def a10_agency_activity(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return coverage.agency_activity(t.agencies, t.opportunities).select("agency_id", "agency", "agency_type", "website", "agency_state", "open_count", "total_count", "last_due")


_PEOPLE_SQL = ", people as (select event_id person_id, user_id agency_id, event_type || ' ' || user_id full_name, event_type title, (72 + json_extract_string(props, '$.k')::int % 17)::int confidence from events)"


def _people(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return t.raw("events").select(F.col("event_id").alias("person_id"), F.col("user_id").alias("agency_id"), F.concat("event_type", F.lit(" "), "user_id").alias("full_name"), F.col("event_type").alias("title"), (72 + k % 17).cast("int").alias("confidence"))


@query("a11_top_people", f"{_PEOPLE_SQL}, r as (select *, row_number() over (partition by agency_id order by confidence desc, full_name, person_id)::int rank from people) select * from r where rank <= 6")
def a11_top_people(spark, sf_dir):
    return coverage.top_people(_people(Tables(spark, sf_dir)))


@query("a11_people_json", f"{_PEOPLE_SQL}, r as (select *, row_number() over (partition by agency_id order by confidence desc, full_name, person_id)::int rank from people) select agency_id, to_json(list({{'rank': rank, 'full_name': full_name, 'title': title, 'confidence': confidence}} order by rank))::varchar people from r where rank <= 6 group by 1")
def a11_people_json(spark, sf_dir):
    return coverage.people_json(_people(Tables(spark, sf_dir)))


@query("a12_vertical_totals", f"{_PEOPLE_SQL} select agency_type, count(*) total, count(website) with_website, count(*) filter (where agency_id in (select agency_id from people)) enriched from ag group by 1")
def a12_vertical_totals(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return coverage.vertical_totals(t.agencies, _people(t))


@query("j12_reconcile_names", ", inc as (select agency || case when agency_id % 4 = 0 then ' new' else '' end as name from ag where agency_id % 2 = 0), u as (select lower(agency) nm, count(*) n, min(agency_id) aid from ag group by 1) select name, case when n is null then 'insert' when n = 1 then 'update' else 'ambiguous' end as action, case when n = 1 then aid end agency_id from inc left join u on lower(name) = nm")
def j12_reconcile_names(spark, sf_dir):
    stored = Tables(spark, sf_dir).agencies
    incoming = stored.where("agency_id % 2 = 0").select(F.concat("agency", F.when(F.col("agency_id") % 4 == 0, " new").otherwise("")).alias("name"))
    return cdc.reconcile_names(stored, incoming)


# -- snapshots ------------------------------------------------------------------------------------
# Stored: orders whose key is not 1 modulo 5; snapshot: those not 2 modulo 5, some of them changed.

_SNAPSHOTS = """, stored as (select *, md5(id || ':' || title || ':' || round(estimated_value)::bigint) content_hash from opp where id % 5 <> 1),
inc0 as (select * replace (case when id % 7 = 0 then title || ' revised' else title end as title, case when id % 11 = 0 then 'closed' else status end as status, case when id % 13 = 0 then estimated_value + 1000 else estimated_value end as estimated_value) from opp where id % 5 <> 2),
incoming as (select *, md5(id || ':' || title || ':' || round(estimated_value)::bigint) content_hash from inc0)"""
_TRACKED = ["title", "status", "estimated_value"]


def _snapshots(t: Tables) -> tuple[DataFrame, DataFrame]:
    digest = F.md5(F.concat_ws(":", F.col("id").cast("string"), "title", F.round("estimated_value").cast("long").cast("string")))
    stored = t.opportunities.where("id % 5 <> 1").withColumn("content_hash", digest)
    changed = t.opportunities.where("id % 5 <> 2").withColumns({
        "title": F.when(F.col("id") % 7 == 0, F.concat("title", F.lit(" revised"))).otherwise(F.col("title")),
        "status": F.when(F.col("id") % 11 == 0, "closed").otherwise(F.col("status")),
        "estimated_value": F.when(F.col("id") % 13 == 0, F.col("estimated_value") + 1000).otherwise(F.col("estimated_value")),
    })
    return stored, changed.withColumn("content_hash", digest)


_CLASSES = ", cls as (select coalesce(s.id, i.id) id, case when s.id is null then 'new' when i.id is null then 'absent' when s.content_hash <> i.content_hash then 'changed' else 'unchanged' end as change from stored s full join incoming i on s.id = i.id)"


@query("m3_classified_changes", f"{_SNAPSHOTS}{_CLASSES} select id, change from cls")
def m3_classified_changes(spark, sf_dir):
    return cdc.classify(*_snapshots(Tables(spark, sf_dir)))


@query("m4_field_changes", f"{_SNAPSHOTS}, d as (select s.id, array_to_string(list_filter([case when s.title is distinct from i.title then 'title' end, case when s.status is distinct from i.status then 'status' end, case when s.estimated_value is distinct from i.estimated_value then 'estimated_value' end], lambda x: x is not null), ',') fields from stored s join incoming i on s.id = i.id where s.content_hash <> i.content_hash) select id, fields, case when fields = '' then 'record changed' else 'changed: ' || replace(fields, ',', ', ') end summary from d")
def m4_field_changes(spark, sf_dir):
    return cdc.field_changes(*_snapshots(Tables(spark, sf_dir)), _TRACKED)


@query("m6_merged_and_closed", f"{_SNAPSHOTS} select id, title, status, timestamp '1997-01-01' first_seen_at, timestamp '1998-01-01' last_seen_at from incoming where id in (select id from stored) union all select id, title, status, timestamp '1998-01-01', timestamp '1998-01-01' from incoming where id not in (select id from stored) union all select id, title, 'closed', timestamp '1997-01-01', timestamp '1997-01-01' from stored where id not in (select id from incoming)")
def m6_merged_and_closed(spark, sf_dir):
    stored, incoming = _snapshots(Tables(spark, sf_dir))
    before, now = F.to_timestamp(F.lit("1997-01-01")), F.to_timestamp(F.lit("1998-01-01"))
    seen = stored.withColumns({"first_seen_at": before, "last_seen_at": before})
    merged = cdc.merge(seen, incoming, now, close_missing=True)
    return merged.select("id", "title", "status", "first_seen_at", "last_seen_at")


@query("m7_closed_by_watermark", "select id, case when status = 'open' and due_at - interval 30 day < timestamp '1998-06-01' then 'closed' else status end status from opp")
def m7_closed_by_watermark(spark, sf_dir):
    records = Tables(spark, sf_dir).opportunities.withColumn("last_seen_at", F.col("due_at") - F.expr("interval 30 days"))
    return cdc.close_stale(records, F.to_timestamp(F.lit("1998-06-01"))).select("id", "status")


@query("m8_merged_people", f"{_PEOPLE_SQL}, o as (select agency_id, title, min(case when person_id % 3 = 0 then full_name end) email, min(full_name) phone, max(confidence) confidence from people where person_id % 2 = 0 group by 1, 2), n as (select agency_id, title, min(case when person_id % 5 = 0 then full_name end) email, null::varchar phone, max(confidence) confidence from people where person_id % 2 = 1 group by 1, 2) select coalesce(n.agency_id, o.agency_id) agency_id, coalesce(n.title, o.title) title, coalesce(n.email, o.email) email, coalesce(n.phone, o.phone) phone, greatest(n.confidence, o.confidence) confidence from o full join n on o.agency_id = n.agency_id and o.title = n.title")
def m8_merged_people(spark, sf_dir):
    people = _people(Tables(spark, sf_dir))
    pick = lambda odd, step: people.where(F.col("person_id") % 2 == odd).groupBy("agency_id", "title").agg(F.min(F.when(F.col("person_id") % step == 0, F.col("full_name"))).alias("email"), F.min("full_name").alias("phone"), F.max("confidence").alias("confidence"))
    return cdc.merge_people(pick(0, 3), pick(1, 5).withColumn("phone", F.lit(None).cast("string")), ["agency_id", "title"])


@query("m12_run_log", f"{_SNAPSHOTS}{_CLASSES} select count(*) filter (where change = 'new') new_records, count(*) filter (where change = 'changed') changed_records, count(*) filter (where change = 'unchanged') unchanged_records, count(*) filter (where change = 'absent') absent_records from cls")
def m12_run_log(spark, sf_dir):
    return cdc.run_log(cdc.classify(*_snapshots(Tables(spark, sf_dir))))


@query("u1_last_wins", "select user_id, event_type, max_by(value, event_id) as value, min(event_id) first_position from events group by 1, 2")
def u1_last_wins(spark, sf_dir):
    rows = cdc.last_wins(Tables(spark, sf_dir).raw("events"), ["user_id", "event_type"], "event_id")
    return rows.select("user_id", "event_type", "value", "first_position")


@query("u2_first_wins", "select user_id, event_type, min_by(value, event_id) as value, min(event_id) event_id from events group by 1, 2")
def u2_first_wins(spark, sf_dir):
    return cdc.first_wins(Tables(spark, sf_dir).raw("events"), ["user_id", "event_type"], "event_id").select("user_id", "event_type", "value", "event_id")


@query("u3_most_certain_wins", f"{_PEOPLE_SQL}, r as (select *, row_number() over (partition by full_name order by confidence desc, person_id) k from people) select full_name, confidence, person_id from r where k = 1")
def u3_most_certain_wins(spark, sf_dir):
    return cdc.most_certain_wins(_people(Tables(spark, sf_dir)), ["full_name"], "confidence", "person_id").select("full_name", "confidence", "person_id")


# -- evidence -------------------------------------------------------------------------------------
# The tables hold no procurement vocabulary; these run the same machinery on words that occur.

_LINES = ", ln as (select doc_id, unnest(range(1, len(string_split_regex(text, '\\r?\\n')) + 1)) line, unnest(string_split_regex(text, '\\r?\\n')) raw from documents), nl as (select doc_id, line, trim(regexp_replace(raw, '[\\s]+', ' ', 'g')) content from ln where trim(regexp_replace(raw, '[\\s]+', ' ', 'g')) <> '')"


@query("e1_numbered_lines", f"{_LINES} select doc_id, line, content from nl")
def e1_numbered_lines(spark, sf_dir):
    return evidence.lines(Tables(spark, sf_dir).raw("documents")).withColumn("line", F.col("line").cast("long"))


_WORDS = (("license", text.worded("license[a-z]*"), 0, ()), ("mail", evidence.EMAIL, 0, ()), ("long_line", "(?s)^.*$", 0, (text.worded("the|der|le|la"), "(?i)tion")))


@query("e2_line_facts", _LINES + """, f as (select doc_id, line, 0 rank, 'license' fact_type, regexp_extract(content, '(?i)\\b(license[a-z]*)\\b', 1) as value from nl union all select doc_id, line, 1, 'mail', regexp_extract(content, '(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\\.[A-Z]{2,}', 0) from nl
 union all select doc_id, line, 2, 'long_line', content from nl where regexp_matches(content, '(?i)(^|[^A-Za-z0-9_])(the|der|le|la)($|[^A-Za-z0-9_])') and regexp_matches(content, '(?i)tion')),
 d as (select *, row_number() over (partition by doc_id, fact_type, lower(value) order by line, rank) k from f where value <> ''), p as (select *, row_number() over (partition by doc_id order by line, rank) place from d where k = 1) select doc_id, line, fact_type, value from p where place <= 30""")
def e2_line_facts(spark, sf_dir):
    found = evidence.facts(evidence.lines(Tables(spark, sf_dir).raw("documents")), rules=_WORDS)
    return found.withColumn("line", F.col("line").cast("long"))


@query("e4_requirement_lines", _LINES + """, c as (select * from nl where length(content) between 25 and 600 and regexp_matches(content, '(?i)(^|[^A-Za-z0-9_])(license[a-z]*|the|der|que)($|[^A-Za-z0-9_])')),
 d as (select *, row_number() over (partition by doc_id, lower(content) order by line) k from c), p as (select *, row_number() over (partition by doc_id order by line) place from d where k = 1)
 select doc_id, line, case when regexp_matches(content, '(?i)bond|bonding') then 'bonding' when regexp_matches(content, '(?i)insurance|insured') then 'insurance' when regexp_matches(content, '(?i)certif|license|registration') then 'certification' when regexp_matches(content, '(?i)delivery|period of performance|completion date') then 'performance'
 when regexp_matches(content, '(?i)technical|specification|scope of work|statement of work') then 'technical' when regexp_matches(content, '(?i)price|pricing|cost') then 'pricing' when regexp_matches(content, '(?i)site visit|pre[- ]bid|preproposal|pre-proposal') then 'site_visit' else 'submission_requirement' end category, content requirement from p where place <= 40""")
def e4_requirement_lines(spark, sf_dir):
    found = evidence.requirements(evidence.lines(Tables(spark, sf_dir).raw("documents")), modal=text.worded("license[a-z]*|the|der|que"))
    return found.withColumn("line", F.col("line").cast("long"))


@query("e7_page_links", """, a as (select page_id, unnest(range(len(regexp_extract_all(html, '(?is)<a\\b[^>]*href=["'']([^"'']+)["''][^>]*>(.*?)</a>', 1)))) pos, unnest(regexp_extract_all(html, '(?is)<a\\b[^>]*href=["'']([^"'']+)["''][^>]*>(.*?)</a>', 1)) href from pages),
 f as (select page_id, href, min(pos) pos from a where regexp_matches(href, '(?i)th|le|de') group by 1, 2), r as (select page_id, row_number() over (partition by page_id order by pos)::int place, href from f) select * from r where place <= 6""")
def e7_page_links(spark, sf_dir):
    """Labels equal their targets on these pages."""
    return evidence.links(Tables(spark, sf_dir).raw("pages"), terms="(?i)th|le|de")


@query("e6_page_contacts")
def e6_page_contacts(spark, sf_dir):
    spotted = (("Any", text.worded("the|le|der|la")),)
    return evidence.contacts(evidence.page_lines(Tables(spark, sf_dir).raw("pages")), rules=spotted)


_REQUIREMENTS_SQL = ", rq as (select l_orderkey opportunity_id, case l_linenumber % 6 when 0 then 'bonding' when 1 then 'certification' when 2 then 'technical' when 3 then 'insurance' when 4 then 'site_visit' else 'pricing' end category, case l_linenumber % 6 when 0 then 'bond of $' || (round(l_extendedprice)::bigint) else p_name || ' ' || p_type end requirement, round(l_extendedprice)::bigint amount from lineitem join part on l_partkey = p_partkey)"


def _requirements(t: Tables) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, ("bonding", "certification", "technical", "insurance", "site_visit", "pricing"))), F.pmod("l_linenumber", F.lit(6)).cast("int") + 1)
    joined = t.raw("lineitem").join(t.raw("part"), F.col("l_partkey") == F.col("p_partkey"))
    words = F.when(F.pmod("l_linenumber", F.lit(6)) == 0, F.concat(F.lit("bond of $"), F.round("l_extendedprice").cast("long"))).otherwise(F.concat("p_name", F.lit(" "), "p_type"))
    return joined.select(F.col("l_orderkey").alias("opportunity_id"), kind.alias("category"), words.alias("requirement"))


@query("k8_go_no_go", _REQUIREMENTS_SQL + """, o as (select opportunity_id, case when category = 'bonding' then case when amount <= 40000 then 'confirmed' else 'exceeds' end when category = 'certification' then case when requirement like '%ring%' or lower(requirement) like '%economy%' then 'confirmed' else 'risk' end when category in ('insurance', 'site_visit') then 'unknown' when category = 'technical' then case when requirement like '%ring%' or lower(requirement) like '%economy%' then 'confirmed' else 'unknown' end end outcome from rq),
 c as (select opportunity_id, count(*) filter (where outcome = 'confirmed') confirmed, count(*) filter (where outcome in ('exceeds', 'risk')) risks, count(*) filter (where outcome = 'unknown') as unknown, coalesce(bool_or(outcome = 'exceeds'), false) x from o group by 1)
 select opportunity_id, confirmed, risks, unknown, case when x then 'NO-GO' when risks > 0 then 'REVIEW' when confirmed > 0 then 'GO' else 'REVIEW' end verdict, case when confirmed + risks > 0 then round(100.0 * confirmed / (confirmed + risks))::int end score from c""")
def k8_go_no_go(spark, sf_dir):
    return decision.go_no_go(_requirements(Tables(spark, sf_dir)), ("ring", "Economy", "ab"), 40_000.0)


# -- queue ----------------------------------------------------------------------------------------

_JOBS_SQL = """, jobs as (select event_id id, event_id document_id, 'extract' stage, user_id opportunity_id, case event_type when 'click' then 'pending' when 'view' then 'leased' when 'error' then 'dead' when 'purchase' then 'done' else 'pending' end state,
 (event_id % 7)::int priority, (json_extract_string(props, '$.k')::int % 12)::int attempts, 8 max_attempts, date_trunc('second', ts) run_after, date_trunc('second', ts) + interval 10 minute leased_until, case when event_id % 3 = 0 then 'earlier' end last_error from events)"""


def _jobs(t: Tables) -> DataFrame:
    state = F.when(F.col("event_type") == "view", "leased").when(F.col("event_type") == "error", "dead").when(F.col("event_type") == "purchase", "done").otherwise("pending")
    at = F.date_trunc("second", "ts")
    return t.raw("events").select(
        F.col("event_id").alias("id"), F.col("event_id").alias("document_id"), F.lit("extract").alias("stage"), F.col("user_id").alias("opportunity_id"), state.alias("state"),
        (F.col("event_id") % 7).cast("int").alias("priority"), (F.get_json_object("props", "$.k").cast("int") % 12).alias("attempts"), F.lit(8).alias("max_attempts"),
        at.alias("run_after"), (at + F.expr("interval 10 minutes")).alias("leased_until"), F.when(F.col("event_id") % 3 == 0, "earlier").alias("last_error"),
    )


_NOW = views.datetime(2024, 1, 15)
_WAIT = "timestamp '2024-01-15' + to_seconds(least(600, pow(2, attempts))::bigint)"


@query("q3_expired_leases", f"{_JOBS_SQL}, x as (select *, state = 'leased' and leased_until < timestamp '2024-01-15' gone from jobs) select id, case when gone and attempts >= max_attempts then 'dead' when gone then 'pending' else state end state, case when gone then {_WAIT} else run_after end run_after, case when not gone then leased_until end leased_until, case when gone then coalesce(last_error, 'lease expired') else last_error end last_error from x")
def q3_expired_leases(spark, sf_dir):
    return queue.expire_leases(_jobs(Tables(spark, sf_dir)), _NOW).select("id", "state", "run_after", "leased_until", "last_error")


@query("q4_retried_jobs", f"{_JOBS_SQL}, x as (select *, case when id % 10 = 0 then 'http_404' when id % 10 = 1 then 'timeout' end error from jobs) select id, case when error = 'http_404' then 'dead' when error is null then state when attempts >= max_attempts then 'dead' else 'pending' end state, case when error = 'http_404' then max_attempts else attempts end attempts, case when error = 'timeout' then {_WAIT} else run_after end run_after, case when error is null then leased_until end leased_until, coalesce(error, last_error) last_error from x")
def q4_retried_jobs(spark, sf_dir):
    jobs = _jobs(Tables(spark, sf_dir))
    failures = jobs.where("id % 10 < 2").select("id", F.when(F.col("id") % 10 == 0, "http_404").otherwise("timeout").alias("error"))
    return queue.retry(jobs, failures, _NOW).select("id", "state", "attempts", "run_after", "leased_until", "last_error")


@query("q2_claimed_jobs", f"{_JOBS_SQL} select id, 'leased' state, priority, attempts + 1 attempts, run_after, timestamp '2024-01-15 00:10:00' leased_until, 'w1' lease_owner from jobs where state = 'pending' and run_after <= timestamp '2024-01-15' order by priority, run_after, id limit 24")
def q2_claimed_jobs(spark, sf_dir):
    return queue.claim(_jobs(Tables(spark, sf_dir)), _NOW, 24, "w1").select("id", "state", "priority", "attempts", "run_after", "leased_until", "lease_owner")


def _enqueue_sql(kept: str, revive: bool) -> str:
    attempts = "case when j.id is null then 0 " + ("when w.document_id is not null and state = 'dead' then 0 " if revive else "") + "else attempts end"
    return f"{_JOBS_SQL}, w as (select event_id + 5 document_id, 'extract' stage, 3 asked from events where event_id % 2 = 0) select coalesce(j.document_id, w.document_id) document_id, coalesce(j.stage, w.stage) stage, case when j.id is not null and (w.document_id is null or {kept}) then state else 'pending' end state, least(priority, asked) priority, {attempts} attempts from jobs j full join w on j.document_id = w.document_id and j.stage = w.stage"


def _enqueued(policy: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark, sf_dir):
        t = Tables(spark, sf_dir)
        wanted = t.raw("events").where("event_id % 2 = 0").select((F.col("event_id") + 5).alias("document_id"), F.lit("extract").alias("stage"), F.lit(3).alias("priority"))
        return queue.enqueue(_jobs(t), wanted, policy)

    return run


query("q1_enqueue_continue", _enqueue_sql("state in ('done', 'leased')", False))(_enqueued("continue"))
query("q1_enqueue_force", _enqueue_sql("false", True))(_enqueued("force"))
query("q1_enqueue_force_extract", _enqueue_sql("state = 'done'", False))(_enqueued("force_extract"))
query("q1_enqueue_package", _enqueue_sql("state in ('done', 'leased')", True))(_enqueued("package"))


@query("q6_expired_for_closed", f"{_JOBS_SQL} select id, case when state = 'pending' and opportunity_id in (select id from opp where status = 'closed') then 'dead' else state end state, case when state = 'pending' and opportunity_id in (select id from opp where status = 'closed') then 'opportunity_closed_or_expired' else last_error end last_error from jobs")
def q6_expired_for_closed(spark, sf_dir):
    t = Tables(spark, sf_dir)
    closed = t.opportunities.where("status = 'closed'").select(F.col("id").alias("opportunity_id"))
    return queue.expire_for_closed(_jobs(t), closed).select("id", "state", "last_error")


@query("q10_shard_of_hour", "select registry_state from src where source_id % 5 = 13 % 5")
def q10_shard_of_hour(spark, sf_dir):
    return Tables(spark, sf_dir).sources.where(queue.shard_of_hour(F.col("source_id"), 13)).select("registry_state")


@query("q11_stale_agencies", ", r as (select user_id agency_id, max(ts) last_run from events group by 1) select agency_id from ag left join r using (agency_id) where last_run is null or last_run < timestamp '2024-02-20' - interval 30 day")
def q11_stale_agencies(spark, sf_dir):
    t = Tables(spark, sf_dir)
    runs = t.raw("events").groupBy(F.col("user_id").alias("agency_id")).agg(F.max("ts").alias("last_run"))
    return t.agencies.join(runs, "agency_id", "left").where(queue.is_stale(F.col("last_run"), views.datetime(2024, 2, 20))).select("agency_id")


@query("d2_candidates", ", c as (select id, adapter_key, due_at from cur where id not in (select opportunity_id from doc where part_key % 2 = 0)), r as (select *, row_number() over (partition by adapter_key order by due_at nulls last, id)::int rank from c) select * from r where rank <= 20")
def d2_candidates(spark, sf_dir):
    """Records without some kind of document, a few of each source, soonest due first."""
    t = Tables(spark, sf_dir)
    have = t.documents.where("part_key % 2 = 0").select(F.col("opportunity_id").alias("id"))
    return queue.candidates(t.current().join(have, "id", "left_anti").select("id", "adapter_key", "due_at"), "adapter_key")


# -- scalar functions -----------------------------------------------------------------------------


@query("x18_stable_ids", ", h as (select adapter_key, sha256(adapter_key) h from src) select adapter_key, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', (strpos('0123456789abcdef', substr(h, 17, 1)) - 1)::int % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) as source_uuid from h")
def x18_stable_ids(spark, sf_dir):
    return Tables(spark, sf_dir).sources.select("adapter_key", text.stable_uuid(F.col("adapter_key")).alias("source_uuid"))


@query("t22_shown_dates", "select id, coalesce(strftime(due_at, '%b %-d, %Y'), 'Not stated') due from opp")
def t22_shown_dates(spark, sf_dir):
    return Tables(spark, sf_dir).opportunities.select("id", dates.shown(F.col("due_at")).alias("due"))


@query("o3_decision_order", "select distinct p_name, p_type, case when regexp_matches(lower(p_name), '(rfp|rfq|ifb|itb|solicitation|request for proposal|request for quote|invitation to bid)') then 0 when regexp_matches(lower(p_name), '(spec|scope|statement of work|sow|requirements|general conditions|special conditions)') then 1 when regexp_matches(lower(p_name), '(addendum|amendment|questions|answers|q&a)') then 2 when regexp_matches(lower(p_type), '(solicitation|spec|addendum|amendment)') then 3 else 9 end::int as rank from (select p_name || case p_partkey % 5 when 0 then ' Q&A' when 1 then ' General Conditions' when 2 then ' ITB' else '' end p_name, p_type || case when p_partkey % 7 = 0 then ' Spec' else '' end p_type from part)")
def o3_decision_order(spark, sf_dir):
    number = F.col("p_partkey")
    name = F.concat("p_name", F.when(number % 5 == 0, " Q&A").when(number % 5 == 1, " General Conditions").when(number % 5 == 2, " ITB").otherwise(""))
    kind = F.concat("p_type", F.when(number % 7 == 0, " Spec").otherwise(""))
    named = Tables(spark, sf_dir).raw("part").select(name.alias("p_name"), kind.alias("p_type"))
    return named.select("p_name", "p_type", queue.decision_order(F.col("p_name"), F.col("p_type")).alias("rank")).distinct()


@query("k8_host_class", ", keys as (select source_id, source_family, case source_id % 4 when 0 then 'sam_gov' when 1 then 'opengov_' || registry_state when 2 then adapter_key else 'x_ionwave' end adapter_key from src) select source_id, adapter_key, case when adapter_key = 'sam_gov' then 'sam' when contains(adapter_key, 'opengov') then 'opengov' when contains(adapter_key, 'ionwave') then 'ionwave' when source_family = 'sled' then 'sled' else 'other' end host_class from keys")
def k8_host_class(spark, sf_dir):
    number = F.col("source_id") % 4
    key = F.when(number == 0, "sam_gov").when(number == 1, F.concat(F.lit("opengov_"), "registry_state")).when(number == 2, F.col("adapter_key")).otherwise("x_ionwave")
    keyed = Tables(spark, sf_dir).sources.withColumn("adapter_key", key)
    return keyed.select("source_id", "adapter_key", classify.host_class(F.col("adapter_key"), F.col("source_family")).alias("host_class"))


@query("j14_source_states", ", keys as (select source_id, source_family, case source_id % 6 when 0 then 'indiana_idoa' when 1 then 'tennessee_cpo_public' when 2 then 'periscope_il' when 3 then 'plain' else adapter_key end adapter_key from src), r as (select unnest(['IN', 'TN', 'IL', '03', '04', '05', '10']) state) select state, source_id, adapter_key from keys join r on ends_with(adapter_key, '_' || lower(state)) or state = 'IN' and adapter_key = 'indiana_idoa' or state = 'TN' and adapter_key = 'tennessee_cpo_public' where source_family = 'sled' or adapter_key in ('indiana_idoa', 'tennessee_cpo_public') or starts_with(adapter_key, 'periscope_') or starts_with(adapter_key, 'jaggaer_') or starts_with(adapter_key, 'peoplesoft_')")
def j14_source_states(spark, sf_dir):
    number = F.col("source_id") % 6
    key = F.when(number == 0, "indiana_idoa").when(number == 1, "tennessee_cpo_public").when(number == 2, "periscope_il").when(number == 3, "plain").otherwise(F.col("adapter_key"))
    keyed = Tables(spark, sf_dir).sources.withColumn("adapter_key", key).where(coverage.is_state_source(F.col("adapter_key"), F.col("source_family")))
    registry = spark.createDataFrame([(x,) for x in ("IN", "TN", "IL", "03", "04", "05", "10")], "state string")
    joined = keyed.join(F.broadcast(registry), coverage.source_state(F.col("adapter_key")) == F.lower("state"))
    return joined.select("state", "source_id", "adapter_key")


@query("o3_document_order", "select distinct p_name, case when regexp_matches(p_name, '(?i)solicitation|rfp|rfq|ifb|invitation') then 0 when regexp_matches(p_name, '(?i)spec|scope|statement of work|sow') then 1 when regexp_matches(p_name, '(?i)addend|amend') then 2 when regexp_matches(p_name, '(?i)price|bid form|pricing') then 3 else 9 end::int as rank from part")
def o3_document_order(spark, sf_dir):
    return Tables(spark, sf_dir).raw("part").select("p_name", queue.document_order(F.col("p_name")).alias("rank")).distinct()


# -- further aggregates, windows and catalog steps --------------------------------------------------


@query("a13_job_counts", f"{_JOBS_SQL} select opportunity_id, count(*) filter (where state in ('pending', 'leased')) active, count(*) filter (where state = 'dead') dead from jobs group by 1")
def a13_job_counts(spark, sf_dir):
    return queue.job_counts(_jobs(Tables(spark, sf_dir)))


@query("a14_discovery_by_source", "select adapter_key, count(*) scanned, count(*) filter (where identified > 0) with_documents, coalesce(sum(identified), 0)::bigint documents from cur left join ds on id = opportunity_id group by 1")
def a14_discovery_by_source(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return coverage.discovery_by_source(inventory.with_document_state(t.current(), t.documents))


@query("a17_reconciled_sweeps", "select user_id source_id, count(*) n_rows, count(distinct event_type) n_ids, max(event_id % 5) + 1 reported, count(*) = max(event_id % 5) + 1 and count(distinct event_type) = max(event_id % 5) + 1 complete from events group by 1")
def a17_reconciled_sweeps(spark, sf_dir):
    """A sweep is complete when rows, distinct ids and the reported number agree."""
    sweeps = Tables(spark, sf_dir).raw("events").groupBy(F.col("user_id").alias("source_id")).agg(
        F.count("*").alias("n_rows"), F.countDistinct("event_type").alias("n_ids"), (F.max(F.col("event_id") % 5) + 1).alias("reported")
    )
    return sweeps.withColumn("complete", cdc.is_complete(F.col("reported"), F.col("n_rows"), F.col("n_ids")))


@query("j3_sources_without_records", "select source_id, adapter_key from src where source_id not in (select source_id from opp where status = 'open' and estimated_value > 480000)")
def j3_sources_without_records(spark, sf_dir):
    t = Tables(spark, sf_dir)
    busy = t.opportunities.where((F.col("status") == "open") & (F.col("estimated_value") > 480_000))
    return t.sources.join(busy, "source_id", "left_anti").select("source_id", "adapter_key")


@query("m5_carried_codes", f"{_SNAPSHOTS} select i.id, array_to_string(case when len(i.codes) = 0 then coalesce(s.naics_codes, []) else i.codes end, ',') codes from (select id, case when id % 3 = 0 then [] else naics_codes end codes from incoming) i left join stored s on i.id = s.id")
def m5_carried_codes(spark, sf_dir):
    stored, incoming = _snapshots(Tables(spark, sf_dir))
    emptied = incoming.withColumn("naics_codes", F.when(F.col("id") % 3 == 0, F.array().cast("array<string>")).otherwise(F.col("naics_codes")))
    return cdc.carried_forward(emptied.select("id", "naics_codes"), stored, "naics_codes").select("id", F.array_join("naics_codes", ",").alias("codes"))


@query("m14_absent_inserts", "select distinct l_orderkey id, p_name target from lineitem join part on l_partkey = p_partkey where l_linenumber % 2 = 0 except select l_orderkey, p_name from lineitem join part on l_partkey = p_partkey where l_linenumber % 2 = 1")
def m14_absent_inserts(spark, sf_dir):
    t = Tables(spark, sf_dir)
    named = t.raw("lineitem").join(t.raw("part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("id"), F.col("p_name").alias("target"), (F.col("l_linenumber") % 2).alias("odd"))
    return documents.insert_absent(named.where("odd = 1"), named.where("odd = 0").select("id", "target"), ["id", "target"])


@query("q7_revived_documents", "select l_orderkey id, l_linenumber line_number, case when l_linenumber = n.l2 and extraction_status = 'fetch_failed' then 'cataloged' else extraction_status end extraction_status from (select l_orderkey, l_linenumber, case when l_linestatus = 'F' then 'analyzed' else 'fetch_failed' end extraction_status from lineitem) d left join (select distinct l_orderkey k2, l_linenumber l2 from lineitem where l_returnflag = 'A') n on l_orderkey = k2 and l_linenumber = l2")
def q7_revived_documents(spark, sf_dir):
    lines = Tables(spark, sf_dir).raw("lineitem").withColumnsRenamed({"l_orderkey": "id", "l_linenumber": "line_number"})
    stored = lines.select("id", "line_number", F.lit("old").alias("source_url"), F.when(F.col("l_linestatus") == "F", "analyzed").otherwise("fetch_failed").alias("extraction_status"))
    fresh = lines.where("l_returnflag = 'A'").select("id", "line_number", F.lit("new").alias("source_url"))
    return documents.refresh(stored, fresh, ["id", "line_number"]).select("id", "line_number", "extraction_status")


@query("w4_line_context", "select conv_id, turn, array_to_string(list(role) over (partition by conv_id order by turn rows between 2 preceding and 3 following), ' ') near from conversations")
def w4_line_context(spark, sf_dir):
    """Two turns before to three after."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-2, 3)
    return Tables(spark, sf_dir).raw("conversations").select("conv_id", "turn", F.array_join(F.collect_list("role").over(w), " ").alias("near"))


@query("w5_carried_rows", ", w as (select user_id page, event_id as position, case when event_type = 'signup' then event_id end bid, event_type title from events), c as (select *, last_value(bid ignore nulls) over (partition by page order by position rows unbounded preceding) b from w) select page, b::varchar bid_number, max(case when bid is not null then title end) title, count(*) filter (where bid is null)::int addenda from c where b is not null group by 1, 2")
def w5_carried_rows(spark, sf_dir):
    """Rows without a number belong to the last numbered row above them."""
    number = F.when(F.col("event_type") == "signup", F.col("event_id").cast("string"))
    rows = Tables(spark, sf_dir).raw("events").select(F.col("user_id").alias("page"), F.col("event_id").alias("position"), number.alias("bid_number"), F.col("event_type").alias("title"))
    return landed.with_addenda(rows, "page").withColumn("addenda", F.size("addenda"))


@query("f15_public_hosts", "select page_id, regexp_extract(url, '^https?://([^/:?#]+)', 1) host from pages where url ilike 'http%' and not regexp_matches(lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)), '^localhost$|\\.local$|^127\\.|^10\\.|^192\\.168\\.|^169\\.254\\.')")
def f15_public_hosts(spark, sf_dir):
    pages = Tables(spark, sf_dir).raw("pages").where(documents.is_public(F.col("url")))
    return pages.select("page_id", documents.host(F.col("url")).alias("host"))


@query("d1_page_documents")
def d1_page_documents(spark, sf_dir):
    return documents.page_documents(Tables(spark, sf_dir).raw("pages"))


@query("d5_payload_links", ", l as (select id, unnest(list_distinct(list_transform(naics_codes, lambda c: case when c like '%1%' then 'https://x.org/' || c else c end))) target from opp) select * from l where regexp_matches(target, '(?i)^https?://')")
def d5_payload_links(spark, sf_dir):
    link = F.transform("naics_codes", lambda c: F.when(c.contains("1"), F.concat(F.lit("https://x.org/"), c)).otherwise(c))
    return documents.payload_links(Tables(spark, sf_dir).opportunities.withColumn("resource_links", link))


@query("p9_snapshot_hashes", """select id, sha256('{"due_at":"' || strftime(due_at, '%Y-%m-%dT%H:%M:%S') || '.000Z","status":"' || status || '","title":"' || title || '"}') content_hash from opp""")
def p9_snapshot_hashes(spark, sf_dir):
    return Tables(spark, sf_dir).opportunities.select("id", text.content_hash("title", "status", "due_at").alias("content_hash"))


@query("x4_agency_paths", "select p_partkey, trim(p_name) agency from part")
def x4_agency_paths(spark, sf_dir):
    path = F.concat(F.col("p_brand"), F.lit(" . "), F.col("p_type"), F.lit("."), F.col("p_name"), F.lit(". "))
    return Tables(spark, sf_dir).raw("part").select("p_partkey", text.agency_name(path, F.col("p_type"), F.lit(None), F.lit(None)).alias("agency"))


@query("x19_money", "select l_orderkey, l_linenumber, l_partkey, (round(l_extendedprice)::bigint * case l_linenumber % 3 when 0 then 1000000 when 1 then 1000 else 1 end)::double amount from lineitem")
def x19_money(spark, sf_dir):
    unit = F.when(F.col("l_linenumber") % 3 == 0, " million").when(F.col("l_linenumber") % 3 == 1, "k").otherwise(" flat")
    words = F.concat(F.lit("a bond of $ "), F.format_number(F.round("l_extendedprice"), 0), unit, F.lit(" in all"))
    return Tables(spark, sf_dir).raw("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", text.money(words).alias("amount"))
