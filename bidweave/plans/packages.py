"""Further registered queries: packages, agencies, profiles and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import agencies, packages
from .catalog import Tables, query
from .views import AS_OF

_NAMES = ", nm as (select p_partkey, p_name || case p_partkey % 4 when 0 then '+v2 (final).PDF' when 1 then ' #1/2&3.docx' when 2 then '  é  x.pdf' else '.zip' end as value from part)"


def _names(spark, sf_dir):
    n = F.col("p_partkey") % 4
    return Tables(spark, sf_dir).raw("part").select("p_partkey", F.concat("p_name", F.when(n == 0, "+v2 (final).PDF").when(n == 1, " #1/2&3.docx").when(n == 2, "  é  x.pdf").otherwise(".zip")).alias("value"))


@query("x8_safe_filenames", f"{_NAMES}, s as (select p_partkey, trim(regexp_replace(regexp_replace(replace(value, '+', ' '), '[^a-zA-Z0-9._() -]+', '-', 'g'), '\\s+', ' ', 'g')) safe from nm) select p_partkey, case when safe = '' then 'document' else safe end safe, lower(case when safe = '' then 'document' else safe end) normalized from s")
def x8_safe_filenames(spark, sf_dir):
    value = F.col("value")
    return _names(spark, sf_dir).select("p_partkey", packages.safe_filename(value).alias("safe"), packages.normalized_filename(value).alias("normalized"))


@query("x9_disposition_names", "select p_partkey, case p_partkey % 3 when 0 then p_name || '.pdf' when 1 then p_name || '+1.pdf' end as filename from part")
def x9_disposition_names(spark, sf_dir):
    n = F.col("p_partkey") % 3
    plain = F.concat(F.lit('attachment; filename="'), "p_name", F.lit('.pdf"'))
    coded = F.concat(F.lit("attachment; filename=x; FILENAME*=utf-8''"), F.replace("p_name", F.lit(" "), F.lit("%20")), F.lit("+1.pdf; size=9"))
    header = F.when(n == 0, plain).when(n == 1, coded).otherwise("inline")
    return Tables(spark, sf_dir).raw("part").select("p_partkey", packages.disposition_filename(header).alias("filename"))


@query("w3_latest_profiles", ", p as (select *, row_number() over (partition by agency_id order by due_at desc, id desc) k from opp) select agency_id organization_id, agency, id profile_id, due_at updated_at from p join ag using (agency_id) where k = 1")
def w3_latest_profiles(spark, sf_dir):
    t = Tables(spark, sf_dir)
    organizations = t.agencies.select(F.col("agency_id").alias("organization_id"), "agency")
    profiles = t.opportunities.select(F.col("agency_id").alias("organization_id"), F.col("id").alias("profile_id"), F.col("due_at").alias("updated_at"))
    return agencies.latest_profiles(organizations, profiles)


@query("p12_profile_terms", ", t as (select id, list_concat(naics_codes, ['PSC:' || psc_code, 'PSC:']) terms from opp) select id, array_to_string(list_filter(terms, lambda x: not starts_with(x, 'PSC:')), '|') capability_terms, array_to_string(list_transform(list_filter(terms, lambda x: starts_with(x, 'PSC:')), lambda x: x[5:]), '|') psc_codes from t")
def p12_profile_terms(spark, sf_dir):
    stored = Tables(spark, sf_dir).opportunities.withColumn("terms", agencies.encoded_terms(F.col("naics_codes"), F.array("psc_code", F.lit(""))))
    terms, codes = agencies.decoded_terms(F.col("terms"))
    return stored.select("id", F.array_join(terms, "|").alias("capability_terms"), F.array_join(codes, "|").alias("psc_codes"))


_FILES = ", fl as (select *, (opportunity_id * 10 + line_number) * 100000 + part_key id, 'f' || (part_key % 5) || case when part_key % 3 = 0 then '.PDF' else '.doc' end filename, case when fetched_at is not null and part_key % 4 > 0 then 'k' || part_key end storage_key, 'https://s.example.org/' || part_key source_url from doc)"


def _files(t: Tables):
    part = F.col("part_key")
    return t.documents.withColumns({
        "id": (F.col("opportunity_id") * 10 + F.col("line_number")) * 100_000 + part, "filename": F.concat(F.lit("f"), part % 5, F.when(part % 3 == 0, ".PDF").otherwise(".doc")),
        "storage_key": F.when(F.col("fetched_at").isNotNull() & (part % 4 > 0), F.concat(F.lit("k"), part)), "source_url": F.concat(F.lit("https://s.example.org/"), part),
    })


@query("p13_document_summary", f"{_FILES}, pl as (select *, row_number() over (partition by opportunity_id order by fetched_at desc nulls last, filename, id) k from fl) select opportunity_id, count(*) identified, count(fetched_at) fetched, count(*) filter (where extraction_status in ('complete', 'extracted', 'analyzed')) analyzed, count(*) filter (where is_missing) missing, string_agg(filename || '>' || case when storage_key <> '' then '/api/documents/file/' || id else source_url end, '|' order by k) filter (where k <= 50) documents from pl group by 1")
def p13_document_summary(spark, sf_dir):
    found = packages.document_summary(_files(Tables(spark, sf_dir)))
    shown = F.array_join(F.transform("documents", lambda d: F.concat(d["filename"], F.lit(">"), d["url"])), "|")
    return found.withColumn("documents", shown)


_REQ = ", rq as (select id * 3 id, opportunity_id, case when part_key % 6 > 0 then id end document_id, part_key % 2 = 0 mandatory, part_key % 11 created_at, case when part_key % 5 = 0 then 'portal' else 'document_text' end source from fl)"


def _requirements(t: Tables):
    part = F.col("part_key")
    return _files(t).select(
        (F.col("id") * 3).alias("id"), "opportunity_id", F.when(part % 6 > 0, F.col("id")).alias("document_id"), (part % 2 == 0).alias("mandatory"),
        (part % 11).alias("created_at"), F.when(part % 5 == 0, "portal").otherwise("document_text").alias("source"),
    )


@query("j6_requirement_evidence", f"{_FILES}{_REQ}, j as (select rq.opportunity_id, rq.id, filename, row_number() over (partition by rq.opportunity_id order by created_at, rq.id) place from rq join fl on fl.id = document_id where mandatory) select opportunity_id, id, filename, place::int place from j where place <= 20")
def j6_requirement_evidence(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return packages.requirement_evidence(_requirements(t), _files(t)).select("opportunity_id", "id", "filename", "place")


@query("m13_text_requirements_removed", f"{_FILES}{_REQ} select id, document_id, source from rq where not (coalesce(document_id, -1) in (select id from fl where extraction_status = 'analyzed') and source = 'document_text')")
def m13_text_requirements_removed(spark, sf_dir):
    t = Tables(spark, sf_dir)
    again = _files(t).where("extraction_status = 'analyzed'").select(F.col("id").alias("document_id"))
    return packages.without_text_requirements(_requirements(t), again).select("id", "document_id", "source")


_FILE_JOBS = ", jb as (select id + 7 id, id document_id, case when part_key % 2 = 0 then 'extract' else 'acquire' end stage, case when part_key % 5 < 3 then 'pending' else 'done' end state, (part_key % 7)::int priority, timestamp '1997-01-01' + to_days((part_key % 400)::int) run_after from fl where line_number < 5)"


def _file_jobs(t: Tables):
    part = F.col("part_key")
    return _files(t).where("line_number < 5").select(
        (F.col("id") + 7).alias("id"), F.col("id").alias("document_id"), F.when(part % 2 == 0, "extract").otherwise("acquire").alias("stage"), F.when(part % 5 < 3, "pending").otherwise("done").alias("state"),
        (part % 7).cast("int").alias("priority"), F.expr("timestamp '1997-01-01' + make_interval(0, 0, 0, cast(part_key % 400 as int))").alias("run_after"),
    )


@query("j7_ready_to_extract", f"{_FILES}{_FILE_JOBS} select jb.id, document_id, filename, priority, run_after from jb join fl on fl.id = document_id join opp on opp.id = fl.opportunity_id where stage = 'extract' and state = 'pending' and run_after <= timestamp '1998-01-01' and extraction_status = 'fetched' and storage_key is not null and lower(filename) like '%.pdf' and status = 'open' and (due_at is null or due_at >= timestamp '1998-01-01') order by priority, run_after, jb.id limit 24")
def j7_ready_to_extract(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return packages.ready_to_extract(_file_jobs(t), _files(t), t.opportunities, AS_OF).select("id", "document_id", "filename", "priority", "run_after")


@query("j8_documents_with_jobs", f"{_FILES}{_FILE_JOBS} select fl.id, filename, state job_state from fl left join jb on jb.document_id = fl.id and stage = 'acquire'")
def j8_documents_with_jobs(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return packages.with_acquire_job(_files(t), _file_jobs(t)).select("id", "filename", "job_state")


@query("j9_agencies_with_set_asides", "select agency_id, agency from ag where exists (select 1 from opp where opp.agency_id = ag.agency_id and set_aside is not null and status = 'open')")
def j9_agencies_with_set_asides(spark, sf_dir):
    t = Tables(spark, sf_dir)
    wanted = t.opportunities.where("set_aside is not null and status = 'open'").select("agency_id")
    return t.agencies.join(wanted, "agency_id", "left_semi").select("agency_id", "agency")


_AGENCY_ROWS = ", st as (select agency_id, agency as name, case when agency_id % 3 > 0 then agency_state end state_code, case when agency_id % 2 = 0 then 'state' else 'local' end level from ag where agency_id % 4 > 0), inc as (select agency_id agency_key, case when agency_id % 5 = 0 then upper(agency) || '' when agency_id % 5 = 1 then lower(agency) else agency end as name, case when agency_id % 3 > 0 then agency_state end state_code, case when agency_id % 2 = 0 then 'state' else 'local' end level from ag)"


def _agency_rows(t: Tables):
    n = F.col("agency_id")
    of = lambda table, key, name: table.select(n.alias(key), name.alias("name"), F.when(n % 3 > 0, F.col("agency_state")).alias("state_code"), F.when(n % 2 == 0, "state").otherwise("local").alias("level"))
    incoming = F.when(n % 5 == 0, F.upper("agency")).when(n % 5 == 1, F.lower("agency")).otherwise(F.col("agency"))
    return of(t.agencies, "agency_key", incoming), of(t.agencies.where("agency_id % 4 > 0"), "agency_id", F.col("agency"))


@query("j11_new_agencies", f"{_AGENCY_ROWS} select agency_key, name from inc where not exists (select 1 from st where lower(st.name) = lower(inc.name) and coalesce(st.state_code, '') = coalesce(inc.state_code, '') and st.level = inc.level)")
def j11_new_agencies(spark, sf_dir):
    return agencies.new_agencies(*_agency_rows(Tables(spark, sf_dir))).select("agency_key", "name")


@query("j11_resolved_agencies", f"{_AGENCY_ROWS} select agency_key, min(agency_id) agency_id from inc join st on st.name = inc.name and coalesce(st.state_code, '') = coalesce(inc.state_code, '') and st.level = inc.level group by 1")
def j11_resolved_agencies(spark, sf_dir):
    return agencies.resolved(*_agency_rows(Tables(spark, sf_dir)))


@query("j13_districts_by_website", ", w as (select agency_id, 'https://nces.example.org/?ID=' || case when agency_id % 3 = 0 then '9' else '' end || lpad(agency_id::varchar, 7, '0') || '&x=1' website from ag), i as (select lpad((agency_id * 2)::varchar, 7, '0') nces_id from ag) select nces_id, agency_id from i join w on website like '%' || nces_id || '%'")
def j13_districts_by_website(spark, sf_dir):
    rows = Tables(spark, sf_dir).agencies
    n = F.col("agency_id")
    site = F.concat(F.lit("https://nces.example.org/?ID="), F.when(n % 3 == 0, "9").otherwise(""), F.lpad(n.cast("string"), 7, "0"), F.lit("&x=1"))
    return agencies.contained(rows.select(F.lpad((n * 2).cast("string"), 7, "0").alias("nces_id")), rows.select("agency_id", site.alias("website")))


@query("m10_merged_maps", "select l_orderkey, l_linenumber, case when l_linenumber = 1 then null else l_returnflag end a, case when l_linenumber = 2 then l_linestatus else l_returnflag || '2' end b, case when l_linenumber <> 2 then l_linestatus end c from lineitem")
def m10_merged_maps(spark, sf_dir):
    line = F.col("l_linenumber")
    left = F.when(line > 1, F.create_map(F.lit("a"), "l_returnflag", F.lit("b"), "l_linestatus"))
    right = F.when(line != 2, F.create_map(F.lit("b"), F.concat("l_returnflag", F.lit("2")), F.lit("c"), "l_linestatus"))
    merged = Tables(spark, sf_dir).raw("lineitem").select("l_orderkey", "l_linenumber", packages.merged_maps(left, right).alias("m"))
    return merged.select("l_orderkey", "l_linenumber", *(F.col("m")[k].alias(k) for k in "abc"))


@query("o5_live_feed_order", "select id, estimated_value from cur where source_family = 'federal' order by estimated_value desc, id limit 50")
def o5_live_feed_order(spark, sf_dir):
    return Tables(spark, sf_dir).current("federal").orderBy(F.desc("estimated_value"), "id").limit(50).select("id", "estimated_value")


@query("o7_enrichment_queue", "select agency_id, agency, coalesce(max(due_at), timestamp '1970-01-01') last_run from ag left join opp using (agency_id) group by 1, 2 order by 3, 2 limit 25")
def o7_enrichment_queue(spark, sf_dir):
    t = Tables(spark, sf_dir)
    runs = t.opportunities.groupBy("agency_id").agg(F.max("due_at").alias("last_run"))
    queued = t.agencies.join(runs, "agency_id", "left").select("agency_id", "agency", F.coalesce("last_run", F.lit("1970-01-01").cast("timestamp")).alias("last_run"))
    return queued.orderBy("last_run", "agency").limit(min(25, max(1, 40)))


@query("u4_home_records", "select id, source_family from ((select id, source_family, due_at from cur where source_family = 'federal' order by due_at nulls last, id limit 2) union all (select id, source_family, due_at from cur where source_family = 'sled' order by due_at nulls last, id limit 3))")
def u4_home_records(spark, sf_dir):
    t = Tables(spark, sf_dir)
    first = lambda family, k: t.current(family).orderBy(F.asc_nulls_last("due_at"), "id").limit(k).select("id", "source_family")
    return packages.unioned([first("federal", 2), first("sled", 3)]).limit(5)


_STATED = ", tx as (select p_partkey, p_name || ['', ' liability cover', ' bid bond', ' signed affidavit must', ' total fee', ' award weight shall', ' training required', ' return with proposal'][(p_partkey % 8 + 1)::int] content from part)"


@query("e5_stated_requirements", f"{_STATED} select p_partkey, case when regexp_matches(content, '(?i)insurance|insured|liability|workers.? compensation') then 'insurance' when regexp_matches(content, '(?i)bond|bonding') then 'bonding' when regexp_matches(content, '(?i)certif|affidavit|registration|disclosure|questionnaire') then 'certification' when regexp_matches(content, '(?i)price|pricing|fee|cost') then 'pricing' when regexp_matches(content, '(?i)evaluation|award|score|weight') then 'evaluation' when regexp_matches(content, '(?i)scope|technical|training|specification|service') then 'technical' when regexp_matches(content, '(?i)submit|submission|proposal|bid package|return with') then 'submission_requirement' else 'other_requirement' end category, regexp_matches(content, '(?i)\\b(shall|must|required|submit|failure to|will be cause|shall provide|shall include)\\b') required from tx")
def e5_stated_requirements(spark, sf_dir):
    ends = ("", " liability cover", " bid bond", " signed affidavit must", " total fee", " award weight shall", " training required", " return with proposal")
    content = F.concat("p_name", F.get(F.array(*map(F.lit, ends)), (F.col("p_partkey") % 8).cast("int")))
    return Tables(spark, sf_dir).raw("part").select("p_partkey", packages.api_category(content).alias("category"), packages.looks_required(content).alias("required"))


@query("f16_not_past_due", "select id, due_at from opp where due_at is null or due_at >= timestamp '1998-01-01' - interval 6 hour")
def f16_not_past_due(spark, sf_dir):
    return packages.current(Tables(spark, sf_dir).opportunities, AS_OF, 6).select("id", "due_at")


@query("f10_prefixed_sources", ", keys as (select source_id, case source_id % 3 when 0 then 'periscope_' || registry_state when 1 then 'periscopeX' || registry_state else adapter_key end adapter_key from src) select * from keys where adapter_key like 'periscope_%'")
def f10_prefixed_sources(spark, sf_dir):
    n = F.col("source_id") % 3
    key = F.when(n == 0, F.concat(F.lit("periscope_"), "registry_state")).when(n == 1, F.concat(F.lit("periscopeX"), "registry_state")).otherwise(F.col("adapter_key"))
    return Tables(spark, sf_dir).sources.select("source_id", key.alias("adapter_key")).where(F.col("adapter_key").like("periscope_%"))


@query("q8_document_lifecycle", "select event_id, case event_type when 'click' then 'fetched' when 'view' then 'text_extracted' when 'error' then 'fetch_failed' when 'purchase' then 'analyzed' else 'pending' end status from events")
def q8_document_lifecycle(spark, sf_dir):
    kind = F.col("event_type")
    event = F.when(kind == "click", "fetched").when(kind == "view", "text").when(kind == "error", "failed").when(kind == "purchase", "analyzed").otherwise("none")
    return Tables(spark, sf_dir).raw("events").select("event_id", packages.status_after(F.lit("pending"), event).alias("status"))


@query("a16_sync_totals", ", c as (select source_id, count(*) total, count(*) filter (where status = 'open') open_ones from opp group by 1) select count(*) runs, sum(total)::bigint total, sum(open_ones)::bigint open_ones from c")
def a16_sync_totals(spark, sf_dir):
    runs = Tables(spark, sf_dir).opportunities.groupBy("source_id").agg(F.count("*").alias("total"), F.count_if(F.col("status") == "open").alias("open_ones"))
    return runs.agg(F.count("*").alias("runs"), F.sum("total").alias("total"), F.sum("open_ones").alias("open_ones"))


