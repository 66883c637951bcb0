"""Registered queries: source registration, portals that count, and days written with slashes."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import dates
from ..operators import registration
from ..sources.landed import json_records
from .catalog import Tables, query
from .views import AS_OF

_STORED = """, old as (select 'id-' || s_suppkey id, 'k' || s_suppkey adapter_key, s_name source_name, 'u' || s_suppkey base_url, 'Ohio' jurisdiction, 'api' source_type, s_suppkey % 4 > 0 active, (s_suppkey % 100)::int health_score, timestamp '1997-01-01' last_success_at, timestamp '1996-01-01' + to_days((s_suppkey % 30)::int) created_at from supplier where s_suppkey % 3 > 0
 union all select 'older-' || s_suppkey, 'k' || s_suppkey, s_name, 'u' || s_suppkey, 'Ohio', 'api', false, 7, timestamp '1997-01-01', timestamp '1995-01-01' from supplier where s_suppkey % 5 = 0)
, inc as (select 'k' || s_suppkey adapter_key, s_name || '!' source_name, 'v' || s_suppkey base_url, case when s_suppkey % 4 = 0 then '' else 'Texas' end jurisdiction, case when s_suppkey % 8 > 0 then 'feed' end source_type from supplier where s_suppkey % 2 = 0)
, u as (select adapter_key, sha256(adapter_key) h from inc), fi as (select adapter_key, arg_min(id, created_at) id from old group by 1)"""
_UUID = "substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', (strpos('0123456789abcdef', substr(h, 17, 1)) - 1)::int % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12)"
_KEPT = "coalesce(nullif(inc.jurisdiction, ''), 'United States') jurisdiction, coalesce(nullif(inc.source_type, ''), 'portal') source_type"


@query("m11_registered_sources", f"{_STORED} select old.id, old.adapter_key, inc.source_name, inc.base_url, {_KEPT}, true active, health_score, last_success_at from old join fi on fi.id = old.id join inc on inc.adapter_key = old.adapter_key union all select id, adapter_key, source_name, base_url, jurisdiction, source_type, active, health_score, last_success_at from old where id not in (select fi.id from fi join inc using (adapter_key)) union all select {_UUID}, inc.adapter_key, inc.source_name, inc.base_url, {_KEPT}, true, 100, timestamp '1998-01-01' from inc join u using (adapter_key) where inc.adapter_key not in (select adapter_key from old)")
def m11_registered_sources(spark, sf_dir):
    s, key = Tables(spark, sf_dir).raw("supplier"), F.col("s_suppkey")
    columns = ["source_name", "base_url", "jurisdiction", "source_type"]
    row = lambda name, active, health, created: (F.concat(F.lit(name), key).alias("id"), F.concat(F.lit("k"), key).alias("adapter_key"), *(c.alias(n) for c, n in zip((F.col("s_name"), F.concat(F.lit("u"), key), F.lit("Ohio"), F.lit("api")), columns)), active.alias("active"), health.cast("int").alias("health_score"), F.expr("timestamp '1997-01-01'").alias("last_success_at"), created.alias("created_at"))
    stored = s.where("s_suppkey % 3 > 0").select(*row("id-", key % 4 > 0, key % 100, F.expr("timestamp '1996-01-01' + make_interval(0, 0, 0, cast(s_suppkey % 30 as int))")))
    older = s.where("s_suppkey % 5 = 0").select(*row("older-", F.lit(False), F.lit(7), F.expr("timestamp '1995-01-01'")))
    stated = s.where("s_suppkey % 2 = 0").select(F.concat(F.lit("k"), key).alias("adapter_key"), F.concat("s_name", F.lit("!")).alias("source_name"), F.concat(F.lit("v"), key).alias("base_url"), F.when(key % 4 == 0, "").otherwise("Texas").alias("jurisdiction"), F.when(key % 8 > 0, "feed").alias("source_type"))
    return registration.registered(stored.union(older), stated, AS_OF).drop("created_at")


@query("f13_usable_projects", "select p_partkey id, p_name title from part where p_partkey % 2 = 0 and p_partkey % 3 > 0 and p_partkey % 7 > 0")
def f13_usable_projects(spark, sf_dir):
    key = F.col("p_partkey")
    item = F.struct(key.alias("id"), F.when(key % 7 == 0, " ").otherwise(F.col("p_name")).alias("title"), F.when(key % 2 > 0, True).alias("isPrivate"), (key % 3 == 0).alias("isTemplate"))
    pages = Tables(spark, sf_dir).raw("part").select(F.to_json(F.struct(F.array(item).alias("projects"))).alias("body"))
    found = json_records(pages, "projects", T.StructType.fromDDL("id long, title string, isPrivate boolean, isLibrary boolean, isTemplate boolean, isIntake boolean"))
    return registration.usable_projects(found).select("id", "title")


@query("f13_directory_entries", "select s_suppkey id, 'g' || s_suppkey code from supplier where s_suppkey % 2 > 0 and s_suppkey % 3 > 0 and s_suppkey % 5 > 0 and s_suppkey % 7 > 0")
def f13_directory_entries(spark, sf_dir):
    key = F.col("s_suppkey")
    government = F.when(key % 7 > 0, F.struct(F.concat(F.lit("g"), key).alias("code")))
    entry = Tables(spark, sf_dir).raw("supplier").select(key.alias("id"), F.when(key % 2 == 0, False).alias("isActive"), F.when(key % 3 == 0, True).alias("isVendor"), F.when(key % 5 > 0, "US").alias("countryCode"), government.alias("government"))
    return registration.directory_entries(entry).select("id", "government.code")


@query("t16_utc_days", "select o_orderkey, make_date(year(o_orderdate), 1, 1) + to_months((month(o_orderdate) + o_orderkey % 4 - 1)::int) + to_days((day(o_orderdate) + o_orderkey % 9 - 1)::int) + to_seconds(case when o_orderkey % 2 = 0 then 86399 else 0 end) as due_at from orders")
def t16_utc_days(spark, sf_dir):
    day, key = F.col("o_orderdate"), F.col("o_orderkey")
    written = F.concat_ws("/", F.month(day) + key % 4, F.dayofmonth(day) + key % 9, F.year(day))
    return Tables(spark, sf_dir).raw("orders").select("o_orderkey", dates.utc_day(written, key % 2 == 0).alias("due_at"))


@query("t19_iso_days", "select o_orderkey, case when o_orderkey % 5 > 0 then strftime(o_orderdate, '%Y-%m-%d') end as due_on from orders")
def t19_iso_days(spark, sf_dir):
    day, key = F.col("o_orderdate"), F.col("o_orderkey")
    written = F.concat(F.when(key % 5 == 0, "due ").otherwise("\t"), F.concat_ws("/", F.month(day), F.dayofmonth(day), F.year(day)), F.lit("  05:00 PM (CT)"))
    return Tables(spark, sf_dir).raw("orders").select("o_orderkey", dates.iso_day(written).alias("due_on"))


@query("m11_synced_sources", "select s_suppkey id, s_name source_name, case when s_suppkey % 3 = 0 then 100 else 40 end health_score, case when s_suppkey % 3 = 0 then timestamp '1998-01-01' end last_success_at, case when s_suppkey % 3 > 0 then 'timeout' end last_error from supplier")
def m11_synced_sources(spark, sf_dir):
    s = Tables(spark, sf_dir).raw("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("source_name"), F.lit(40).alias("health_score"), F.lit(None).cast("timestamp").alias("last_success_at"), F.lit("timeout").alias("last_error"))
    return registration.after_sync(s, s.where("id % 3 = 0").select("id"), AS_OF)
