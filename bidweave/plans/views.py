"""The canonical tables, read from the star schema that stands in for landed records."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = datetime(1998, 1, 1)

#: Agency kinds for the five market segments.
AGENCY_TYPES = {"AUTOMOBILE": "k12", "BUILDING": "higher_ed", "FURNITURE": "state_agency", "HOUSEHOLD": "county", "MACHINERY": "authority"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def agencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.create_map(*(F.lit(x) for pair in AGENCY_TYPES.items() for x in pair))[F.col("c_mktsegment")]
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("agency_id"),
        F.col("c_name").alias("agency"),
        kind.alias("agency_type"),
        F.lpad(F.col("c_nationkey").cast("string"), 2, "0").alias("agency_state"),
        F.when(F.col("c_acctbal") > 0, F.concat(F.lit("https://a"), F.col("c_custkey"), F.lit(".example.org"))).alias("website"),
    )


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.lpad(F.col("n_nationkey").cast("string"), 2, "0")
    federal = F.col("r_name") == "AMERICA"
    joined = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.select(
        F.col("n_nationkey").alias("source_id"),
        F.when(federal, "federal").otherwise("sled").alias("source_family"),
        F.when(federal, F.concat(F.lit("federal_"), code)).otherwise(F.concat(F.lower(F.replace("r_name", F.lit(" "), F.lit("_"))), F.lit("_"), code)).alias("adapter_key"),
        F.col("n_name").alias("source_name"),
        code.alias("registry_state"),
    )


def opportunities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each order; the codes of its lines are its industry codes."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    codes = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).groupBy("l_orderkey").agg(
        F.sort_array(F.collect_set("p_brand")).alias("codes"), F.min("p_type").alias("psc_code"), F.min("p_name").alias("name"), F.max("p_name").alias("description")
    )
    orders = table(spark, sf_dir, "orders").join(codes, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    return joined.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderkey").cast("string").alias("external_id"),
        F.col("o_custkey").alias("agency_id"),
        F.col("c_nationkey").alias("source_id"),
        F.concat(F.coalesce("name", F.lit("order")), F.lit(" "), F.col("o_orderkey")).alias("title"),
        F.col("description"),
        F.col("o_orderpriority").alias("solicitation_type"),
        F.when(F.col("o_orderstatus") == "O", "open").otherwise("closed").alias("status"),
        F.col("o_orderdate").cast("timestamp").alias("due_at"),
        F.col("o_totalprice").alias("estimated_value"),
        F.lpad(F.col("c_nationkey").cast("string"), 2, "0").alias("state_code"),
        F.when(F.col("o_custkey") % 3 > 0, F.col("c_name")).alias("city"),
        F.coalesce("codes", F.array().cast("array<string>")).alias("naics_codes"),
        F.coalesce("psc_code", F.lit("")).alias("psc_code"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "SDVOSB set-aside").when(F.col("o_orderpriority") == "2-HIGH", "HUBZone").alias("set_aside"),
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    fetched, reviewed = F.col("l_linestatus") == "F", F.col("l_returnflag").isin("A", "R")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("opportunity_id"),
        F.col("l_linenumber").alias("line_number"),
        F.col("l_partkey").alias("part_key"),
        F.when(fetched, F.col("l_shipdate").cast("timestamp")).alias("fetched_at"),
        F.when(fetched & reviewed, "analyzed").when(fetched, "fetched").otherwise("pending").alias("extraction_status"),
        (~fetched & ~reviewed).alias("is_missing"),
    )


#: The same tables in DuckDB, for the oracles.
SQL = """
ag as (select c_custkey agency_id, c_name agency, case c_mktsegment when 'AUTOMOBILE' then 'k12' when 'BUILDING' then 'higher_ed' when 'FURNITURE' then 'state_agency' when 'HOUSEHOLD' then 'county' when 'MACHINERY' then 'authority' end agency_type,
  lpad(c_nationkey::varchar, 2, '0') agency_state, case when c_acctbal > 0 then 'https://a' || c_custkey || '.example.org' end website from customer),
src as (select n_nationkey source_id, case when r_name = 'AMERICA' then 'federal' else 'sled' end source_family,
  case when r_name = 'AMERICA' then 'federal_' else lower(replace(r_name, ' ', '_')) || '_' end || lpad(n_nationkey::varchar, 2, '0') adapter_key, n_name source_name, lpad(n_nationkey::varchar, 2, '0') registry_state
  from nation join region on n_regionkey = r_regionkey),
codes as (select l_orderkey, list_sort(list(distinct p_brand)) codes, min(p_type) psc_code, min(p_name) nm, max(p_name) description from lineitem join part on l_partkey = p_partkey group by 1),
opp as (select o_orderkey id, o_orderkey::varchar external_id, o_custkey agency_id, c_nationkey source_id, coalesce(nm, 'order') || ' ' || o_orderkey title, description, o_orderpriority solicitation_type,
  case when o_orderstatus = 'O' then 'open' else 'closed' end status, o_orderdate::timestamp due_at, o_totalprice estimated_value, lpad(c_nationkey::varchar, 2, '0') state_code,
  case when o_custkey % 3 > 0 then c_name end city, coalesce(codes, []) naics_codes, coalesce(psc_code, '') psc_code,
  case o_orderpriority when '1-URGENT' then 'SDVOSB set-aside' when '2-HIGH' then 'HUBZone' end set_aside
  from orders left join codes on o_orderkey = l_orderkey join customer on o_custkey = c_custkey),
doc as (select l_orderkey opportunity_id, l_linenumber line_number, l_partkey part_key, case when l_linestatus = 'F' then l_shipdate end fetched_at,
  case when l_linestatus = 'F' and l_returnflag in ('A', 'R') then 'analyzed' when l_linestatus = 'F' then 'fetched' else 'pending' end extraction_status,
  (l_linestatus <> 'F' and l_returnflag not in ('A', 'R')) is_missing from lineitem),
ds as (select opportunity_id, count(*) identified, count(fetched_at) fetched, count(*) filter (where extraction_status in ('complete', 'extracted', 'analyzed')) analyzed, count(*) filter (where is_missing) missing from doc group by 1),
cur as (select * from opp join ag using (agency_id) join src using (source_id) where status = 'open' and (due_at is null or due_at >= timestamp '1998-01-01'))
"""
