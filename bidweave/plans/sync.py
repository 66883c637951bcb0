"""Registered queries: change rows of bucketed versions, nested project detail, and the two-step crawl."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import changes, crawl, details
from ..sources import landed, landing
from ..streaming.buckets import BucketedTable
from .catalog import Tables, query

_ROW = "id long, title string, status string, content_hash string, first_seen_at timestamp, last_seen_at timestamp"


def versioned(spark: SparkSession, sf_dir: str) -> BucketedTable:
    """Two batches of orders, the second one twice: a tenth of the orders, some of them changed, and some to close."""
    orders, key = Tables(spark, sf_dir).raw("orders"), F.col("o_orderkey")
    row = lambda title: (key.alias("id"), title.alias("title"), F.when(key % 4 > 0, "open").otherwise("closed").alias("status"), F.sha2(title, 256).alias("content_hash"))
    title = F.concat(F.lit("T"), key.cast("string"))
    first = orders.where(key % 3 > 0).select(*row(title))
    second = orders.where(key % 10 == 1).select(*row(F.when(key % 20 == 1, F.concat(title, F.lit("!"))).otherwise(title)))
    closing = orders.where(key % 50 == 7).select(key.alias("id"))
    path = landing.folder(spark, "versions")
    table = BucketedTable(spark, path, ["id"], _ROW, buckets=16)

    def step(at: str):
        return lambda stored, incoming, gone: changes.next_rows(stored, incoming, gone, ["id"], ["title", "status"], F.expr(f"timestamp_seconds({at})"), F.lit("feed"))

    table.apply("one", first, closing.where("false"), step("86400"))
    for _ in range(2):
        table.apply("two", second, closing, step("172800"))
    landing.drop_at_end(spark, path)
    return table


@query("m6_change_rows", "select 'two' batch, o_orderkey id, case when o_orderkey % 20 = 1 then 'source_update' else 'source_closed' end change_type, case when o_orderkey % 20 = 1 then 'feed changed: title' else 'feed no longer lists this as open' end summary, case when o_orderkey % 20 = 1 then 'T' || o_orderkey end title_before, case when o_orderkey % 20 = 1 then 'T' || o_orderkey || '!' end title_after from orders where o_orderkey % 3 > 0 and (o_orderkey % 20 = 1 or (o_orderkey % 50 = 7 and o_orderkey % 4 > 0))")
def m6_change_rows(spark, sf_dir):
    before, after = (F.get_json_object(c, "$.title").alias(f"title_{c}") for c in ("before", "after"))
    return versioned(spark, sf_dir).changes().select("batch", "id", "change_type", "summary", before, after)


@query("m1_versioned_rows", """select o_orderkey id, 'T' || o_orderkey || case when o_orderkey % 20 = 1 then '!' else '' end title, case when o_orderkey % 4 = 0 or o_orderkey % 50 = 7 then 'closed' else 'open' end status,
 timestamp '1970-01-02' + to_days(case when o_orderkey % 3 = 0 then 1 else 0 end) first_seen_at, timestamp '1970-01-02' + to_days(case when o_orderkey % 10 = 1 then 1 else 0 end) last_seen_at from orders where o_orderkey % 3 > 0 or o_orderkey % 10 = 1""")  # fmt: skip
def m1_versioned_rows(spark, sf_dir):
    return versioned(spark, sf_dir).current().select("id", "title", "status", "first_seen_at", "last_seen_at")


@query("m12_run_rows", """select 'one' batch, count(*) filter (where o_orderkey % 3 > 0) records_seen, count(*) filter (where o_orderkey % 3 > 0) records_new, 0::bigint records_changed, 0::bigint records_closed from orders
 union all select 'two', count(*) filter (where o_orderkey % 10 = 1), count(*) filter (where o_orderkey % 10 = 1 and o_orderkey % 3 = 0), count(*) filter (where o_orderkey % 3 > 0 and (o_orderkey % 20 = 1 or (o_orderkey % 50 = 7 and o_orderkey % 4 > 0))), count(*) filter (where o_orderkey % 3 > 0 and o_orderkey % 50 = 7 and o_orderkey % 4 > 0) from orders""")  # fmt: skip
def m12_run_rows(spark, sf_dir):
    return versioned(spark, sf_dir).runs()


def _details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A detail for each order, its lists made of the order's lines, which alone are shuffled."""
    text = lambda c: c.cast("string")
    file = lambda x: F.struct(F.when(x["no"] % 2 > 0, F.concat(F.lit("p/"), text(x["part"]))).alias("path"), x["part"].alias("id"), F.concat(F.lit("https://files.example/"), text(x["part"])).alias("url"), F.concat(F.lit("f"), text(x["part"]), F.lit(".pdf")).alias("filename"))
    ask = lambda x: F.struct(x["no"].alias("id"), F.concat(F.lit("Q"), text(x["part"] % 5)).alias("title"), F.lit("<p>a&nbsp;<b>bond</b> </p>").alias("prompt"), (x["no"] % 2 > 0).alias("isRequired"), F.when(x["no"] % 3 == 0, F.array(file(x))).alias("attachments"))
    criterion = lambda x: F.struct(x["no"].alias("id"), F.lit(" C ").alias("title"), F.concat(F.lit("<i>must</i> provide insurance "), text(x["part"] % 7)).alias("description"), (x["no"] % 4 == 0).alias("isHiddenByLogic"))
    scored = lambda x: F.struct(F.concat(F.lit("S"), text(x["part"] % 3)).alias("title"), (x["no"] * 5).cast("double").alias("weight"))
    lines = F.collect_list(F.struct(F.col("l_linenumber").alias("no"), F.col("l_partkey").alias("part")))
    grouped = Tables(spark, sf_dir).raw("lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(lines.alias("lines"))
    lists = [F.transform(F.filter("lines", lambda x: x["no"] % 3 > 0), file).alias("attachments"), F.transform("lines", ask).alias("questionnaires"), F.transform("lines", criterion).alias("criteria")]
    return grouped.select("id", F.to_json(F.struct(*lists, F.array(F.struct(F.transform("lines", scored).alias("scoringCriteria"))).alias("evaluationPhases"))).alias("detail"))


@query("d3_new_attachments", "select distinct l_orderkey id, 'f' || l_partkey || '.pdf' filename, 'https://files.example/' || l_partkey source_url from lineitem where l_partkey % 9 > 0")
def d3_new_attachments(spark, sf_dir):
    found = details.attachments(details.read(_details(spark, sf_dir)))
    lines = Tables(spark, sf_dir).raw("lineitem").where("l_partkey % 9 = 0")
    stored = lines.select(F.col("l_orderkey").alias("id"), F.concat(F.lit("f"), F.col("l_partkey").cast("string"), F.lit(".pdf")).alias("filename"))
    return details.absent(found, stored, ["id", "filename"])


@query("d3_requirements", "select distinct l_orderkey id, 'insurance' category, 'C: must provide insurance ' || l_partkey % 7 requirement_text from lineitem where l_linenumber % 4 > 0 union select distinct l_orderkey, 'bonding', 'Q' || l_partkey % 5 || ': a bond' from lineitem where l_linenumber % 2 > 0")
def d3_requirements(spark, sf_dir):
    return details.requirements(details.read(_details(spark, sf_dir), schema=details.ASKED))


@query("d3_evaluation_facts", "select distinct l_orderkey id, 'S' || l_partkey % 3 || ' — ' || 5 * l_linenumber || '%' source_text, (5 * l_linenumber)::double weight from lineitem")
def d3_evaluation_facts(spark, sf_dir):
    return details.evaluation_facts(details.read(_details(spark, sf_dir)))


_CRAWL_SQL = """, p as (select page_id n from pages), s as (select n id, n from p where n % 10 = 0), seed as (select id, 0 k, n from s union all select id, 1, n + 7 from s)
, f1 as (select id, t, min((k, j)) pl from (select id, k, j, seed.n + 7 * j t from seed join p using (n), range(1, 6) r(j)) group by 1, 2), f as (select id, t, row_number() over (partition by id order by pl, t) i from f1)
, d as (select f.id, f.i, j, t + 7 * j u from f join p on p.n = t, range(1, 6) r(j)), c as (select id, i, count(*) deep from d group by 1, 2)
, w as (select f.id, f.i, f.t, coalesce(sum(1 + coalesce(deep, 0)) over (partition by f.id order by f.i rows between unbounded preceding and 1 preceding), 0) spent from f left join c using (id, i))
, went as (select * from w where spent < 12), red as (select id, -1 i, k j, n from seed union all select id, i, 0, t from went union all select d.id, d.i, d.j, d.u from d join went using (id, i) where spent + j < 16)
, cdoc as (select id, red.n, x, min((i, j, x)) pl from red join p using (n), range(1, 9) q(x) group by 1, 2, 3), ranked as (select id, 'https://h' || n % 7 || '.example.org/p/files/d' || n || '-' || x || '.pdf' target, row_number() over (partition by id order by pl) as rank from cdoc)"""


@query("d1_two_step_documents", f"{_CRAWL_SQL} select id, target, rank::int rank from ranked where rank <= 60")
def d1_two_step_documents(spark, sf_dir):
    """Every page, with links to others of its host, one to another host, and documents; each tenth starts a crawl."""
    n, text = F.col("page_id"), lambda c: c.cast("string")
    url = F.concat(F.lit("https://h"), text(n % 7), F.lit(".example.org/p/"), text(n))
    links = [F.concat(F.lit('<a href="/p/'), text(n + 7 * j), F.lit('">the solicitation</a>')) for j in range(1, 6)]
    links += [F.concat(F.lit('<a href="https://h'), text((n + 1) % 7), F.lit('.example.org/p/'), text(n + 1), F.lit('">attachment</a>'))]
    links += [F.concat(F.lit('<a href="files/d'), text(n), F.lit(f'-{k}.pdf">x</a>')) for k in range(1, 9)]
    raw = Tables(spark, sf_dir).raw("pages")
    pages = raw.select("page_id", url.alias("url"), F.concat(F.coalesce("html", F.lit("")), *links).alias("html"))
    seeds = pages.where(n % 10 == 0).select(n.alias("id"), F.explode(F.array(F.struct(F.lit(0).alias("n"), "url"), F.struct(F.lit(1).alias("n"), F.concat(F.lit("https://h"), text((n + 7) % 7), F.lit(".example.org/p/"), text(n + 7)).alias("url")))).alias("s")).select("id", "s.*")
    return crawl.documents(seeds, pages.select("url", "html"))


@query("s26_label_chunks", "select c_custkey page, row_number() over (partition by c_custkey order by o_orderkey)::int as position, o_orderkey::varchar event, 'Supply & ' || o_orderkey title, year(o_orderdate) || '-' || lpad(month(o_orderdate)::varchar, 2, '0') closes from orders join customer on o_custkey = c_custkey")
def s26_label_chunks(spark, sf_dir):
    """Each customer's orders as one page of label-delimited text, taken apart at its first label."""
    t, key = Tables(spark, sf_dir), F.col("o_orderkey")
    told = F.concat(F.lit("Event ID : "), key, F.lit("\n  Event Name:  Supply & "), key, F.lit(" \n Closes "), F.date_format("o_orderdate", "yyyy-MM"), F.lit("\n"))
    orders = t.raw("orders").join(t.raw("customer").select("c_custkey"), F.col("o_custkey") == F.col("c_custkey"))
    listed = orders.groupBy(F.col("c_custkey").alias("page")).agg(F.sort_array(F.collect_list(F.struct(key, told.alias("told")))).alias("rows"))
    pages = listed.select("page", F.concat(F.lit("All events\n"), F.array_join(F.transform("rows", lambda r: r["told"]), "")).alias("body"))
    chunks = landed.label_chunks(pages, "Event ID", keep=["page"])
    c = F.concat(F.lit("Event ID"), F.col("chunk"))
    labels = ("Event ID", "Event Name", "Closes")
    return chunks.select("page", "position", *(landed.labelled(c, label, labels[i + 1 :]).alias(name) for i, (label, name) in enumerate(zip(labels, ("event", "title", "closes")))))
