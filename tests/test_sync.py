"""Bucketed versions and change rows, nested detail and the crawl's caps, on rows worked out by hand."""

import json
import os

import pytest
from pyspark.sql import functions as F

from bidweave.operators import changes, crawl, details
from bidweave.streaming import ingest
from bidweave.streaming.buckets import BucketedTable

ROW = "id long, title string, status string, content_hash string, first_seen_at timestamp, last_seen_at timestamp"


def batch(spark, rows):
    return spark.createDataFrame([(i, t, s, t) for i, t, s in rows], "id long, title string, status string, content_hash string")


def step(day):
    return lambda stored, incoming, closing: changes.next_rows(stored, incoming, closing, ["id"], ["title", "status"], F.expr(f"timestamp_seconds({day * 86400})"), F.lit("S"))


def keys(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "id long")


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(f"{path}/rows") for f in names if f.endswith(".parquet")}


@pytest.fixture()
def table(spark, tmp_path):
    made = BucketedTable(spark, str(tmp_path / "t"), ["id"], ROW, buckets=8)
    made.apply("one", batch(spark, [(i, f"t{i}", "open") for i in range(200)]), keys(spark), step(1))
    return made


def test_only_touched_buckets_are_written(spark, table):
    before = files(table.path)
    version = table.apply("two", batch(spark, [(5, "new", "open"), (6, "t6", "open")]), keys(spark, 9, 10_000), step(2))
    wanted = {r[0] for r in spark.createDataFrame([(5,), (6,), (9,), (10_000,)], "id long").select(table.bucket_of()).collect()}
    after = files(table.path)
    fresh = {f for f in after if f not in before}
    assert {int(f.split("bucket=")[1].split("/")[0]) for f in fresh} <= wanted and all(after[f] == t for f, t in before.items())
    rows = {r["id"]: r for r in table.current().collect()}
    assert len(rows) == 200 and rows[5]["title"] == "new" and rows[9]["status"] == "closed" and rows[10]["status"] == "open"
    assert rows[5]["first_seen_at"].day == 2 and rows[5]["last_seen_at"].day == 3 and rows[9]["last_seen_at"].day == 2
    assert {(r["id"], r["change_type"], r["summary"]) for r in table.changes().collect()} == {(5, "source_update", "S changed: title"), (9, "source_closed", "S no longer lists this as open")}
    update = table.changes().where("id = 5").first()
    assert json.loads(update["before"]) == {"title": "t5", "status": "open"} and json.loads(update["after"])["title"] == "new"
    assert [tuple(r) for r in table.runs().orderBy("batch").collect()] == [("one", 200, 200, 0, 0), ("two", 2, 0, 2, 1)] and version == 1
    assert table.current(0).where("title = 'new'").count() == 0, "older versions stay as they were"


def test_replay_adds_nothing_and_a_broken_write_does_not_count(spark, table):
    table.apply("two", batch(spark, [(5, "new", "open")]), keys(spark), step(2))
    before = (files(table.path), table.versions(), table.changes().count())
    assert table.apply("two", batch(spark, [(5, "newer", "open")]), keys(spark), step(3)) == 1
    assert (files(table.path), table.versions(), table.changes().count()) == before
    os.makedirs(f"{table.path}/rows/version=2/bucket=0")  # a writer that died before its manifest
    assert table.current().where("id = 5").first()["title"] == "new"
    assert table.apply("three", batch(spark, [(5, "third", "open")]), keys(spark), step(3)) == 3
    assert table.current().where("id = 5").first()["title"] == "third" and table.current().count() == 200


def test_old_versions_expire(spark, table):
    for n in range(4):
        table.apply(f"b{n}", batch(spark, [(5, f"n{n}", "open")]), keys(spark), step(2 + n))
    gone = table.expire(keep=1)
    bucket = keys(spark, 5).select(table.bucket_of()).first()[0]
    assert {g for g in gone} == {f"version={v}/bucket={bucket}" for v in range(4)}
    assert table.current().count() == 200 and table.current().where("id = 5").first()["title"] == "n3" and table.changes().count() == 4


def test_rows_with_equal_digests_and_nulls(spark):
    stored = batch(spark, [(1, "a", "open"), (2, None, "open"), (3, "c", "closed")]).withColumns({c: F.expr("timestamp_seconds(0)") for c in ("first_seen_at", "last_seen_at")})
    incoming = batch(spark, [(1, "a", "open"), (2, "b", "open"), (4, None, None)])
    rows = {r["id"]: r for r in step(1)(stored, incoming, keys(spark, 1, 3, 3, 7)).collect()}
    assert set(rows) == {1, 2, 3, 4} and rows[1]["change"] is None and rows[1]["status"] == "open", "what is listed is not closed"
    assert rows[2]["change"]["change_type"] == "source_update" and rows[3]["change"] is None and rows[4]["is_new"]


def test_batches_of_a_stream_touch_their_buckets(spark, tmp_path):
    folder, table = tmp_path / "in", str(tmp_path / "t")
    folder.mkdir()
    schema = "id long, title string, status string, position long, seen_at timestamp"
    line = lambda i, t, p, day: json.dumps({"id": i, "title": t, "status": "open", "position": p, "seen_at": f"2026-01-0{day}T00:00:00"})
    (folder / "1.json").write_text("\n".join(line(i, "a", 0, 1) for i in range(500)))
    ingest.start(spark, str(folder), schema, table, str(tmp_path / "ck")).awaitTermination()
    before = files(table)
    (folder / "2.json").write_text("\n".join(line(i, t, p, 2) for i, t, p in ((1, "x", 0), (1, "b", 1), (900, "new", 0))))
    ingest.start(spark, str(folder), schema, table, str(tmp_path / "ck")).awaitTermination()
    fresh = [f for f in files(table) if f not in before]
    assert 1 <= len(fresh) <= 2 and len(before) > 40
    rows = {r["id"]: r["title"] for r in ingest.read_version(spark, table, 1).collect()}
    assert len(rows) == 501 and rows[1] == "b" and rows[900] == "new"


def test_nested_detail(spark):
    file = {"path": "p", "id": 1, "url": "https://x/1", "filename": "a.pdf"}
    detail = {
        "attachments": [file, {"id": 2, "url": "https://x/2", "fileExtension": ".doc"}, {"id": 0, "url": "https://x/3", "title": "Three"}, {"id": 7}, {}],
        "questionnaires": [{"title": "", "prompt": "<p>Sign the <b>bond</b></p>", "isRequired": True, "attachments": [{**file, "url": "https://x/1?new"}]}, {"title": "Later", "isRequired": False}, {"title": "Fee table", "isRequired": True}],
        "criteria": [{"title": "A", "description": "Bidder shall be insured"}, {"title": "B", "description": "nothing"}, {"title": "C", "description": "must", "isHiddenByLogic": True}, {"title": None, "description": "must&nbsp;do training &lt;all&gt;"}],
        "evaluationPhases": [{"scoringCriteria": [{"title": "Price", "weight": 40.0, "description": "<i>low</i>"}, {"weight": 2.5}]}, {"scoringCriteria": [{"title": "Price", "weight": 40.0, "description": "low"}, {"title": "Skill"}]}],
    }
    parsed = details.read(spark.createDataFrame([(1, json.dumps(detail)), (2, "{}"), (3, "none"), (4, None)], "id long, detail string"))
    assert {tuple(r) for r in details.attachments(parsed).collect()} == {(1, "a.pdf", "https://x/1?new"), (1, "opengov-2.doc", "https://x/2"), (1, "Three", "https://x/3")}
    assert {tuple(r) for r in details.requirements(parsed).collect()} == {(1, "insurance", "A: Bidder shall be insured"), (1, "technical", "must do training <all>"), (1, "bonding", "Required response item: Sign the bond"), (1, "pricing", "Fee table")}
    assert {tuple(r) for r in details.evaluation_facts(parsed).collect()} == {(1, "Price — 40%: low", 40.0), (1, "Evaluation criterion — 2.5%", 2.5), (1, "Skill", None)}
    stored = spark.createDataFrame([(1, "a.pdf", "https://x/1", None), (1, "Three", "https://x/old", "kept")], "id long, filename string, source_url string, storage_key string")
    found = details.attachments(parsed)
    assert [tuple(r) for r in details.refreshed(found, stored).collect()] == [(1, "a.pdf", "https://x/1?new")]
    assert [r["filename"] for r in details.absent(found, stored, ["id", "filename"]).collect()] == ["opengov-2.doc"]


def walk(seeds, pages):
    """The crawl as a loop: ``pages`` maps a url to (links to follow, documents), in order."""
    origins = {u.split("/p")[0] for u in seeds[: crawl.SEEDS]}
    found, follow, spent = [], [], 0

    def look(url, onto):
        ways, docs = pages.get(url, ([], []))
        found.extend(d for d in docs if d not in found)
        onto.extend(w for w in ways if w not in onto)

    for u in seeds[: crawl.SEEDS]:
        look(u, follow)
    for u in follow:
        if spent >= crawl.FIRST:
            break
        if u.split("/p")[0] not in origins:
            continue
        spent, deeper = spent + 1, []
        look(u, deeper)
        for v in deeper:
            if spent >= crawl.ALL:
                break
            if v.split("/p")[0] in origins:
                spent += 1
                look(v, [])
    return found[: crawl.DOCUMENTS]


@pytest.mark.parametrize("width,docs", [(1, 3), (3, 2), (5, 8), (14, 1), (20, 30)])
def test_crawl_equals_a_loop(spark, width, docs):
    hosts = ["https://a.org", "https://b.org"]
    pages = {}
    for n in range(150):
        ways = [f"{hosts[(n + j) % 7 == 0]}/p{(n * 3 + j) % 150}" for j in range(1, width + 1)]
        pages[f"{hosts[0]}/p{n}"] = (list(dict.fromkeys(ways)), [f"{hosts[0]}/p/d{(n * 2 + k) % 400}.pdf" for k in range(docs)])
    html = lambda ways, docs: "".join(f'<a href="{w}">Bid package</a>' for w in ways) + "".join(f'<a href="{d}">x</a>' for d in docs) + '<a href="/p1">home</a>'
    table = spark.createDataFrame([(u, html(*v)) for u, v in pages.items()], "url string, html string")
    starts = {i: [f"{hosts[0]}/p{(i * 7 + k) % 160}" for k in range(i % 6 + 1)] for i in range(12)}
    seeds = spark.createDataFrame([(i, n, u) for i, us in starts.items() for n, u in enumerate(us)], "id long, n int, url string")
    got = {}
    for r in crawl.documents(seeds, table).orderBy("id", "rank").collect():
        got.setdefault(r["id"], []).append(r["target"])
    assert got == {i: w for i, us in starts.items() if (w := walk(us, pages))}


def test_a_detail_is_parsed_once_for_its_requirements(spark):
    """One parse and one shuffle of lines; null elements, other texts and a narrower schema change nothing."""
    bodies = ['{"criteria": [null, {"title": "must A"}, {"title": "must B", "isHiddenByLogic": true}], "questionnaires": [null, {"isRequired": true}]}', "[1]", "", None, '{"attachments": 3, "criteria": [{"title": "must A"}]}']
    rows = spark.createDataFrame([(1, b) for b in bodies] + [(2, bodies[0])], "id long, detail string")
    for schema in (details.DETAIL, details.ASKED):
        got = details.requirements(details.read(rows, schema=schema)).collect()
        assert sorted(tuple(r) for r in got) == [(k, "other_requirement", text) for k in (1, 2) for text in ("Required response item", "must A")]
    plan = details.requirements(details.read(rows))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 1 and "Union" not in plan
