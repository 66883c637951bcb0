"""Small rows whose results follow from the rules by hand."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from bidweave.functions import dates, rules, text
from bidweave.operators import cdc, decision, evidence, match, queue
from bidweave.sources import landed
from bidweave.streaming import ingest


def one(spark, expr, **values):
    frame = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {kind(v)}" for k, v in values.items()))
    return frame.select(expr.alias("x")).first()["x"]


def kind(v):
    return {int: "long", float: "double", str: "string", type(None): "string", list: "array<string>"}[type(v)]


RECORD = {"title": "x", "description": None, "naics_codes": [], "psc_code": "", "state_code": None, "set_aside": None, "estimated_value": None}


@pytest.mark.parametrize(
    "profile, record, score, reasons",
    [
        (dict(naics=("561621",)), dict(naics_codes=["561621"]), 100, ["NAICS match"]),
        (dict(naics=("561621",), terms=("camera",)), dict(naics_codes=["111111"], title="IP Camera"), 38, ["Capability match"]),
        (dict(psc=("J063",), terms=("camera",)), dict(psc_code="J063", title="camera"), 260, ["PSC match", "Capability match"]),
        (dict(territories=("NATIONAL",)), {}, 100, ["National territory"]),
        (dict(terms=("a_b",)), dict(title="axb"), 100, ["Capability match"]),
        (dict(statuses=("SDVOSB",), terms=("x",)), dict(title="y"), 0, []),
        (dict(terms=("x",)), dict(estimated_value=500.0), 140, ["Capability match"]),
        (dict(least_value=100, most_value=200), dict(estimated_value=150.0), 100, ["Target contract range"]),
        ({}, {}, 0, []),
        (dict(naics=("1",), least_value=100), dict(naics_codes=["1"], estimated_value=50.0), 80, ["NAICS match"]),
    ],
)
def test_match(spark, profile, record, score, reasons):
    row = RECORD | record
    frame = spark.createDataFrame([tuple(row.values())], "title string, description string, naics_codes array<string>, psc_code string, state_code string, set_aside string, estimated_value double")
    got = match.score(frame, match.Profile(**profile)).first()
    assert (got["match_score"], got["match_reasons"]) == (score, reasons)


@pytest.mark.parametrize("counts, state, step", [((0, 0, 0, 0), "No bid-package", "Open the original source"), ((3, 1, 0, 2), "2 of 3 identified package documents are marked", "Resolve the missing"), ((3, 1, 0, 0), "2 of 3 identified package documents have not yet been fetched", "Acquire the remaining"), ((3, 3, 2, 0), "1 of 3 fetched package documents has not yet", "Analyze the remaining"), ((2, 2, 2, 0), "All currently identified", "Review verified")])
def test_package_ladder(spark, counts, state, step):
    frame = spark.createDataFrame([counts], "identified long, fetched long, analyzed long, missing long")
    got = frame.select(rules.package_state().alias("s"), rules.next_step().alias("n")).first()
    assert got["s"].startswith(state) and got["n"].startswith(step)


LINES = [
    "Solicitation No. W912-26-R-0001", "Solicitation No. 123456789", "NAICS code: 561621", "Proposals are due by the deadline of May 1.",
    "The contractor shall furnish a performance bond.", "The bidder must hold a valid state license at all times.", "Bidders must attend the mandatory site visit on Monday.",
    "A bid bond is not required for this small purchase.", "Vendor must provide a taxpayer identification number.", "Vendor must comply.",
]


def test_evidence_lines(spark):
    docs = spark.createDataFrame([(1, "\r\n".join(LINES)), (2, None), (3, "")], "doc_id long, text string")
    numbered = evidence.lines(docs)
    facts = {(r["line"], r["fact_type"], r["value"]) for r in evidence.facts(numbered).collect()}
    assert facts == {(1, "solicitation_number", "W912-26-R-0001"), (3, "naics_code", "561621"), (4, "response_deadline", LINES[3])}
    first = {r["line"]: r["category"] for r in evidence.requirements(numbered, version=1).collect()}
    second = {r["line"]: r["category"] for r in evidence.requirements(numbered, version=2).collect()}
    assert first == {5: "bonding", 6: "submission_requirement", 7: "submission_requirement", 9: "submission_requirement"}
    assert second == {5: "bonding", 6: "certification", 7: "site_visit"}
    assert one(spark, evidence.is_boilerplate(F.col("f")), f="Form_W-9.pdf") and not one(spark, evidence.is_boilerplate(F.col("f")), f="RFP.pdf")


def test_contacts(spark):
    page = "<p>Jane Smith</p><p>Director of Technology</p><p>jsmith@example.org</p>"
    pages = spark.createDataFrame([(1, page), (2, page.replace("jsmith@example.org", "Call (212) 555-0100")), (3, page.replace("jsmith@example.org", "")), (4, None)], "page_id long, html string")
    got = {r["page_id"]: (r["name"], r["title"], r["role_family"], r["email"], r["confidence"]) for r in evidence.contacts(evidence.page_lines(pages)).collect()}
    who = ("Jane Smith", "Director of Technology", "Technology")
    assert got == {1: (*who, "jsmith@example.org", 88), 2: (*who, None, 82), 3: (*who, None, 72)}


@pytest.mark.parametrize(
    "wanted, limit, terms, verdict, score",
    [
        ([("bonding", "$1.5 million bond")], 2e6, (), "GO", 100), ([("bonding", "$1.5 million bond")], 1e6, (), "NO-GO", 0), ([("bonding", "$1.5 million bond")], None, (), "REVIEW", None),
        ([("certification", "must hold SDVOSB certification")], None, ("SDVOSB",), "GO", 100), ([("bonding", "$1.5 million bond"), ("certification", "ISO")], 2e6, (), "REVIEW", 50), ([("insurance", "x")], None, (), "REVIEW", None),
    ],
)
def test_go_no_go(spark, wanted, limit, terms, verdict, score):
    rows = spark.createDataFrame([(1, *w) for w in wanted], "opportunity_id long, category string, requirement string")
    got = decision.go_no_go(rows, terms, limit).first()
    assert (got["verdict"], got["score"]) == (verdict, score)


def utc(*parts):
    return datetime(*parts)


@pytest.mark.parametrize(
    "rule, written, want",
    [
        ("chicago", "7/4/2026 5:00 PM", utc(2026, 7, 4, 22)), ("chicago", "12/4/2026 5:00 PM", utc(2026, 12, 4, 23)), ("new_york", "3/8/2026 02:30", utc(2026, 3, 8, 7, 30)),
        ("new_york", "11/1/2026 01:30", utc(2026, 11, 1, 5, 30)), ("texas", "3/2/2026 5:00 PM", utc(2026, 3, 2, 22)), ("k12_portals", "3/20/2026 5:00 PM", utc(2026, 3, 20, 23)),
        ("arizona", "1/1/0001 12:00:00 AM", None), ("hawaii", "6/1/2026", utc(2026, 6, 2, 9, 59)), ("wyoming", "6/1/2026", utc(2026, 6, 1, 5, 59, 59)), ("chicago", "13/45/2026", None), ("utc", None, None),
    ],
)
def test_due_dates(spark, rule, written, want):
    assert one(spark, dates.DATE_RULES[rule].read(F.col("c")), c=written) == want


def test_zone_tokens(spark):
    assert one(spark, dates.with_token(F.col("c")), c="7/4/2026 5:00 PM CDT") == utc(2026, 7, 4, 22)
    assert one(spark, dates.with_token(F.col("c")), c="7/4/2026 5:00 PM") is None


def test_text_functions(spark):
    c = F.col("c")
    cases = [
        (text.squeezed(c), "a \xa0 b\n", "a b"), (text.plain(c), "W-9 (Rev.)", "w 9 rev"), (text.state_code(c), " tx ", "TX"), (text.state_code(c), "Texas", None), (text.trimmed(c), "  ", None),
        (text.title_case(c), " jane  o'neil ", "Jane O'neil"), (text.money(c), "a $1.5 million bond", 1.5e6), (text.money(c), "$ 1,234", 1234.0), (text.money(c), "none", None), (text.money(c), "$20k", 20_000.0),
        (text.without_doubling(c), "ABCABC", "ABC"), (text.without_doubling(c), "ABCAB", "ABCAB"), (text.comma_list(c), "a, b\n,c", ["A", "B", "C"]), (F.trim(text.visible_text(c)), "&lt;b&gt;x<script>y</script>", "x"),
    ]
    for expr, given, want in cases:
        assert one(spark, expr, c=given) == want
    assert one(spark, text.location(F.col("a"), F.col("b")), a="Austin", b="TX") == "Austin, TX"
    assert one(spark, text.location(F.col("a"), F.col("b")), a="", b=None) == "Location not stated"
    assert one(spark, text.agency_name(F.col("p"), F.col("o"), F.lit(None), F.lit(None)), p="DOD.ARMY. USACE ", o="") == "USACE"


def test_queue_steps(spark):
    for attempts, wait in ((1, 2), (5, 32), (12, 600)):
        assert one(spark, rules.backoff_seconds(F.col("n")), n=attempts) == wait
    now = datetime(2026, 1, 1)
    jobs = spark.createDataFrame([(1, "leased", 8, 8, now, datetime(2025, 1, 1), None), (2, "leased", 1, 8, now, datetime(2025, 1, 1), "http 500"), (3, "leased", 1, 8, now, datetime(2027, 1, 1), None)], "id long, state string, attempts int, max_attempts int, run_after timestamp, leased_until timestamp, last_error string")
    got = {r["id"]: (r["state"], r["last_error"]) for r in queue.expire_leases(jobs, now).collect()}
    assert got == {1: ("dead", "lease expired"), 2: ("pending", "http 500"), 3: ("leased", None)}
    done = queue.finish(jobs, jobs.where("id = 3").select("id"))
    assert {r["id"] for r in done.where("state = 'done'").collect()} == {3}


def test_distinct_rules(spark):
    rows = spark.createDataFrame([("a", 1, 0), ("b", 2, 1), ("a", 3, 2)], "k string, v int, pos int")
    assert {r["k"]: (r["v"], r["first_position"]) for r in cdc.last_wins(rows, ["k"], "pos").collect()} == {"a": (3, 0), "b": (2, 1)}
    assert {r["k"]: r["v"] for r in cdc.first_wins(rows, ["k"], "pos").collect()} == {"a": 1, "b": 2}


def test_links_are_carried_forward(spark):
    stored = spark.createDataFrame([(1, ["u"]), (2, ["v"])], "id long, links array<string>")
    incoming = spark.createDataFrame([(1, []), (2, ["w"]), (3, None)], "id long, links array<string>")
    assert {r["id"]: r["links"] for r in cdc.carried_forward(incoming, stored, "links").collect()} == {1: ["u"], 2: ["w"], 3: None}


def test_landed_payloads(spark, tmp_path):
    (tmp_path / "feed.csv").write_text('﻿NoticeId,Title,Department/Ind.Agency,Sub-Tier,Office,Active,Type,ResponseDeadLine,PopState,NaicsCode,SetASide\n1,"A ""b""\nc",DOD,ARMY,USACE,Yes,Solicitation,2026-07-04T17:00:00-04:00,tx,561621,\n2,x,DOD,,,No,Solicitation,,,,\n3,y,DOD,,,,Award Notice,,,,\n', encoding="utf-8")
    rows = landed.federal_records(landed.read_csv(spark, str(tmp_path / "feed.csv"), ("NoticeId",))).collect()
    assert [(r["external_id"], r["title"], r["agency"], r["state_code"], r["naics"]) for r in rows] == [("1", 'A "b"\nc', "USACE", "TX", "561621")]
    with pytest.raises(ValueError):
        landed.read_csv(spark, str(tmp_path / "feed.csv"), ("Absent",))
    pages = spark.createDataFrame([(1, '{"items": [{"id": "a", "due": "/Date(1000)/"}, {"id": "b"}]}'), (2, "broken")], "page int, body string")
    from pyspark.sql import types as T

    items = landed.json_records(pages, "items", T.StructType([T.StructField("id", T.StringType()), T.StructField("due", T.StringType())]), keep=("page",))
    assert [(r["id"], r["t"]) for r in items.withColumn("t", landed.dotnet_date(F.col("due"))).orderBy("id").collect()] == [("a", datetime(1970, 1, 1, 0, 0, 1)), ("b", None)]
    html = spark.createDataFrame([(1, "<table><tr><td>B-1</td><td>Roof</td></tr><tr><td></td><td>Addendum 1</td></tr><tr><td>B-2</td><td>Door</td></tr></table>")], "page int, body string")
    cells = landed.html_rows(html, keep=("page",)).select("page", "position", F.nullif(F.get("cells", F.lit(0)), F.lit("")).alias("bid_number"), F.get("cells", F.lit(1)).alias("title"))
    assert {r["bid_number"]: (r["title"], r["addenda"]) for r in landed.with_addenda(cells, "page").collect()} == {"B-1": ("Roof", ["Addendum 1"]), "B-2": ("Door", [])}
    label = landed.labelled(F.col("c"), "Agency", ("Due", "Title"))
    assert one(spark, label, c="Title: x Agency:  Parks  Dept Due: 1/1/2026") == "Parks Dept"
    assert one(spark, landed.page_keys(F.col("n"), 100), n=201) == [0, 1, 2]


def test_stream_merges_batches(spark, tmp_path):
    folder, table = tmp_path / "in", str(tmp_path / "table")
    folder.mkdir()
    schema = "id long, title string, status string, position long, seen_at timestamp"
    (folder / "1.json").write_text('{"id": 1, "title": "a", "status": "open", "position": 0, "seen_at": "2026-01-01T00:00:00"}\n{"id": 1, "title": "b", "status": "open", "position": 1, "seen_at": "2026-01-01T00:00:00"}\n')
    ingest.start(spark, str(folder), schema, table, str(tmp_path / "ck")).awaitTermination()
    (folder / "2.json").write_text('{"id": 2, "title": "c", "status": "open", "position": 0, "seen_at": "2026-01-02T00:00:00"}\n{"id": 1, "title": "d", "status": "open", "position": 1, "seen_at": "2026-01-02T00:00:00"}\n')
    ingest.start(spark, str(folder), schema, table, str(tmp_path / "ck")).awaitTermination()
    rows = {r["id"]: (r["title"], r["first_seen_at"].day, r["last_seen_at"].day) for r in ingest.read_version(spark, table, 1).collect()}
    assert rows == {1: ("d", 1, 2), 2: ("c", 2, 2)}
