"""Grids, embedded JSON, dates by rule and zone, portal mappings and gates, on small pages worked out by hand."""

import csv
import io
import json
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from bidweave.operators import sweeps
from bidweave.operators.duedates import RULES, with_instants
from bidweave.sources import embedded, grids, landing, portals

NOW = datetime(2026, 1, 1)


def instant(*parts):
    return int(datetime(*parts, tzinfo=timezone.utc).timestamp())


DATES = [
    ("nyscr_ny", "3/8/2026 1:30 AM", (2026, 3, 8, 6, 30)), ("nyscr_ny", "3/8/2026 3:30 AM", (2026, 3, 8, 7, 30)), ("nyscr_ny", "2026-03-08T02:30:00", (2026, 3, 8, 7, 30)), ("nyscr_ny", "11/1/2026 1:30 AM", (2026, 11, 1, 5, 30)), ("nyscr_ny", "11/1/2026 2:30 AM", (2026, 11, 1, 7, 30)),
    ("delaware_open_bids_de", "2026-03-08T02:30:00.000", (2026, 3, 8, 6, 30)), ("delaware_open_bids_de", "2026-07-01T10:00:00", (2026, 7, 1, 14)), ("cgi_advantage_legacy_al", "3/8/2026 2:30 AM", (2026, 3, 8, 8, 30)),
    ("esm_posting_board_sd", "2026-11-01T01:30:00", (2026, 11, 1, 7, 30)), ("esm_posting_board_sd", "2026-03-08T01:30:00", (2026, 3, 8, 6, 30)), ("magic_public_ms", "2026-07-01T10:00:00", (2026, 7, 1, 15)), ("magic_public_ms", "2026-07-01T10:00:00Z", (2026, 7, 1, 10)),
    ("hands_hi", "3/5/2026", (2026, 3, 6, 9, 59)), ("hands_hi", "3/5/2026 12:15 AM", (2026, 3, 5, 10, 15)), ("ivalua_app_az", "1/1/0001 12:00:00 AM", None), ("ivalua_app_az", "7/1/2026 5:00:30 PM", (2026, 7, 2, 0, 0, 30)),
    ("nebraska_das_ne", "1/2/26", (2026, 1, 3, 4, 59, 59)), ("wyoming_ai_released_bids_wy", "1/2/2026", (2026, 1, 2, 5, 59, 59)), ("peoplesoft_ca", "1/2/2026 3:00PM PST", (2026, 1, 2, 23)), ("peoplesoft_ca", "7/2/2026 12:00 PM pdt", (2026, 7, 2, 19)), ("peoplesoft_ca", "1/2/2026 3:00PM", None),
    ("jaggaer", "January 5, 2026 4:00 PM (EST)", (2026, 1, 5, 21)), ("jaggaer", "Jan 5, 2026", (2026, 1, 5)), ("sam_gov", "2026-01-02T10:00:00-05:00", (2026, 1, 2, 15)), ("sam_gov", "2026-01-02T10:00:00+05:30", (2026, 1, 2, 4, 30)), ("sam_gov", "2026-01-02", (2026, 1, 2)),
    ("sam_gov_adapter", "1/2/2026", (2026, 1, 2)), ("sam_gov", "2026-02-30", None), ("sam_gov", "13/45/2026", None), ("sam_gov", "2026-01-02 25:00", None), ("sam_gov", "2026-01-02 10:00 zebra", None), ("sam_gov", "", None), ("sam_gov", None, None), ("unknown", "1/2/2026", None),
]


@pytest.mark.parametrize("zone", ["UTC", "Asia/Tokyo", "America/Denver"])
def test_dates_do_not_depend_on_the_session(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        rows = spark.createDataFrame([(i, s, t) for i, (s, t, _) in enumerate(DATES)], "i int, source string, t string")
        got = {r["i"]: r["at"] for r in with_instants(rows, "source", {"due": "t"}).select("i", F.unix_seconds("due").alias("at")).collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert got == {i: None if want is None else instant(*want) for i, (_, _, want) in enumerate(DATES)}


def test_days_of_issue_and_every_rule(spark):
    rows = spark.createDataFrame([(s, "1/2/2026") for s in RULES], "source string, t string")
    got = {r["source"]: r["at"] for r in with_instants(rows, "source", {"at_issue": "t"}, ("at_issue",)).select("source", F.unix_seconds("at_issue").alias("at")).collect()}
    assert len(got) == len(RULES) and got["nebraska_das_ne"] == instant(2026, 1, 2, 17) and got["wyoming_ai_released_bids_wy"] == instant(2026, 1, 2, 18) and got["hands_hi"] == instant(2026, 1, 2, 10)


GRID = """<table><tr><td>menu</td></tr></table><TABLE><thead><tr><th> Bid&nbsp;# <th>Title<th></tr></thead><tbody>
<tr><td>1<td><a href="d?a=1&amp;b=2">A &amp; b</a><br>more<script>no()</script></td><td></td></tr>
<tr><td>2</td><td>has <table><tr><td>inner</td></tr></table> after</td></tr><tr></tr><tr><td>3"""


def test_table_rows(spark):
    pages = spark.createDataFrame([("s", 0, GRID), ("s", 1, None), ("s", 2, "<p>none")], "source string, page int, body string")
    rows = grids.table_rows(pages, ["bid #", "title"]).orderBy("page", "position").collect()
    assert [(r["page"], r["position"], list(r["cells"])) for r in rows] == [(0, 0, ["1", "A & b more", ""]), (0, 1, ["2", "has after"]), (0, 2, ["3"])]
    assert rows[0]["named"] == {"Bid #": "1", "Title": "A & b more", "": ""} and list(rows[0]["hrefs"]) == [None, "d?a=1&b=2", None]
    assert grids.table_rows(pages, ["absent"]).count() == 0 and grids.table_rows(pages, []).count() == 6
    assert [tuple(r) for r in grids.grid_rows(GRID, ["bid #"])] == [(r["grid"], r["position"], list(r["cells"]), r["named"], list(r["hrefs"])) for r in rows]


def test_delimited_rows_equal_a_plain_reader(spark):
    body = '﻿Bid Number,Title ,Note\r\n1,"a, ""b""\nc",x\r\n,,\r\n2,d\r\n'
    pages = spark.createDataFrame([("s", 0, body), ("s", 1, ""), ("s", 2, None)], "source string, page int, body string")
    got = [dict(r["named"]) for r in grids.delimited(pages, ["bid number"]).orderBy("position").collect()]
    plain = [dict(zip([h.strip() for h in rows[0]], [" ".join(x.split()) for x in r])) for rows in [list(csv.reader(io.StringIO(body.lstrip("﻿"))))] for r in rows[1:] if any(r)]
    assert got == plain == [{"Bid Number": "1", "Title": 'a, "b" c', "Note": "x"}, {"Bid Number": "2", "Title": "d"}]
    with pytest.raises(Exception, match="headers changed, missing: agency"):
        grids.delimited(pages, ["agency"]).collect()


def test_embedded_json(spark):
    deep = {"a": '}{"\\', "layers": [{"name": 3}, {"k": [{"x": {"name": "grid", "rows": [1]}}]}, {"name": "grid", "rows": [2]}], "name": "top"}
    page = "<script>var x={}; var moInitialResponse = " + json.dumps(deep) + "; go({});</script>"
    rows = spark.createDataFrame([(1, page), (2, page[:-60]), (3, None), (4, "var moInitialResponse = none"), (5, 'var moInitialResponse={"a":"never')], "id int, body string")
    found = rows.select("id", embedded.embedded_object(F.col("body"), r"var\s+moInitialResponse\s*=\s*").alias("doc"))
    got = {r["id"]: r["doc"] for r in found.collect()}
    assert json.loads(got[1]) == deep and [got[i] for i in (2, 3, 4, 5)] == [None] * 4
    named = {n: {r["id"]: r["o"] for r in found.select("id", embedded.named_object(F.col("doc"), n).alias("o")).collect()} for n in ("grid", "top", "no")}
    assert json.loads(named["grid"][1]) == {"name": "grid", "rows": [1]} and json.loads(named["top"][1]) == deep and named["no"][1] is None and named["grid"][2] is None
    nested = '{"a":' * 900 + "1" + "}" * 900
    assert embedded.balanced(nested + "}", 0) == nested and embedded.balanced("{" * 9, 0) is None


def test_absolute_links(spark):
    from bidweave.sources.records import absolute

    cases = [(None, "https://a.org/b/c?d=1"), ("", "https://a.org/b/c?d=1"), ("javascript:x()", "https://a.org/b/c?d=1"), ("http://x.y/z", "http://x.y/z"), ("//x.y", "https://x.y"), ("/q", "https://a.org/q"), ("r/s", "https://a.org/b/r/s"), ("?e=2", "https://a.org/b/c?e=2")]
    rows = spark.createDataFrame([(h,) for h, _ in cases], "href string")
    assert [r[0] for r in rows.select(absolute("https://a.org/b/c?d=1", F.col("href"))).collect()] == [w for _, w in cases]


def landed(spark, tmp_path, rows):
    return landing.land(spark.createDataFrame(rows, "source string, page int, reported long, body string"), str(tmp_path / "pages"))


def swept(spark, tmp_path, rows, keys):
    told, parsed = portals.parse(landed(spark, tmp_path, rows), str(tmp_path / "parsed"), NOW, keys)
    made = portals.records(parsed, NOW)
    state = sweeps.counted(told, portals.item_keys(parsed), made, {k: p.gate for k, p in portals.portals(NOW).items()})
    return made, state


def test_projects_and_federal_notices(spark, tmp_path):
    projects = {"projects": [
        {"id": 1, "title": " Road ", "proposalDeadline": "2026-02-01T00:00:00Z", "postedAt": "2025-12-24T23:00:00Z", "type": "rfp", "template": {"title": "RFP form"}, "departmentName": "Works", "government": {"id": 9, "name": "City of X", "state": "ohio", "city": "X", "government": {"code": "x"}}},
        {"id": 2, "title": "Late", "proposalDeadline": "2025-02-01T00:00:00Z", "government": {"id": 9, "name": "State of X", "state": "OH"}}, {"id": 3, "title": "Soon", "comingSoon": True, "status": "closed", "government": {"id": 9}}, {"id": 4, "title": "Done", "status": "Awarded", "government": {"id": 9}},
        {"id": 5, "title": "Hidden", "isPrivate": True, "government": {"id": 9}}, {"id": 6, "title": "  ", "government": {"id": 9}},
    ]}
    federal = {"totalRecords": 3, "opportunitiesData": [
        {"noticeId": "n1", "title": "Boats", "active": "Yes", "type": "Solicitation", "postedDate": "2025-12-01", "responseDeadLine": "2026-01-05T17:00:00-05:00", "fullParentPathName": "DEFENSE.NAVY.YARD", "placeOfPerformance": {"city": {"name": "Kittery"}, "state": {"code": "ME"}}, "naicsCode": "336611", "typeOfSetAside": "SBA", "resourceLinks": ["a", "b"]},
        {"solicitationNumber": "s2", "title": "CANCELED: tents", "department": "Army", "placeOfPerformance": {"state": {"code": "Maine"}}}, {"title": "no id"},
    ]}
    made, _ = swept(spark, tmp_path, [("opengov_public", 0, None, json.dumps(projects)), ("sam_gov", 0, None, json.dumps(federal))], ["opengov_public", "sam_gov"])
    rows = {r["external_id"]: r for r in made.collect()}
    assert {k: r["status"] for k, r in rows.items()} == {"x:1": "open", "9:2": "closed", "9:3": "open", "9:4": "closed", "n1": "open", "s2": "closed"}
    one, notice, tents = rows["x:1"], rows["n1"], rows["s2"]
    assert (one["title"], one["agency"], one["agency_type"], one["state_code"], one["solicitation_type"], one["description"], str(one["issue_date"])) == ("Road", "City of X", "municipal", None, "RFP form", "Department: Works", "2025-12-24")
    assert (notice["agency"], notice["state_code"], notice["city"], notice["naics_codes"], notice["set_aside"], notice["source_url"]) == ("YARD", "ME", "Kittery", ["336611"], "SBA", "https://sam.gov/workspace/contract/opp/n1/view")
    assert (tents["agency"], tents["state_code"], tents["naics_codes"], tents["due_at"], tents["source_url"]) == ("Army", None, [], None, "https://sam.gov/content/opportunities")
    assert json.loads(notice["raw_payload"])["responseDeadLine"].startswith("2026-01-05") and len(notice["content_hash"]) == 64


def grid(ids):
    return json.dumps({"totalCount": 4, "data": [{"eventId": i, "eventName": f"Event {i}", "eventDueDate": "2026-03-01T10:00:00"} for i in ids]})


def test_a_broken_sweep_closes_nothing(spark, tmp_path):
    stored = spark.createDataFrame([("esm_posting_board_sd", i, s) for i, s in (("1", "open"), ("old", "open"), ("shut", "closed"), (None, "open"))], "source string, external_id string, status string")
    broken = {"short": [("1 2".split(), 0), (["3"], 1)], "twice": [("1 2".split(), 0), ("2 3".split(), 1)], "gap": [("1 2".split(), 0), ("3 4".split(), 2)], "unkeyed": [(["1", "2"], 0), (["3", " "], 1)]}
    for name, pages in {"whole": [("1 2".split(), 0), ("3 4".split(), 1)], **broken}.items():
        made, state = swept(spark, tmp_path / name, [("esm_posting_board_sd", n, None, grid(ids)) for ids, n in pages], ["esm_posting_board_sd"])
        assert state.first()["complete"] == (name == "whole"), name
        gone = sweeps.closable(stored, made, state, ["esm_posting_board_sd"]).collect()
        assert [r["external_id"] for r in gone] == (["old"] if name == "whole" else []), name
        assert sweeps.closable(stored, made, state, []).count() == 0
        if name == "whole":
            assert sweeps.checked(made, state).count() == 4 and sweeps.complete_only(made, state).count() == 4
        else:
            assert sweeps.complete_only(made, state).count() == 0
            with pytest.raises(Exception, match="sweep of esm_posting_board_sd is not complete: reported 4, rows"):
                sweeps.checked(made, state).collect()


def test_observed_counts(spark):
    rows, seen = sweeps.observed(spark.createDataFrame([("a",), (None,)], "item_key string"), "sweep")
    rows.collect()
    assert seen.get == {"rows": 2, "keys": 1}


def test_families_and_the_calendar_of_washington(spark, tmp_path):
    assert {"periscope_or", "cgi_advantage_wv", "webs_wa", "nebraska_das_ne"} <= portals.portals(NOW).keys()
    page = """<table><tr><td>1/5/2026<br>12/20/2025</td><td>Road salt Ref#: 26-RFP-1 Includes an Inclusion Plan: Y<a href="d?i=1">more</a></td><td>x</td><td>City of Yakima</td></tr>
    <tr><td>Close</td><td>Ref#: 9</td><td>City</td></tr><tr><td>12/31/2025</td><td>Ref#: 26-7</td><td></td></tr><tr><td>12/30/25</td><td>Old Ref#: 26-8</td><td>A</td></tr></table>"""
    rows = {r["external_id"]: r for r in swept(spark, tmp_path, [("webs_wa", 0, None, page)], ["webs_wa"])[0].collect()}
    assert set(rows) == {"26-RFP-1", "26-7"}, "six hours of grace after the last second of the day in the portal's zone"
    one = rows["26-RFP-1"]
    assert (one["title"], one["agency"], one["agency_type"], one["solicitation_type"], one["source_url"], str(one["issue_date"])) == ("Road salt", "City of Yakima", "municipality", "RFP", "https://pr-webs-vendor.des.wa.gov/d?i=1", "2025-12-20")
    assert (rows["26-7"]["title"], rows["26-7"]["agency"]) == ("26-7", "State of Washington")
