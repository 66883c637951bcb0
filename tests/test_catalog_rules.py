"""Classification and document rules on small rows."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from bidweave.functions import classify
from bidweave.operators import documents


@pytest.mark.parametrize(
    "family, name, kind",
    [
        ("open_portals", "Austin ISD", "k12"), ("open_portals", "Isdale Bridge", "local_agency"), ("open_portals", "City of York", "municipal"), ("periscope", "Cook County", "county"), ("california", "California State University", "higher_ed"),
        ("alabama", "Education Department", "k12"), ("oklahoma", "Career and Tech Education", "higher_ed"), ("louisiana", "Caddo Parish", "county"), ("virginia", "County of Fairfax", "local_government"), ("florida", "School of Law", "education"),
        ("new_york", "SUNY Albany", "higher_ed"), ("arizona", "Navajo Tribe", "municipality"), ("hawaii", "Board of Water Supply", "local_agency"), ("advantage", "Troy Township", "municipality"), ("advantage", "Treasury", "state_agency"),
    ],
)
def test_agency_types(spark, family, name, kind):
    row = spark.createDataFrame([(name,)], "n string").select(classify.agency_type(F.col("n"), family)).first()
    assert row[0] == kind


@pytest.mark.parametrize("family, title, kind", [("louisiana", "rfp for roofs", "RFP"), ("louisiana", "Request for Information", "RFI"), ("texas", "601-RFPCSP-1", "RFP"), ("arkansas", "S-1-IFB", "Invitation for Bids"), ("delaware", "Invitation to Bid", "ITB"), ("new_york", "sole source: x", "Sole Source Notice"), ("texas", "roofs", "Public solicitation")])
def test_solicitation_types(spark, family, title, kind):
    assert spark.createDataFrame([(title,)], "t string").select(classify.solicitation_type(F.col("t"), family)).first()[0] == kind


def test_status_and_confidence(spark):
    now = datetime(2026, 1, 1)
    rows = [(1, datetime(2026, 2, 1), False, "closed"), (2, datetime(2025, 2, 1), True, "open"), (3, None, True, "closed"), (4, None, False, "Awarded"), (5, None, None, None)]
    frame = spark.createDataFrame(rows, "id int, d timestamp, soon boolean, s string")
    got = frame.select("id", classify.project_status(F.col("d"), F.col("soon"), F.col("s"), now).alias("x")).orderBy("id").collect()
    assert [r["x"] for r in got] == ["open", "closed", "open", "closed", "open"]
    live = spark.createDataFrame([("d", "n", "1", "s", "p", ["u"], "t")], "response_deadline string, solicitation_number string, naics_code string, set_aside string, place string, resource_links array<string>, description string")
    assert live.select(classify.live_confidence()).first()[0] == 78
    kept = "source_family string, due_at timestamp, solicitation_number string, naics_codes array<string>, set_aside string, city string, state_code string, resource_links array<string>, description string, pre_proposal_at timestamp, questions_due_at timestamp"
    full = spark.createDataFrame([("federal", now, "n", ["1"], "s", "c", None, ["u"], "t", None, None), ("sled", None, None, [], None, None, None, None, None, None, now)], kept)
    assert [r[0] for r in full.select(classify.stored_confidence()).collect()] == [78, 45]
    card = spark.createDataFrame([(90, ["a", "b", "c", "d"], 50, ["u"], ["v"]), (None, None, 50, ["u"], ["v"]), (None, None, 76, ["u"], ["v"])], "match_score int, match_reasons array<string>, confidence int, uncertainty array<string>, verified array<string>")
    assert [r[0] for r in card.select(classify.card_insight()).collect()] == ["a · b · c", "u", "v"]


def test_document_links(spark):
    base = "https://x.org/a/b.html"
    cases = {"/d.pdf": "https://x.org/d.pdf", "c.pdf": "https://x.org/a/c.pdf", "https://y.org/e": "https://y.org/e", "mailto:z": None, "//y.org/f": "https://y.org/f", "?q=1": "https://x.org/a/b.html?q=1"}
    frame = spark.createDataFrame([(base, h) for h in cases], "b string, h string")
    assert {r["h"]: r["x"] for r in frame.select("h", documents.absolute(F.col("b"), F.col("h")).alias("x")).collect()} == cases
    page = '<a href="/rfp.pdf">x</a><a href="/about">About us</a><a href="/s">Scope of work</a><a href="/rfp.pdf">again</a><a href="/deeper/solicitation">d</a>'
    pages = spark.createDataFrame([(1, base, page), (2, "https://x.org/deeper/solicitation", '<a href="spec.docx">s</a>')], "page_id long, url string, html string")
    found = documents.page_documents(pages)
    assert [r["target"] for r in found.where("page_id = 1").orderBy("pos").collect()] == ["https://x.org/rfp.pdf", "https://x.org/s", "https://x.org/deeper/solicitation"]
    assert {(r["start"], r["target"]) for r in documents.second_hop(pages, found).collect()} == {(1, "https://x.org/deeper/spec.docx")}
    urls = spark.createDataFrame([("https://10.0.0.1/x",), ("http://localhost/",), ("https://ok.org",), ("ftp://ok.org",)], "u string")
    assert [r[0] for r in urls.select(documents.is_public(F.col("u"))).collect()] == [False, False, True, False]
    records = spark.createDataFrame([(1, ["http://a", "http://a", "x"])], "id long, resource_links array<string>")
    new = documents.payload_links(records)
    assert documents.insert_absent(records.select("id", F.lit("http://b").alias("target")), new, ["id", "target"]).count() == 1
    stored = spark.createDataFrame([(1, "f", "old", "fetch_failed"), (1, "g", "old", "analyzed")], "id long, filename string, source_url string, extraction_status string")
    fresh = spark.createDataFrame([(1, "f", "new")], "id long, filename string, source_url string")
    got = {r["filename"]: (r["source_url"], r["extraction_status"]) for r in documents.refresh(stored, fresh, ["id", "filename"]).collect()}
    assert got == {"f": ("new", "cataloged"), "g": ("old", "analyzed")}
    heads = spark.createDataFrame([("%PDF-1", 5), ("PK..", 5), (" <!DOCTYPE html>", 5), ("%PDF", 1 << 30)], "h string, n long")
    assert [r[0] for r in heads.select(documents.fetched_kind(F.col("h"), F.col("n"))).collect()] == ["fetched", "fetched", "fetch_invalid", "fetch_too_large"]
