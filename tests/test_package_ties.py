"""Documents that share an id: what is first among them does not rest on the order of the rows."""

import pytest

from bidweave.operators import packages

DOCS = "opportunity_id long, id long, filename string, fetched_at timestamp, extraction_status string, is_missing boolean, storage_key string, source_url string"
FILES = [(1, 7, name, None, "pending", True, None, f"https://s/{url}") for name, url in (("b.doc", 3), ("a.PDF", 2), ("b.doc", 1), ("b.doc", 2))]


@pytest.mark.parametrize("turned", [False, True])
def test_evidence_of_one_id(spark, turned):
    docs = spark.createDataFrame(FILES[::-1] if turned else FILES, DOCS).coalesce(1)
    asked = spark.createDataFrame([(5, 1, 7, True, 0)], "id long, opportunity_id long, document_id long, mandatory boolean, created_at long")
    got = packages.requirement_evidence(asked, docs).orderBy("place").collect()
    assert [(r["filename"], r["url"][-1]) for r in got] == [("a.PDF", "2"), ("b.doc", "1"), ("b.doc", "2"), ("b.doc", "3")]


@pytest.mark.parametrize("turned", [False, True])
def test_summary_of_one_id(spark, turned):
    docs = spark.createDataFrame(FILES[::-1] if turned else FILES, DOCS).coalesce(1)
    (got,) = packages.document_summary(docs, most=3).collect()
    assert got["identified"] == 4 and [(d["filename"], d["url"][-1]) for d in got["documents"]] == [("a.PDF", "2"), ("b.doc", "1"), ("b.doc", "2")]


def test_requirements_of_no_document_stay_out_of_the_join(spark):
    rows = [(i, None if i % 2 else i, "document_text") for i in range(200)] + [(900, 4, "portal"), (901, 4, None), (902, 4, "document_text"), (903, None, None)]
    asked = spark.createDataFrame(rows, "id long, document_id long, source string")
    again = spark.createDataFrame([(4,), (4,), (6,), (None,)], "document_id long")
    got = packages.without_text_requirements(asked, again)
    assert got.columns == asked.columns and sorted(r["id"] for r in got.collect()) == [i for i in range(200) if i not in (4, 6)] + [900, 901, 903]
    joined = str(got._jdf.queryExecution().optimizedPlan().toString()).split("Join LeftAnti")[1]
    assert "isnotnull(document_id" in joined
