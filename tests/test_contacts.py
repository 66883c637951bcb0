"""Contacts by lines: addresses and names of the lines around, numbers that stand across two lines."""

from bidweave.operators import evidence

LINES = ["Ann Carter", "IT Director", "ann@x.org, 555 123", "4567", "z", "CIO", "q.", "joe.van-dam@y.org", "5 5", "x", "COO", "b@y.org", "Zed Young (555) 111-2222 z@y.org", "CTO"]


def told(spark):
    rows = [(k, i, text) for k in (1, 2) for i, text in enumerate(LINES)]
    return evidence.contacts(spark.createDataFrame(rows[::-1], "page_id long, line int, content string").repartition(3))


def test_contacts_of_lines(spark):
    rows = told(spark).orderBy("page_id", "line").collect()
    assert [tuple(r)[1:] for r in rows if r["page_id"] == 1] == [
        (1, "Ann Carter", "IT Director", "Technology", "ann@x.org", "555 123 4567", 88),
        (5, "Joe Van Dam", "CIO", "Technology", "joe.van-dam@y.org", None, 88),
        (10, "Zed Young", "COO", "Facilities", "b@y.org", "(555) 111-2222", 88),
        (13, "Zed Young", "CTO", "Technology", "b@y.org", "(555) 111-2222", 88),
    ]
    assert [tuple(r)[1:] for r in rows if r["page_id"] == 2] == [tuple(r)[1:] for r in rows if r["page_id"] == 1]


def test_a_line_is_searched_once(spark):
    plan = told(spark)._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.count("superintendent|technology") <= 2, "names: of a line, and of an address"
