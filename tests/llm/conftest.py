"""A small table of documents with every awkward case, and a wider one of generated words."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string, slot string, cell string, fp string, key string, body string"


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in every column, empty, blank and very long texts, repeats, and clashing column names."""
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 7)))
    texts = [None, "", " \t\n", "one", "One two", "one two three", "a\n\na\nb\nb \n", "x" * 5000, " " * 3000, "é" * 300 + " 漢字 😀"]
    texts += [" ".join(word() for _ in range(rnd.randint(1, 400))) for _ in range(60)]
    base = " ".join(word() for _ in range(300))
    texts += [base] * 25 + [base + " tail"] * 3 + [base.upper()]
    texts += ["the same eight words stand here again now " * 40, "# $ * " * 30, " ".join(word() for _ in range(60_000))]
    rows = [(i if i != 11 else None, t, "en", "s", None, "9", "9", "9", "9", "9", "9") for i, t in enumerate(texts)]
    rows += [rows[20], rows[20], (3, None, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
