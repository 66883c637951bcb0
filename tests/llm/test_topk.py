import math
import random

from pyspark.sql import functions as F

from bidweave.llm import topk


def brute(rows, step):
    whole = [(i, r["vec_id"], [math.floor(1024 * x) for x in r["embedding"]]) for i, r in enumerate(rows) if r["embedding"] is not None and all(x is not None and math.isfinite(x) for x in r["embedding"])]
    out = []
    for i, q, v in whole:
        if q is None or q % step:
            continue
        ranked = sorted((-sum(a * b for a, b in zip(v, w)), math.inf if c is None else c) for j, c, w in whole if j != i)
        out += [(q, n + 1, None if c == math.inf else c, -s) for n, (s, c) in enumerate(ranked[:10])]
    return out


def same(table, step):
    rows = table.collect()
    got = [tuple(r) for r in topk.top_k(table, F.col("vec_id") % step == 0).collect()]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(got, key=key) == sorted(brute(rows, step), key=key)


def test_whole_table(spark):
    same(spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet"), 50)


def test_awkward_vectors(spark, monkeypatch):
    monkeypatch.setattr(topk, "ANNULUS", 16)
    rnd = random.Random(1)
    rows = [(i, [rnd.gauss(0, 1) for _ in range(8)], "x") for i in range(150)]
    rows += [(150 + i, [0.5] * 8, "x") for i in range(120)]
    rows += [(300, None, "x"), (310, [1.0, None] * 4, "x"), (320, [math.nan] * 8, "x"), (330, [math.inf] * 8, "x"), (None, [0.5] * 8, "x"), (340, [3.0], "x"), (350, [], "x")]
    rows += [(10, [9.0] * 8, "x"), (10, [9.0] * 8, "x"), (360, [5000.5] * 8, "x")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, id string").repartition(3)
    same(table, 10)


def test_few_or_no_rows(spark):
    table = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    same(table, 100)
    assert topk.top_k(table.where("false"), F.col("vec_id") % 100 == 0).collect() == []


def test_clustered_vectors_leave_annuli_shut(spark, monkeypatch):
    """Far from its own cluster a query opens nothing: the bounds stop it, and the result stays whole."""
    monkeypatch.setattr(topk, "ANNULUS", 16)
    rnd = random.Random(3)
    centres = [[rnd.gauss(0, 3) for _ in range(12)] for _ in range(20)]
    rows = [(i, [x + rnd.gauss(0, 0.05) for x in centres[i % 20]]) for i in range(2000)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    counts = []
    got = topk.top_k(table, F.col("vec_id") % 50 == 0, counts=counts).collect()
    assert sorted(map(tuple, got)) == sorted(brute(table.collect(), 50))
    assert sum(n for n, _ in counts) < 0.3 * counts[0][1]
    assert counts[-1][0] < counts[0][1]
