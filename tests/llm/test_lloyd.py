import hashlib
import math

import numpy as np

from bidweave.llm import lloyd

SCHEMA = "vec_id long, embedding array<float>, label int, key string, packed string, cluster string"


def plain(rows, centroids=8, rounds=10, size=64):
    points = []
    for i, v in rows:
        if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v):
            points.append((i, [math.floor(1024 * float(x)) for x in v]))
    drawn = sorted(points, key=lambda p: (p[0] is None, hashlib.sha256(f"3:{p[0]}".encode()).hexdigest() if p[0] is not None else "", np.array(p[1], "<i4").tobytes()))
    now = [list(v) for _, v in drawn[:centroids]]
    apart = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    near = lambda v: min((apart(v, c), k) for k, c in enumerate(now))
    for _ in range(rounds):
        members = {}
        for _, v in points:
            members.setdefault(near(v)[1], []).append(v)
        now = [[sum(x) // len(members[k]) for x in zip(*members[k])] if k in members else c for k, c in enumerate(now)]
    out = [(i, near(v)[1], near(v)[0]) for i, v in points]
    inertia = {k: sum(d for _, c, d in out if c == k) for k in range(len(now))}
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in now]
    return sorted(((i, k, d, inertia[k], sum(inertia.values()), names[k]) for i, k, d in out), key=str)


def held(table):
    got = [tuple(r) for r in lloyd.cluster(table).collect()]
    assert sorted(got, key=str) == plain([(r["vec_id"], r["embedding"]) for r in table.collect()])
    return got


def test_against_plain_lloyd(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    assert len(held(table)) == 500
    assert len(held(table.repartition(7))) == 500


def awkward_vectors():
    rnd = np.random.default_rng(4)
    good = [(i, rnd.normal(size=64).astype(np.float32).tolist()) for i in range(40)]
    bad = [(100, None), (101, []), (102, [1.0] * 63), (103, [1.0] * 65), (104, [1.0] * 63 + [None]), (105, [float("nan")] * 64), (106, [float("inf")] + [0.0] * 63)]
    return good + bad + [(None, good[0][1]), (7, good[7][1]), (200, [-0.0005] * 64), (201, [1000.0] * 64), (202, [-131071.0] * 64)]


def test_awkward_vectors(spark):
    rows = [(i, v, None, "x", "y", "z") for i, v in awkward_vectors()]
    assert len(held(spark.createDataFrame(rows, SCHEMA).repartition(3))) == 45


def test_few_equal_and_no_vectors(spark):
    one = [0.5] * 64
    assert held(spark.createDataFrame([], SCHEMA)) == []
    assert len(held(spark.createDataFrame([(1, one, 0, "", "", "")], SCHEMA))) == 1
    equal = held(spark.createDataFrame([(i, one, 0, "", "", "") for i in range(30)], SCHEMA))
    assert {r[1] for r in equal} == {0}  # ties go to the lowest number; the other centroids stay where they are
    assert len(held(spark.createDataFrame([(i, [float(i)] * 64, 0, "", "", "") for i in range(5)], SCHEMA))) == 5


def test_too_large_components_take_no_part(spark):
    rows = [(1, [0.5] * 64), (2, [131072.0] * 64), (3, [3e38] * 64)]
    assert [r["vec_id"] for r in lloyd.cluster(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()] == [1]
