"""Pipeline stages and the vote model on awkward rows, clashing names and empty tables."""

import pathlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from bidweave.llm import quality
from bidweave.llm.staging import shared_dir


@pytest.fixture(scope="module")
def odd(awkward, docs):
    """The awkward rows and plain documents, with columns named like what the operators add."""
    names = ("_key", "_text_id", "row", "digest", "quality", "kept", "vote_length", "y")
    return awkward.unionByName(docs, allowMissingColumns=True).withColumns({n: F.lit(f"own {n}") for n in names})


@pytest.fixture(scope="module")
def labelled(spark, awkward, tmp_path_factory):
    """A folder with labels for the awkward rows: null, repeated and unlike ones among them."""
    folder = str(tmp_path_factory.mktemp("labelled"))
    rows = [(i, i % 3 == 0, 1) for i in range(90)] + [(5, 1, 1), (5, 0, 1), (None, 1, 1), (7, None, None)]
    rows = [(i, None if t is None else int(t), q) for i, t, q in rows]
    spark.createDataFrame(rows, "doc_id long, toxic int, quality int").write.parquet(f"{folder}/labels.parquet")
    return folder


@pytest.mark.parametrize("place", [0, 1])
def test_filters_keep_whole_rows(spark, odd, nothing, labelled, place):
    _, step = corpus_pipeline.STAGES[place]
    after = step(spark, odd, labelled)
    assert after.columns == odd.columns
    rows, kept = Counter(map(str, odd.collect())), Counter(map(str, after.collect()))
    assert kept and not kept - rows
    assert all(kept[r] in (0, n) for r, n in rows.items()), "equal rows get one verdict"
    assert step(spark, nothing, labelled).collect() == []
    assert step(spark, nothing, labelled).columns == nothing.columns


@pytest.mark.parametrize("place", [2, 3])
def test_near_copies_and_packing_on_odd_rows(spark, odd, nothing, labelled, place):
    _, step = corpus_pipeline.STAGES[place]
    clash = odd.withColumns({n: F.lit(f"own {n}") for n in ("tid", "root", "body", "size", "n")})
    after = step(spark, clash, labelled)
    ids, kept = Counter(r["doc_id"] for r in clash.select("doc_id").collect()), Counter(r["doc_id"] for r in after.select("doc_id").collect())
    assert set(kept) <= set(ids)
    if place == 2:
        assert after.columns == clash.columns and not kept - ids
    else:
        assert set(kept) == set(ids)
    assert step(spark, nothing, labelled).collect() == []


def test_interleaved_stages_do_not_delete_each_others_tables(spark, docs, labelled):
    one = corpus_pipeline.quality_rules(spark, docs, labelled)
    two = corpus_pipeline.quality_rules(spark, docs.where("doc_id % 2 = 0"), labelled)
    fewer = corpus_pipeline.one_of_each(spark, two, labelled)
    assert one.count() > two.count() >= fewer.count() > 0 and one.count() > 0


def test_a_run_leaves_its_result_alone(spark):
    folder = pathlib.Path(shared_dir(spark))
    before = {p.name for p in folder.iterdir()}
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 0
    assert [n.rsplit("-", 1)[0] for n in {p.name for p in folder.iterdir()} - before] == ["pipeline-best_fit_packing"]


def test_quality_drops_null_and_short_texts(spark, odd, labelled):
    kept = corpus_pipeline.quality_rules(spark, odd, labelled).collect()
    assert all(r["text"] is not None and len(r["text"].split()) >= quality.MIN_WORDS for r in kept)


def plain_em(patterns, rounds):
    """Prior and vote tables by the same steps over a plain list of (votes, weight)."""
    names = [n for n, _, _ in quality.RULES]
    good = [0.95 if a == 0 else 0.3 if a == 1 else 0.05 for a in (sum(x == -1 for x in v) for v, _ in patterns)]
    before = None
    for _ in range(rounds):
        total = {1: sum(w * g for (_, w), g in zip(patterns, good)), 0: sum(w * (1 - g) for (_, w), g in zip(patterns, good))}
        prior = (total[1] + quality.SMOOTHING) / (total[1] + total[0] + 2 * quality.SMOOTHING)
        tables = []
        for k in range(len(names)):
            t = {y: {x: (sum(w * (g if y else 1 - g) for (v, w), g in zip(patterns, good) if v[k] == x) + quality.SMOOTHING) / (total[y] + 3 * quality.SMOOTHING) for x in (-1, 0, 1)} for y in (0, 1)}
            if t[1][-1] > t[0][-1]:
                both = {x: prior * t[1][x] + (1 - prior) * t[0][x] for x in (-1, 0, 1)}
                t = {0: both, 1: both}
            tables.append(t)
        good = []
        for v, _ in patterns:
            p1, p0 = prior, 1 - prior
            for k, x in enumerate(v):
                p1, p0 = p1 * tables[k][1][x], p0 * tables[k][0][x]
            good.append(p1 / (p1 + p0))
        flat = [prior, *(t[y][x] for t in tables for y in (0, 1) for x in (-1, 0, 1))]
        if before and max(abs(a - b) for a, b in zip(flat, before)) < quality.SETTLED:
            break
        before = flat
    return good


def test_posterior_equals_plain_em(spark, docs):
    names = [f"vote_{n}" for n, _, _ in quality.RULES]
    rows = quality.score(docs).collect()
    open_cases = Counter(tuple(r[n] for n in names) for r in rows if not r["base_failed"])
    patterns = sorted(open_cases.items())
    want = dict(zip((v for v, _ in patterns), plain_em(patterns, quality.ROUNDS)))
    for r in rows:
        if not r["base_failed"]:
            votes = tuple(r[n] for n in names)
            assert abs(r["quality"] - want[votes]) < 1e-3
            assert r["kept"] == (r["quality"] >= quality.THRESHOLD)
        else:
            assert not r["kept"]
