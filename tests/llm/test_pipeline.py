import random
from collections import Counter
from functools import cache

import pytest

import corpus_pipeline
from bidweave.llm import nearcopies
from bidweave.llm.queries import pipeline


@cache
def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def alike(a, b):
    x, y = shingles(a), shingles(b)
    return x == y or len(x & y) >= 0.8 * len(x | y)


def groups(texts):
    root = {t: t for t in texts}

    def find(t):
        while root[t] != t:
            t = root[t]
        return t

    names = sorted(root, key=str)
    for i, a in enumerate(names):
        for b in names[:i]:
            if alike(a, b):
                root[find(a)] = find(b)
    return {t: find(t) for t in names}


def check(table):
    rows = table.collect()
    root = groups({r["text"] or "" for r in rows})
    kept = nearcopies.keep_one(table).collect()
    assert not Counter(map(str, kept)) - Counter(map(str, rows))
    members = {}
    for r in rows:
        members.setdefault(root[r["text"] or ""], []).append((r["doc_id"] is None, r["doc_id"] or 0))
    got = Counter(root[r["text"] or ""] for r in kept)
    assert got == dict.fromkeys(members, 1)
    assert {root[r["text"] or ""]: (r["doc_id"] is None, r["doc_id"] or 0) for r in kept} == {g: min(m) for g, m in members.items()}


def test_one_of_each_group(spark, docs, awkward, nothing):
    check(docs)
    check(awkward)
    assert nearcopies.keep_one(nothing).collect() == []
    assert nearcopies.keep_one(awkward).columns == awkward.columns


def stages(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    before = docs
    kept = {}
    for name, step in corpus_pipeline.STAGES[:-1]:
        after = step(spark, before, sf)
        assert after.columns == docs.columns
        kept[name] = {r["doc_id"] for r in after.select("doc_id").collect()}
        assert kept[name] <= {r["doc_id"] for r in before.select("doc_id").collect()}
        before = after
    good = {i for i, r in labels.items() if r["quality"] == 1}
    assert len(good & kept["quality_rules"]) > 0.95 * len(good)
    judged = kept["quality_rules"] & labels.keys()
    toxic = {i for i in judged if labels[i]["toxic"] == 1}
    assert len((judged - toxic) & kept["toxicity"]) > 0.98 * len(judged - toxic)
    packed = {r["doc_id"] for r in pipeline(spark, sf).collect()}
    assert packed == kept["simhash_neardup"]
    return toxic, kept["toxicity"]


@pytest.fixture(scope="module")
def staged(spark):
    return stages(spark)


def test_stages(staged):
    assert staged


@pytest.mark.xfail(strict=True, reason="known gap: 11 of 41 labelled toxic texts stay when some 300 texts teach the machine")
def test_few_toxic_texts_stay(staged):
    toxic, kept = staged
    assert len(toxic & kept) <= 0.1 * len(toxic)


def kept_of(spark, texts):
    return nearcopies.keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()


def words(rnd, n):
    return [f"w{rnd.randrange(10**6)}" for _ in range(n)]


def test_groups_that_only_their_originals_hold_together(spark):
    """Members match the original at 0.8 or more and each other hardly ever, so a link with any other root fails."""
    rnd = random.Random(5)
    texts = []
    for _ in range(12):
        original = words(rnd, 400)
        for _ in range(15):
            changed = list(original)
            for i in rnd.sample(range(400), 8):
                changed[i] = f"x{rnd.randrange(10**6)}"
            texts.append(" ".join(changed))
        texts.append(" ".join(original))
    root = groups(set(texts))
    assert len(kept_of(spark, texts)) == len(set(root.values()))


def test_every_near_copy_is_found(spark):
    """Appended passages at 0.80 to 0.85 and repeated lines, each pair a group of its own."""
    rnd = random.Random(6)
    texts = []
    for k in range(150):
        base = words(rnd, 300)
        texts += [" ".join(base), " ".join(base + words(rnd, 54 + k % 20))]
    for _ in range(20):
        lines = [" ".join(words(rnd, 12)) for _ in range(30)]
        texts += ["\n".join(lines), "\n".join(lines + lines[:1] * 400)]
    root = groups(set(texts))
    assert len(set(root.values())) == 170
    assert len(kept_of(spark, texts)) == 170
