import random
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest

from bidweave.llm import toxicity
from bidweave.llm.queries import op1_toxicity


def plain_kernel(s, t):
    def weights(x):
        out = defaultdict(float)
        for at in combinations(range(len(x)), toxicity.ORDER):
            out["".join(x[i] for i in at)] += toxicity.DECAY ** (at[-1] - at[0] + 1)
        return out

    a, b = weights(s), weights(t)
    return sum(w * b[u] for u, w in a.items()) / (sum(w * w for w in a.values()) * sum(w * w for w in b.values())) ** 0.5


def test_kernel_and_collapsed_form_against_all_subsequences():
    rnd = random.Random(2)
    words = ["".join(rnd.choice("abcde") for _ in range(rnd.randint(3, 9))) for _ in range(30)]
    tokens = toxicity.coded(words)
    kernel = toxicity.Kernel(tokens[:8])
    want = np.array([[plain_kernel(w, m) for m in words[:8]] for w in words])
    assert kernel.values(tokens) == pytest.approx(want)
    alpha = np.linspace(-1, 1, 8)
    model = toxicity.Model(kernel.collapsed(alpha), 0.25, 1.0, 0.0)
    assert model.token_margins(tokens) == pytest.approx(want @ alpha + 0.25, abs=1e-4)
    marked = np.array([[plain_kernel(toxicity.FIRST + w + toxicity.LAST, m) for m in words[:8]] for w in words])
    assert model.margins([w.encode() for w in words]) == pytest.approx((marked @ alpha + 0.25).tolist(), abs=1e-4)


def test_machine_separates():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 4))
    y = np.sign(x @ np.array([1, -2, 0.5, 0]) + 0.3)
    w = toxicity.squared_hinge(x, y, np.full(300, 10.0))
    assert (np.sign(x @ w[:-1] + w[-1]) == y).mean() > 0.97


@pytest.fixture(scope="module")
def scored(spark):
    sf = "/root/testdata/sf0.01"
    rows = op1_toxicity(spark, sf).collect()
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    return rows, labels


def test_held_out_accuracy(scored):
    rows, labels = scored
    assert len(rows) == 1000
    pairs = [(r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert len(pairs) > 50 and sum(p == y for p, y in pairs) / len(pairs) > 0.95


@pytest.fixture(scope="module")
def small_model(spark):
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    return toxicity.train(docs, spark.read.parquet(f"{sf}/labels.parquet"), limit=1500)


def test_gapped_insults(small_model):
    texts = ["on the ere {} anthe".format(w) for w in ("idiot", "i.d.i.o.t", "id-iot", "i d i o t", "Moron!", "w_o_r_thless", "l-oser")]
    assert min(small_model.probabilities([t.encode() for t in texts])) > 0.5


def test_awkward_rows(spark, small_model, awkward, nothing):
    model = small_model
    assert max(model.probabilities([b"", b"on the ere thonanthe", "überchen geist".encode()])) < 0.5
    rows = awkward.withColumn("score", toxicity.score(awkward, model)).collect()
    assert len(rows) == awkward.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.fit([], []).probabilities([b"x", b""]).tolist() == pytest.approx([0, 0], abs=1e-9)
    assert nothing.withColumn("score", toxicity.score(nothing, model)).collect() == []
    labels = spark.createDataFrame([(1, None), (None, 1), (3, 0)], "doc_id long, toxic int")
    assert toxicity.train(awkward, labels).probabilities([b"any"])[0] < 0.5


def test_gaps_of_any_letters_and_width():
    for text, insult in (("c r é t i n", "crétin"), ("on и д и о т on", "идиот"), ("that i  d  i \n o\tt there", "idiot"), ("id io t", "idiot"), ("the i d i o t of", "idiot")):
        assert insult in {t.decode() for t in toxicity.text_tokens(text.encode())}, text
    assert f"{toxicity.FIRST}idiot{toxicity.LAST}" in toxicity.readings("i##d##i##o##t")
    assert toxicity.text_tokens(b"an idiot") == [b"an", b"idiot"]


def test_labels_without_usable_texts_use_up_no_places(spark):
    docs = spark.createDataFrame([(i, f"text {i}" if i % 2 else "long " * 30_000) for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 3 % 2) for i in range(1000)], "doc_id long, toxic int")
    assert toxicity.sample(docs, labels, limit=40).count() == 40
    assert toxicity.sample(docs, labels, limit=40, most_bytes=100).count() <= 100 / len("text 1")
