import math
import zlib
from collections import Counter

import pytest

from bidweave.llm import ngram_lm
from bidweave.llm.ngram_lm import DISCOUNTED, Unigrams, discounts


def tokens(text):
    return (text or "").encode().lower().split() + [None]


class Plain:
    """The same model, word by word with dictionaries."""

    def __init__(self, texts):
        self.words, self.pairs = Counter(), Counter()
        for t in texts:
            w = tokens(t)
            self.words.update(w)
            self.pairs.update(zip(["<s>", *w], w))
        self.n, self.v = sum(self.words.values()), len(self.words)
        of = lambda c: [sum(x == r for x in c.values()) for r in range(1, DISCOUNTED + 2)]
        self.lower = Unigrams(self.n, self.v, of(self.words))
        self.ratio = discounts(of(self.pairs))
        self.total, self.lost, self.seen = Counter(), Counter(), Counter()
        for (h, w), c in self.pairs.items():
            self.total[h] += c
            self.lost[h] += (1 - self.ratio[min(c, DISCOUNTED + 1)]) * c
            self.seen[h] += self.one(w)

    def one(self, w):
        c = self.words[w]
        return self.lower.ratio[min(c, DISCOUNTED + 1)] * c / self.lower.below if c else self.lower.other

    def two(self, h, w):
        if not self.total[h]:
            return self.one(w)
        below = self.total[h] + (self.lost[h] == 0)
        c = self.pairs[h, w]
        if c:
            return self.ratio[min(c, DISCOUNTED + 1)] * c / below
        return (self.lost[h] or 1) / below / (1 - self.seen[h]) * self.one(w)


def is_held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def compare(table):
    rows = table.collect()
    model = Plain([r["text"] for r in rows if not is_held(r["doc_id"])])
    want = []
    for r in rows:
        w = tokens(r["text"])
        base = sum(math.log10((model.words[x] + 1) / (model.n + model.v + 1)) for x in w)
        score = sum(math.log10(model.two(h, x)) for h, x in zip(["<s>", *w], w))
        want.append((str(r["doc_id"]), is_held(r["doc_id"]), len(w), sum(model.words[x] > 0 for x in w), model.n, base, score))
    got = [tuple([str(r[0]), *r[1:]]) for r in ngram_lm.score(table).collect()]
    assert len(got) == len(want)
    for a, b in zip(sorted(got), sorted(want)):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9)
    return model


def test_against_dictionaries(docs, awkward, nothing):
    model = compare(docs)
    compare(awkward)
    assert ngram_lm.score(nothing).collect() == []
    known = [*model.words, "never seen"]
    for h in ["<s>", *list(model.words)[:5], "never seen"]:
        assert sum(model.two(h, w) for w in known) == pytest.approx(1)


def test_held_out_text_is_likelier_than_under_the_base(docs):
    rows = [r for r in ngram_lm.score(docs).collect() if r["held_out"]]
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)
