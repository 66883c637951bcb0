import itertools
import math
import random
from collections import defaultdict

import pytest

from bidweave.llm import packing


def held(rows, docs, lengths):
    want = sorted((r["doc_id"] is None, r["doc_id"] or 0, len((r["text"] or "").encode().split()) + 1) for r in docs.collect())
    pieces = defaultdict(int)
    for r in rows:
        pieces[r["bin_id"]] += r["length"]
    by_bin = defaultdict(list)
    for r in rows:
        by_bin[r["bin_id"]].append(r)
    for members in by_bin.values():
        at = 0
        for r in sorted(members, key=lambda r: r["bin_offset"]):
            assert r["bin_offset"] == at
            at += r["length"]
        assert members[0]["bin_length"] == min(x for x in lengths if x >= at)
    total = sum(n for *_, n in want)
    assert sum(r["length"] for r in rows) == total
    return total / sum(m[0]["bin_length"] for m in by_bin.values())


def test_whole_and_tight(spark, docs, awkward):
    for table in (docs, awkward):
        rows = packing.pack(table).collect()
        assert held(rows, table, packing.LENGTHS) > 0.9
    spans = defaultdict(list)
    for r in packing.pack(docs).collect():
        spans[r["doc_id"]].append((r["start"], r["length"]))
    for r in docs.collect():
        at = 0
        for start, n in sorted(spans[r["doc_id"]]):
            assert start == at
            at += n
        assert at == len(r["text"].encode().split()) + 1


def plain(sizes, order, lengths):
    """Best fit by looking through all open bins; the room of each bin, what is in it, and its length."""
    bins, left = [], sum(sizes)
    for i in order:
        fits = [b for b in bins if b[0] >= sizes[i]]
        if fits:
            b = min(fits, key=lambda b: b[0])
        else:
            opened = min((x for x in lengths if x >= sizes[i]), key=lambda x: (packing.sequence_cost(x) / min(x, left), x))
            b = [opened, 0]
            bins.append(b)
        b[0] -= sizes[i]
        b[1] += sizes[i]
        left -= sizes[i]
    return bins


def test_best_fit_matches_a_plain_search():
    sizes = [(i * 37) % 90 + 1 for i in range(400)]
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    bins, offsets, used = packing._best_fit(sizes, order, [64, 128], packing.sequence_cost)
    assert sorted(used) == sorted(b[1] for b in plain(sizes, order, [64, 128]))
    for b in range(len(used)):
        spans = sorted((offsets[i], sizes[i]) for i in range(len(sizes)) if bins[i] == b)
        assert [s for s, _ in spans] == [sum(n for _, n in spans[:k]) for k in range(len(spans))]


def test_lengths_are_chosen_together():
    """No set of the permitted lengths gives a cheaper packing than the one returned."""
    rnd = random.Random(4)
    lengths, better = (64, 128, 256, 512), 0
    for _ in range(40):
        sizes = [min(512, int(rnd.paretovariate(0.9) * rnd.choice((5, 20, 60)))) for _ in range(rnd.randint(1, 120))]
        order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
        prices = {}
        for n in range(1, 5):
            for chosen in itertools.combinations(lengths, n):
                if chosen[-1] >= max(sizes):
                    prices[chosen] = sum(packing.sequence_cost(min(x for x in lengths if x >= used)) for _, used in plain(sizes, order, chosen))
        _, _, final = packing.pack_block(sizes, lengths, packing.sequence_cost)
        assert sum(map(packing.sequence_cost, final)) == pytest.approx(min(prices.values()))
        better += min(prices.values()) < min(prices.get(lengths[k:], math.inf) for k in range(4))
    assert better  # sets with a gap are worth it


def test_repeated_rows_are_told_apart(awkward):
    rows = packing.pack(awkward).collect()
    assert len({r["row_no"] for r in rows}) == awkward.count()
    assert len({(r["row_no"], r["piece"]) for r in rows}) == len(rows)


def test_empty_and_small_blocks(nothing, docs, monkeypatch):
    assert packing.pack(nothing).collect() == []
    sizes = [5, 3, 8, 1, 1]
    bins, offsets, final = packing.pack_block(sizes, (4, 8), packing.sequence_cost)
    assert len(bins) == len(offsets) == 5 and sum(final) >= sum(sizes) and set(final) <= {4, 8}
