import zlib
from collections import Counter, defaultdict

from bidweave.llm import sharding


def smallest(sizes, shards):
    """Least capacity by trying one candidate after another."""
    low = max([*sizes, -(-sum(sizes) // shards)])
    while True:
        used, at = 1, 0
        for s in sizes:
            if at + s > low:
                used, at = used + 1, 0
            at += s
        if used <= shards:
            return low
        low += 1


def held(rows, docs, shards):
    expected = Counter()
    for r in docs.collect():
        text = (r["text"] or "").encode()
        expected[r["doc_id"], len(text) + 1, zlib.crc32(text)] += 1
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == expected
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(slots) <= set(range(shards))
    homes = defaultdict(set)
    for r in rows:
        homes[r["size"], r["text_crc32"]].add(r["shard"])
    assert all(len(h) == 1 for h in homes.values())


def capacity(spark, docs, shards):
    import hashlib

    groups = Counter()
    for r in docs.collect():
        text = (r["text"] or "").encode()
        groups[hashlib.md5(text).hexdigest()] += len(text) + 1
    return smallest([groups[k] for k in sorted(groups)], shards)


def test_whole_and_minimal(spark, docs, awkward):
    for table in (docs, awkward):
        for shards in (16, 3):
            rows = sharding.assign(table, shards=shards).collect()
            held(rows, table, shards)
            total = Counter()
            for r in rows:
                total[r["shard"]] += r["size"]
            assert max(total.values()) <= capacity(spark, table, shards)


def test_capacity_is_found_exactly_from_coarse_cells(spark, docs, monkeypatch):
    sizes = [((i * 7919) % 97 + 1) * (50 if i == 40 else 1) for i in range(700)]
    ends, at = [], 0
    for s in sizes:
        at += s
        ends.append((at,))
    monkeypatch.setattr(sharding, "CELLS", 20)
    table = spark.createDataFrame(ends, "end long")
    for shards in (2, 7, 16):
        found, cuts = sharding.smallest_capacity(table, at, max(sizes), shards)
        assert found == smallest(sizes, shards)
        edges = [0, *cuts, at]
        assert max(b - a for a, b in zip(edges, edges[1:])) <= found and set(cuts) <= {0, *(e for e, in ends)}


def test_empty(nothing):
    assert sharding.assign(nothing).collect() == []
