import random

import numpy as np
import xxhash

from bidweave.llm import components, neardup


def fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(fps, budget):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    fps = sorted(root)
    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= budget and find(a) != find(b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {f: find(f) for f in fps}


def check(table):
    rows = [(r["doc_id"], fingerprint(r["text"])) for r in table.collect()]
    root = classes({f for _, f in rows}, 2)
    first = {}
    for i, f in rows:
        if i is not None:
            first[root[f]] = min(first.get(root[f], i), i)
    want = sorted((str(i), f, str(first.get(root[f]))) for i, f in rows)
    got = sorted((str(r["doc_id"]), r["fp"] % (1 << 64), str(r["component_id"])) for r in neardup.components(table).collect())
    assert got == want


def test_against_all_pairs(docs, awkward, nothing):
    for table in (docs, awkward, nothing):
        check(table)


def test_trie_join_against_all_pairs(spark, monkeypatch):
    rnd = random.Random(5)
    fps = {rnd.getrandbits(64) for _ in range(1500)}
    for f in list(fps)[:300]:
        for _ in range(3):
            f ^= sum(1 << b for b in rnd.sample(range(64), rnd.randint(1, 3)))
            fps.add(f)
    fps |= {(0xABC << 50) | sum(1 << b for b in rnd.sample(range(12), 3)) for _ in range(200)}
    want = classes(fps, 2)
    u, v = neardup.trie_links(np.array(sorted(fps), np.uint64), None, 2)
    root = {f: f for f in fps}
    for a, b in zip(u.tolist(), v.tolist()):
        root[max(a, b)] = min(a, b)
    for f in sorted(fps):
        root[f] = root[root[f]]
    assert root == want
    monkeypatch.setattr(neardup, "SUBTREE", 64)
    table = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f, i) for i, f in enumerate(fps)], "fp long, first long")
    from bidweave.llm.components import connected

    found = {r["u"] % (1 << 64): r["root"] % (1 << 64) for r in connected(neardup.links(table)).collect()}
    groups = {}
    for f in fps:
        groups.setdefault(want[f], set()).add(f)
    got = {}
    for f in fps:
        got.setdefault(found.get(f, f), set()).add(f)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, groups.values()))


def test_rounds_end_with_stars(spark, monkeypatch):
    """Links that are stars already cost no round; others none that changes nothing."""
    made = []
    real = components.stage
    monkeypatch.setattr(components, "stage", lambda df, label: made.append(label) or real(df, label))

    def roots(links):
        made.clear()
        return dict(map(tuple, components.connected(spark.createDataFrame(links, "u long, v long")).collect()))

    assert roots([(1, 2), (3, 1), (1, 3), (7, 7), (5, 9)]) == {2: 1, 3: 1, 9: 5} and len(made) == 1
    assert roots([(1, 2), (2, 3)]) == {2: 1, 3: 1} and len(made) == 2
    assert roots([]) == {} and len(made) == 1
    rnd = random.Random(5)
    links = [(rnd.randrange(400), rnd.randrange(400)) for _ in range(250)] + [(i, i + 1) for i in range(500, 560)]
    least = {n: n for link in links for n in link}
    for _ in least:
        for u, v in links:
            least[u] = least[v] = min(least[u], least[v])
    assert roots(links) == {n: r for n, r in least.items() if n != r}
