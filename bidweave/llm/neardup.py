"""SimHash near-duplicates by a self-join of the binary trie of fingerprints.

The trie of all distinct fingerprints is cut at a depth that follows their number. A task gets one
pair of subtrees whose prefixes differ in no more bits than the error budget, walks their nodes
together from the top, adds up the differing bits, and leaves a pair of nodes as soon as the budget
is exceeded. Inside a task linked fingerprints are merged at once, so a dense group of copies gives
as many links as it has members, not their square; the components over all tasks are then found by
rounds of joins.

Edge cases: null and empty texts have fingerprint zero and are linked like any other; repeated
rows share their class; null ids take part, but a class id is the least id that is not null; an
empty table gives an empty result; columns besides id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected
from .staging import scratch, stage

BITS = 64
SHINGLE = 3
MAX_ERRORS = 2
SEED = 42
SUBTREE = 1 << 18
LEAST_DEPTH = 3  # some subtrees for the tasks of a small table
FRONTIER = 1 << 18
LEAF_PRODUCT = 16


def _digests(text: bytes | None, width: int, seed: int) -> bytes:
    """Big-endian XXH64 of every shingle of the lower-cased words, one after another."""
    words = (text or b"").lower().split()  # of bytes: A-Z only, and the six ASCII white space characters
    if len(words) <= width:
        return xxhash.xxh64_digest(b" ".join(words), seed) if words else b""
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    start = end - size
    joined, digest = memoryview(b" ".join(words)), xxhash.xxh64_digest
    spans = zip(start[: len(words) - width + 1].tolist(), end[width - 1 :].tolist())
    return b"".join([digest(joined[a:b], seed) for a, b in spans])


def _majority(hashes: np.ndarray) -> int:
    """Unsigned number of the bits that over half of the big-endian ``hashes`` (bytes, 8 columns) set."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 65_536):
        ones += np.unpackbits(hashes[at : at + 65_536], axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes)).view(">u8")[0])


def simhash(text: bytes | None, width: int = SHINGLE, seed: int = SEED) -> int:
    """Fingerprint as a signed 64-bit number; ``text`` is UTF-8."""
    value = _majority(np.frombuffer(_digests(text, width, seed), np.uint8).reshape(-1, 8))
    return value - (1 << BITS) if value >> (BITS - 1) else value


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """``key`` and ``fp`` (long) of every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"key": batch["key"], "fp": [simhash(t, width, seed) for t in batch["body"]]})

    rows = docs.select(F.col(key).cast("string").alias("key"), F.col(text).cast("binary").alias("body"))
    return rows.mapInPandas(run, "key string, fp long").select(F.col("key").cast(docs.schema[key].dataType).alias(key), "fp")


class _Merged:
    """Union of positions by least root, over whole arrays of pairs."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def add(self, u: np.ndarray, v: np.ndarray) -> None:
        while True:
            ru, rv = self.root[u], self.root[v]
            apart = ru != rv
            if not apart.any():
                return
            u, v, ru, rv = u[apart], v[apart], ru[apart], rv[apart]
            np.minimum.at(self.root, np.maximum(ru, rv), np.minimum(ru, rv))
            while True:
                up = self.root[self.root]
                if (up == self.root).all():
                    break
                self.root = up


def trie_links(left: np.ndarray, right: np.ndarray | None, budget: int, depth: int = 0, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Links that join all fingerprints within ``budget`` bits of each other below ``depth``.

    ``left`` and ``right`` are distinct unsigned fingerprints (``right`` None: a self-join); the
    budget is what the bits above ``depth`` have left over. Returns the two ends of the links.
    """
    a = np.sort(left)
    alone = right is None
    b = a if alone else np.sort(right)
    every = a if alone else np.concatenate([a, b])
    shift_b = 0 if alone else len(a)
    merged = _Merged(len(every))
    whole = np.array([[0], [len(a)], [0], [len(b)], [0]], np.int64)
    stack = [(depth, whole)] if len(a) and len(b) else []
    ones: dict[tuple[int, bool], np.ndarray] = {}

    def ones_before(bit: int, of_b: bool) -> np.ndarray:
        if (bit, of_b) not in ones:
            values = b if of_b else a
            ones[bit, of_b] = np.concatenate([[0], np.cumsum((values >> np.uint64(BITS - 1 - bit)) & np.uint64(1))]).astype(np.int32)
        return ones[bit, of_b]

    while stack:
        level, nodes = stack.pop()
        if nodes.shape[1] > FRONTIER:
            stack += [(level, nodes[:, at : at + FRONTIER]) for at in range(0, nodes.shape[1], FRONTIER)]
            continue
        small = (nodes[1] - nodes[0]) * (nodes[3] - nodes[2]) <= LEAF_PRODUCT
        if level == bits:
            small[:] = True
        if small.any():
            _compare_leaves(a, b, nodes[:, small], merged, shift_b, budget, depth)
            nodes = nodes[:, ~small]
        if not nodes.shape[1]:
            continue
        a0, a1, b0, b1, errors = nodes
        ca, cb = ones_before(level, False), ones_before(level, not alone)
        am, bm = a1 - (ca[a1] - ca[a0]), b1 - (cb[b1] - cb[b0])
        below = [
            np.stack([a0, am, b0, bm, errors]),
            np.stack([am, a1, bm, b1, errors]),
            np.stack([a0, am, bm, b1, errors + 1]),
        ]
        crossed = np.stack([am, a1, b0, bm, errors + 1])
        below.append(crossed[:, a0 != b0] if alone else crossed)  # a node with itself has one crossed pair
        following = np.concatenate(below, axis=1)
        keep = (following[0] < following[1]) & (following[2] < following[3]) & (following[4] <= budget)
        following = following[:, keep]
        if following.shape[1]:
            stack.append((level + 1, following))
    at = np.flatnonzero(merged.root != np.arange(len(every)))
    return every[at], every[merged.root[at]]


def _compare_leaves(a: np.ndarray, b: np.ndarray, nodes: np.ndarray, merged: _Merged, shift_b: int, budget: int, depth: int) -> None:
    na, nb = nodes[1] - nodes[0], nodes[3] - nodes[2]
    pairs = na * nb
    at = np.repeat(np.arange(len(pairs)), pairs)
    k = np.arange(len(at)) - np.repeat(np.cumsum(pairs) - pairs, pairs)
    i, j = nodes[0][at] + k // nb[at], nodes[2][at] + k % nb[at]
    apart = merged.root[i] != merged.root[j + shift_b]
    i, j = i[apart], j[apart]
    low = np.uint64((1 << (BITS - depth)) - 1)
    near = np.bitwise_count((a[i] ^ b[j]) & low) <= budget
    merged.add(i[near], j[near] + shift_b)


def dealt_subtrees(classes: DataFrame, depth: int, max_errors: int, *keep: str) -> DataFrame:
    """``fp`` and ``keep`` once for each pair ``a``, ``b`` of subtrees at ``depth`` that may hold links."""
    masks = [sum(1 << i for i in c) for k in range(min(max_errors, depth) + 1) for c in combinations(range(depth), k)]
    prefix = F.shiftrightunsigned("fp", BITS - depth)
    dealt = classes.select("fp", *keep, prefix.alias("prefix"), F.explode(F.array(*(F.lit(m).cast("long") for m in masks))).alias("mask"))
    other = F.col("prefix").bitwiseXOR(F.col("mask"))
    return dealt.select("fp", *keep, F.least("prefix", other).alias("a"), F.greatest("prefix", other).alias("b"))


def links(classes: DataFrame, max_errors: int = MAX_ERRORS) -> DataFrame:
    """Links ``u``, ``v`` between distinct fingerprints ``fp`` that join all those within the budget."""
    depth = max(LEAST_DEPTH, (classes.count() // SUBTREE).bit_length())
    dealt = dealt_subtrees(classes, depth, max_errors)

    def join(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        a, b = int(key[0]), int(key[1])
        fp = group["fp"].to_numpy().view(np.uint64)
        if a == b:
            u, v = trie_links(fp, None, max_errors, depth)
        else:
            first = (fp >> np.uint64(BITS - depth)) == np.uint64(a)
            u, v = trie_links(fp[first], fp[~first], max_errors - (a ^ b).bit_count(), depth)
        return pd.DataFrame({"u": u.view(np.int64), "v": v.view(np.int64)})

    return dealt.groupBy("a", "b").applyInPandas(join, "u long, v long")


def components(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = SHINGLE, max_errors: int = MAX_ERRORS) -> DataFrame:
    """``key``, ``fp`` and ``component_id`` (least ``key`` that links reach) of every row."""
    with scratch(docs.sparkSession) as keep:
        marked, _ = stage(fingerprints(docs, text, key, width), "simhash")
        classes, _ = stage(marked.groupBy("fp").agg(F.min(key).alias("first")), "simhash-classes")
        roots = connected(links(classes, max_errors))
        rooted = classes.join(roots, classes["fp"] == roots["u"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
        rooted, _ = stage(rooted, "simhash-roots")
        least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
        named = rooted.join(least, "root").select("fp", "component_id")
        return keep(stage(marked.join(named, "fp").select(key, "fp", "component_id"), "simhash-components"))
