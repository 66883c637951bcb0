"""One document of each group of near copies: five-word shingles, Jaccard similarity of 0.8 or more.

Every text gets a SimHash of its distinct shingles. The self-join of the binary trie of fingerprints
(``neardup.links``) names texts that are very close, but at a similarity of 0.8 two fingerprints lie
ten bits apart on the mean, which no trie prunes. So its links are only the first candidates, and an
exact prefix filter adds the others: the shingles of every text are put into one global order, by
their number over all texts, rare ones first. Of two texts as alike as this, each holds their first
common shingle among its first fifth, and so early that what follows in either can still make up the
common part; so texts meet in the bucket of every such shingle, and no pair is missed. The numbers
are kept by a hash of CELLS values, a table of one size whatever the corpus; shingles that share a
cell only cost time, since any order gives the same pairs.

Candidates are held to a parity sketch first: of each text, one bit for each of at least 4 n buckets
says whether an odd number of shingles falls there. Buckets that differ never outnumber the shingles
that differ, so no pair of 0.8 fails. What is left is held to the exact similarity of the texts, but
of those found later and still between two groups only some at a time: each group tests one candidate
(in later rounds two, four and so on), those that pass are merged, and rounds go on until every
candidate is inside a group or refuted.

Texts that share much would give the square of their number. So each text first meets the hub of its
buckets alone (the text with most shared shingles: an original has more than its altered copies), and
only then every pair of a bucket is tested whose ends are still in two groups. Equal texts are one
node from the start, so copies are never compared.

Edge cases: null and empty texts are copies of each other; texts of fewer than five words are one
shingle; of rows equal in id and text one stays; ids that are null come after all others when the
document to keep is chosen; an empty table gives an empty result; all columns are kept, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import connected
from .neardup import BITS, SEED, _digests, _majority
from .neardup import links as trie_links_of
from .staging import scratch, stage

SHINGLE = 5
SIMILARITY = 0.8
CELLS = 1 << 21  # of the numbers of shingles
PARTS = 64  # that the cells are added up in
BUCKETS_A_SHINGLE = 4
HUB_ROWS = 2_000  # of a much tested text, candidates in one task's share
MOST_NUMBERS = 100_000  # numbers of texts are broadcast (16 bytes each) up to this many


def shingle_set(text: bytes | None) -> np.ndarray:
    """Distinct shingles of a text, hashed, in order."""
    return np.unique(np.frombuffer(_digests(text, SHINGLE, SEED), ">u8").astype("<u8"))


def similarity(x: np.ndarray, y: np.ndarray) -> float:
    if not len(x) and not len(y):
        return 1.0
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both)


def prefix(shingles: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """The first fifth of the shingles (and one) in the global order; of none, a zero."""
    if not len(shingles):
        return np.zeros(1, np.int64)
    times = numbers[shingles & np.uint64(CELLS - 1)]
    return shingles[np.lexsort((shingles, times))[: len(shingles) // 5 + 1]].view("<i8")


def parity(shingles: np.ndarray) -> bytes:
    """One bit for each bucket: whether an odd number of shingles falls there."""
    buckets = 64
    while buckets < BUCKETS_A_SHINGLE * len(shingles):
        buckets *= 2
    at = (shingles & np.uint64(buckets - 1)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=buckets).astype(np.uint8) & 1).tobytes()


def differing(a: bytes, b: bytes) -> int:
    """Buckets of odd difference, over as many as the smaller sketch has."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _numbers(plain: DataFrame) -> np.ndarray:
    """For each cell, how many texts hold its shingles, over all of ``plain``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = np.zeros(CELLS, np.uint32)
        for batch in batches:
            for body in batch["body"]:
                cells = shingle_set(body) & np.uint64(CELLS - 1)
                np.add.at(count, cells, 1)
        yield pd.DataFrame({"part": range(PARTS), "count": [x.tobytes() for x in np.split(count, PARTS)]})

    def add(parts: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(CELLS // PARTS, np.uint64)
        for x in parts["count"]:
            total += np.frombuffer(x, np.uint32)
        return pd.DataFrame({"part": parts["part"].iloc[:1], "count": [np.minimum(total, np.iinfo(np.uint32).max).astype(np.uint32).tobytes()]})

    rows = plain.select("body").mapInPandas(run, "part int, count binary").groupBy("part").applyInPandas(add, "part int, count binary").collect()
    return np.frombuffer(b"".join(bytes(r["count"]) for r in sorted(rows, key=lambda r: r["part"])) or bytes(4 * CELLS), np.uint32)


def _texts(plain: DataFrame) -> DataFrame:
    """One row for each distinct text: number, digest, shingles, fingerprint, prefix and parity sketch."""
    numbers = plain.sparkSession.sparkContext.broadcast(_numbers(plain))  # 8 MB

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [shingle_set(t) for t in batch["body"]]
            fp = np.array([_majority(s.astype(">u8").view(np.uint8).reshape(-1, BITS // 8)) for s in sets], np.uint64).view(np.int64)
            yield pd.DataFrame({"digest": batch["digest"], "n": list(map(len, sets)), "fp": fp, "prefix": [prefix(s, numbers.value) for s in sets], "parity": list(map(parity, sets))})

    made = plain.select("digest", "body").mapInPandas(run, "digest binary, n long, fp long, prefix array<long>, parity binary")
    return made.dropDuplicates(["digest"]).withColumn("tid", F.monotonically_increasing_id())


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u < v").distinct()


def _trie_pairs(texts: DataFrame) -> DataFrame:
    """Candidates by the trie of fingerprints; texts of one fingerprint are tied to the first of them."""
    first, _ = stage(texts.groupBy("fp").agg(F.min("tid").alias("first")), "copy-classes")
    near = trie_links_of(first).join(first.toDF("u", "a"), "u").join(first.toDF("v", "b"), "v").select(F.col("a").alias("u"), F.col("b").alias("v"))
    same = texts.select("tid", "fp").join(first, "fp").select(F.col("first").alias("u"), F.col("tid").alias("v"))
    return near.union(same)


def _able(left: Column, n: Column, other_left: Column, other_n: Column) -> Column:
    """Whether what follows a common shingle can make two texts alike enough: 9 common >= 4 (n + n)."""
    return 9 * F.least(left, other_left) >= 4 * (n + other_n)


def _hub_pairs(shared: DataFrame) -> DataFrame:
    """For each text the hub that it meets in most buckets."""
    weights = shared.groupBy("tid").agg(F.count("*").alias("weight"))
    weighed = shared.join(weights.hint("merge"), "tid")
    hub = F.max(F.struct("weight", (-F.col("tid")).alias("minus"), "n", "left")).over(Window.partitionBy("h"))
    met = weighed.withColumn("hub", hub).where((F.col("tid") != -F.col("hub.minus")) & _able(F.col("left"), F.col("n"), F.col("hub.left"), F.col("hub.n")))
    voted = met.groupBy("tid", (-F.col("hub.minus")).alias("hub")).agg(F.count("*").alias("votes"))
    best = voted.groupBy("tid").agg(F.max(F.struct("votes", (-F.col("hub")).alias("minus"))).alias("best"))
    return _ordered(best.select((-F.col("best.minus")).alias("u"), F.col("tid").alias("v")))


def _bucket_pairs(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """Every able pair of a bucket whose ends are in two groups."""
    rooted = shared.join(roots.toDF("tid", "root").hint("merge"), "tid", "left").withColumn("root", F.coalesce("root", "tid"))
    bucket = Window.partitionBy("h")
    apart = rooted.withColumn("low", F.min("root").over(bucket)).withColumn("high", F.max("root").over(bucket)).where("low < high")
    members, _ = stage(apart.select("h", "tid", "n", "left", "root"), "copy-apart")
    a, b = (members.select("h", *(F.col(c).alias(f"{c}_{side}") for c in ("tid", "n", "left", "root"))) for side in "ab")
    met = a.join(b.hint("merge"), "h").where((F.col("root_a") < F.col("root_b")) & _able(F.col("left_a"), F.col("n_a"), F.col("left_b"), F.col("n_b")))
    return _ordered(met.select(F.col("tid_a").alias("u"), F.col("tid_b").alias("v")))


def _small(numbers: DataFrame) -> DataFrame:
    """Broadcast where few enough, else joined by a shuffle."""
    return F.broadcast(numbers) if numbers.count() <= MOST_NUMBERS else numbers.hint("merge")


def _beside(pairs: DataFrame, table: DataFrame, *columns: str) -> DataFrame:
    """``pairs`` with ``columns`` of both ends; a text in many pairs is dealt to several tasks."""
    spread, _ = stage(pairs.groupBy("u").agg((F.count("*") / HUB_ROWS).cast("int").alias("shares")).where("shares > 0"), "copy-hubs")
    spread = _small(spread)
    nodes = _small(stage(pairs.select(F.col("u").alias("tid")).union(pairs.select("v")).distinct(), "copy-nodes")[0])
    table = table.select("tid", *columns).join(nodes, "tid", "left_semi")
    dealt = pairs.join(spread, "u", "left").withColumn("share", F.pmod(F.hash("v"), 1 + F.coalesce("shares", F.lit(0))))
    many = table.join(spread.withColumnRenamed("u", "tid"), "tid", "left").withColumn("share", F.explode(F.sequence(F.lit(0), F.coalesce("shares", F.lit(0)))))
    right = table.select(F.col("tid").alias("v"), *(F.col(c).alias(f"{c}_v") for c in columns))
    left = many.select(F.col("tid").alias("u"), "share", *(F.col(c).alias(f"{c}_u") for c in columns))
    return dealt.join(right.hint("merge"), "v").join(left.hint("merge"), ["u", "share"])


def _passing(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of ``pairs`` that the parity sketches let through."""

    @F.pandas_udf("long")
    def apart(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([differing(x, y) for x, y in zip(a, b)], dtype="int64")

    pairs, _ = stage(pairs, "copy-pairs")
    with_both = _beside(pairs, texts, "n", "parity")
    return with_both.where(9 * apart("parity_u", "parity_v") <= F.col("n_u") + F.col("n_v")).select("u", "v")


def _alike(pairs: DataFrame, bodies: DataFrame) -> DataFrame:
    """Those of ``pairs`` whose exact similarity suffices."""

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, own = None, None
        for batch in batches:
            keep = []
            for u, a, b in zip(batch["u"], batch["body_u"], batch["body_v"]):
                if u != known:
                    known, own = u, shingle_set(a)
                keep.append(similarity(own, shingle_set(b)) >= SIMILARITY)
            yield batch.loc[keep, ["u", "v"]]

    return _beside(pairs, bodies, "body").select("u", "v", "body_u", "body_v").mapInPandas(compare, "u long, v long")


def _joined(pairs: DataFrame, bodies: DataFrame, links: DataFrame) -> DataFrame:
    """The roots that ``links`` and those of ``pairs`` that were needed give: of pairs between
    two groups some for each group are tested at a time, until each joins nothing or has been refuted.
    Each round tests up to twice as many for a group as the one before, so that rounds stay few."""
    roots, most = connected(links), 1
    while True:
        left, right = roots.toDF("u", "ru").hint("merge"), roots.toDF("v", "rv").hint("merge")
        rooted = pairs.join(left, "u", "left").join(right, "v", "left").select("u", "v", F.coalesce("ru", "u").alias("ru"), F.coalesce("rv", "v").alias("rv"))
        pairs, _ = stage(rooted.where("ru <> rv"), "copy-open")
        if pairs.isEmpty():
            return roots
        ends = pairs.select("u", "v", F.col("ru").alias("r")).union(pairs.select("u", "v", F.col("rv").alias("r")))
        share = F.pmod(F.xxhash64("u", "v"), F.lit(most)).alias("share")
        picked, _ = stage(ends.groupBy("r", share).agg(F.min(F.struct("u", "v")).alias("p")).select("p.u", "p.v").distinct(), "copy-picked")
        most *= 2
        roots = connected(roots.toDF("u", "v").union(_alike(picked, bodies)))  # stars stand for the links they came of
        pairs = pairs.join(picked, ["u", "v"], "left_anti").select("u", "v")


def _roots(plain: DataFrame, texts: DataFrame) -> DataFrame:
    """``tid``, ``root`` of every text that verified links join to another one."""
    entries = texts.select("tid", "n", F.posexplode("prefix").alias("i", "h")).select("h", "tid", "n", (F.col("n") - F.col("i")).alias("left"))
    several = entries.withColumn("size", F.count("*").over(Window.partitionBy("h"))).where("size > 1").drop("size")
    shared, _ = stage(several, "copy-shared")
    first, _ = stage(_passing(_ordered(_trie_pairs(texts).union(_hub_pairs(shared))), texts), "copy-candidates")
    able = shared.select("tid").union(first.select("u")).union(first.select("v")).distinct()
    wanted = texts.select("tid", "digest").join(able.hint("merge"), "tid", "left_semi")
    bodies, _ = stage(plain.join(wanted.hint("merge"), "digest").dropDuplicates(["tid"]).select("tid", "body"), "copy-bodies")
    links, _ = stage(_alike(first, bodies), "copy-links")
    more, _ = stage(_passing(_bucket_pairs(shared, connected(links)), texts), "copy-candidates")
    return _joined(more, bodies, links).toDF("tid", "root")


def keep_one(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` without all but the least ``key`` of each group."""
    own, body = F.col(f"row.`{key}`"), F.coalesce(F.col(f"row.`{text}`"), F.lit("")).cast("binary")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")).withColumn("digest", F.unhex(F.md5(body)))
    plain = rows.select("digest", body.alias("body"))
    with scratch(docs.sparkSession) as keep:
        texts, _ = stage(_texts(plain), "copy-texts")
        roots = _roots(plain, texts)
        named = texts.select("digest", "tid").join(roots.hint("merge"), "tid", "left").select("digest", F.coalesce("root", "tid").alias("root"))
        counted = rows.select("digest", own.alias("key")).groupBy("digest", "key").agg(F.count("*").alias("n"))
        least = F.min(F.struct(F.col("key").isNull().alias("late"), "key", "digest", "n")).alias("one")
        first = counted.groupBy("digest").agg(least).join(named.hint("merge"), "digest").groupBy("root").agg(F.min("one").alias("one"))
        chosen = keep(stage(first.select("one.key", "one.digest", "one.n"), "copy-kept"))
    match = (rows["digest"] == chosen["digest"]) & own.eqNullSafe(chosen["key"])
    kept = rows.join(chosen.where("n = 1").hint("merge"), match, "left_semi").select("row")
    repeated = chosen.where("n > 1")
    if not repeated.isEmpty():
        again = rows.join(repeated.hint("merge"), match, "left_semi").groupBy("digest", own.alias("key")).agg(F.first("row").alias("row"))
        kept = kept.union(again.select("row"))
    return kept.select("row.*")
