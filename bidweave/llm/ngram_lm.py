"""Katz backoff language model: Good-Turing discounts, exactly normalised backoff weights.

Documents are dealt into text blocks by a hash of their content. A block meets the model only as
packed arrays of distinct hashed keys, so what is shuffled is one entry for each distinct word or
pair of a block, spread evenly over key ranges whatever the words are:

1. Blocks send their distinct words and word pairs with training counts; each key range adds them
   up, writes its part of the count tables, and answers every block with the totals. Of the blocks
   that hold a pair, one is named its owner.
2. Owners add up, for each context word, the discounted mass and the unigram probability of its
   seen continuations; key ranges add these sums and answer with the backoff weight.
3. Blocks score their tokens: a seen pair by its discounted frequency, an unseen one by the
   context's backoff weight times the probability one order down, which ends in a single class for
   all words never seen in training.

The words of an order-2 model are told apart by 64-bit hashes. Every pass reads and shuffles the
text once, and its shuffle files are deleted with the end of its write (``staging.stage``); no pass gathers more than one block or one key range in a task, and only sums come to
the driver.

Edge cases: null and empty texts hold the end token alone; null ids are scored and never held out;
repeated rows each count; an empty table gives an empty result; columns besides id and text are not
read. Where counts of counts are too thin for Good-Turing ratios, a count r is discounted by
(r - 1/2) / r instead.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import drop_stage, shuffle_width, stage

RANGE_BYTES = 20 << 20  # text for each key range
BLOCKS_PER_RANGE = 2
DISCOUNTED = 5  # counts up to this are discounted
HELD_OUT_OF = 7
HELD_OUT = 2
START, END = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
WORDS, PAIRS = 1, 2


def _pack(values: np.ndarray) -> bytes:
    """Byte planes compress far better than whole numbers."""
    return zstandard.compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T).tobytes(), 1)


def _unpack(data: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _pack_keys(keys: np.ndarray) -> bytes:
    return _pack(np.diff(keys, prepend=np.uint64(0)))


def _unpack_keys(data: bytes) -> np.ndarray:
    return np.cumsum(_unpack(data, "<u8"), dtype=np.uint64)


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of ordered pairs of hashes."""
    h = a * np.uint64(0x9E3779B97F4A7C15) ^ (b + np.uint64(0x165667B19E3779F9)) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        out = self[word] = xxhash.xxh3_64_intdigest(word)
        return out


class Block:
    """Tokens of some documents: ``words`` and ``pairs`` are their distinct keys in order."""

    def __init__(self, bodies: list[bytes | None], trains: np.ndarray):
        hashes, parts, lengths = _Hashes(), [], []
        end = np.array([END])
        for body in bodies:
            split = (body or b"").lower().split()  # of bytes: A-Z only, ASCII white space only
            parts += [np.fromiter(map(hashes.__getitem__, split), np.uint64, len(split)), end]
            lengths.append(len(split) + 1)
        tokens = np.concatenate(parts)
        self.lengths = np.array(lengths)
        before = np.concatenate([[START], tokens[:-1]])
        first = np.cumsum(self.lengths) - self.lengths
        before[first] = START
        self.train = np.repeat(trains, self.lengths)
        self.words, self.word_at = np.unique(tokens, return_inverse=True)
        self.pairs, at, self.pair_at = np.unique(_mix(before, tokens), return_index=True, return_inverse=True)
        # contexts: index in words, or one past them for the start of a text
        self.context_at = np.concatenate([[0], self.word_at[:-1]])
        self.context_at[first] = len(self.words)
        self.pair_context, self.pair_word = self.context_at[at], self.word_at[at]

    def counts(self, at: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(at[self.train], minlength=n)

    def context_keys(self) -> tuple[np.ndarray, np.ndarray]:
        """Contexts' hashes in order, and where each stands in ``context_at``'s numbering."""
        every = np.append(self.words, START)
        order = np.argsort(every, kind="stable")
        return every[order], order


def _slices(keys: np.ndarray, parts: int) -> list[tuple[int, int, int]]:
    """Even ranges of the key space that hold some of the sorted ``keys``."""
    edges = np.array([(p << 64) // parts for p in range(1, parts)], np.uint64)
    at = [0, *np.searchsorted(keys, edges).tolist(), len(keys)]
    return [(p, at[p], at[p + 1]) for p in range(parts) if at[p] < at[p + 1]]


def _gather(replies: pd.DataFrame, kind: int) -> list[bytes]:
    own = replies[replies["kind"] == kind]
    return own.sort_values("part")["data"].tolist()


def discounts(counts_of_counts: list[int], most: int = DISCOUNTED) -> np.ndarray:
    """Katz's ratio for counts 0 to ``most`` + 1 and beyond (index ``most`` + 1: no discount)."""
    n = [0, *counts_of_counts]
    out = np.ones(most + 2)
    top = (most + 1) * n[most + 1] / n[1] if n[1] else 1.0
    for r in range(1, most + 1):
        ratio = ((r + 1) * n[r + 1] / (r * n[r]) - top) / (1 - top) if n[r] and top < 1 else 0.0
        out[r] = ratio if 0 < ratio < 1 else (r - 0.5) / r
    return out


class Unigrams:
    """Probabilities one order down: discounted words, and one class for all others."""

    def __init__(self, total: int, distinct: int, counts_of_counts: list[int]):
        self.total, self.distinct = total, distinct
        self.ratio = discounts(counts_of_counts)
        lost = sum((1 - self.ratio[r]) * r * counts_of_counts[r - 1] for r in range(1, DISCOUNTED + 1))
        self.below = total + (lost == 0)
        self.other = (lost or 1.0) / self.below

    def probability(self, counts: np.ndarray) -> np.ndarray:
        seen = self.ratio[np.minimum(counts, DISCOUNTED + 1)] * counts / self.below
        return np.where(counts > 0, seen, self.other)


def held_out(key: str) -> Column:
    """True where the checksum of the id, as text, has the held-out remainder."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % HELD_OUT_OF == HELD_OUT, F.lit(False))


def score(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``."""
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("string").alias("key"), held_out(key).alias("held"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("body"))
    size = rows.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    parts = max(shuffle_width(spark), -(-size // RANGE_BYTES))
    dealt = F.pmod(F.xxhash64("key", "body"), F.lit(BLOCKS_PER_RANGE * parts)).cast("int")
    blocks = rows.withColumn("block", dealt).groupBy("block")

    def load(group: pd.DataFrame) -> Block:
        return Block(group["body"].tolist(), ~group["held"].to_numpy(dtype=bool))

    def ask(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        block, out = load(group), []
        for kind, keys, at in ((WORDS, block.words, block.word_at), (PAIRS, block.pairs, block.pair_at)):
            counts = block.counts(at, len(keys)).astype("<u4")
            out += [(kind, p, key[0], _pack_keys(keys[a:b]), _pack(counts[a:b])) for p, a, b in _slices(keys, parts)]
        return pd.DataFrame(out, columns=["kind", "part", "block", "keys", "counts"])

    def add_up(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        kind, part = key
        group = group.sort_values("block")
        asked = [_unpack_keys(x) for x in group["keys"]]
        counts = np.concatenate([_unpack(x, "<u4") for x in group["counts"]])
        keys, first, at = np.unique(np.concatenate(asked), return_index=True, return_inverse=True)
        total = np.bincount(at, weights=counts, minlength=len(keys)).astype(np.int64)
        answer = 2 * total[at]
        answer[first] += 1  # the first asker owns the key
        ends = np.cumsum([len(x) for x in asked])
        out = [("reply", kind, part, block, b"", _pack(a.astype("<u8")), None) for block, a in zip(group["block"], np.split(answer, ends[:-1]))]
        seen = total > 0
        stats = [int(total.sum()), int(seen.sum()), *(int((total == r).sum()) for r in range(1, DISCOUNTED + 2))]
        out.append(("counts", kind, part, -1, _pack_keys(keys[seen]), _pack(total[seen].astype("<u8")), stats))
        return pd.DataFrame(out, columns=["what", "kind", "part", "block", "keys", "data", "stats"])

    asked = blocks.applyInPandas(ask, "kind int, part int, block int, keys binary, counts binary")
    added = asked.groupBy("kind", "part").applyInPandas(add_up, "what string, kind int, part int, block int, keys binary, data binary, stats array<long>")
    table, table_path = stage(added, "ngram-counts", partition_by=("what", "kind"))
    sums = table.where("what = 'counts'").groupBy("kind").agg(*(F.sum(F.get("stats", F.lit(i))).alias(f"s{i}") for i in range(DISCOUNTED + 3)))
    stats = {r["kind"]: [r[f"s{i}"] for i in range(DISCOUNTED + 3)] for r in sums.collect()}
    empty = [0] * (DISCOUNTED + 3)
    lower = Unigrams(*stats.get(WORDS, empty)[:2], stats.get(WORDS, empty)[2:])
    ratio = discounts(stats.get(PAIRS, empty)[2:])

    replies = table.where("what = 'reply'").select("kind", "part", "block", "data")

    def totals(answers: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        words = np.concatenate([_unpack(x, "<u8") for x in _gather(answers, WORDS)]).astype(np.int64)
        pairs = np.concatenate([_unpack(x, "<u8") for x in _gather(answers, PAIRS)]).astype(np.int64)
        return words >> 1, pairs >> 1, (pairs & 1).astype(bool)

    def contexts(key: tuple, group: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        block = load(group)
        words, pairs, owned = totals(answers)
        mine = owned & (pairs > 0)
        at, c, w = block.pair_context[mine], pairs[mine], block.pair_word[mine]
        keys, order = block.context_keys()
        lost = np.bincount(at, (1 - ratio[np.minimum(c, DISCOUNTED + 1)]) * c, len(keys))[order]
        seen = np.bincount(at, lower.probability(words)[w], len(keys))[order]
        total = np.bincount(at, c, len(keys)).astype("<u8")[order]
        out = [(p, key[0], _pack_keys(keys[a:b]), _pack(lost[a:b]), _pack(seen[a:b]), _pack(total[a:b])) for p, a, b in _slices(keys, parts)]
        return pd.DataFrame(out, columns=["part", "block", "keys", "lost", "seen", "total"])

    def weigh(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("block")
        asked = [_unpack_keys(x) for x in group["keys"]]
        keys, at = np.unique(np.concatenate(asked), return_inverse=True)
        lost, seen, total = (np.bincount(at, np.concatenate([_unpack(x, kind) for x in group[name]]), len(keys)) for name, kind in (("lost", "<f8"), ("seen", "<f8"), ("total", "<u8")))
        below = total + (lost == 0)  # one count is kept back where nothing is discounted
        weight = np.where(total > 0, np.where(lost > 0, lost, 1.0) / below / np.maximum(1 - seen, 1e-300), 1.0)
        ends = np.cumsum([len(x) for x in asked])[:-1]
        out = [(key[0], block, _pack(np.ascontiguousarray(w)), _pack(b.astype("<u8"))) for block, w, b in zip(group["block"], np.split(weight[at], ends), np.split(below[at], ends))]
        return pd.DataFrame(out, columns=["part", "block", "weight", "below"])

    summed = blocks.cogroup(replies.groupBy("block")).applyInPandas(contexts, "part int, block int, keys binary, lost binary, seen binary, total binary")
    weighed = summed.groupBy("part").applyInPandas(weigh, "part int, block int, weight binary, below binary")
    backoff, backoff_path = stage(weighed, "ngram-backoff")

    columns = ["kind", "part", "block", "data", "below"]
    every = replies.withColumn("below", F.lit(None).cast("binary")).select(*columns)
    every = every.union(backoff.select(F.lit(0).alias("kind"), "part", "block", F.col("weight").alias("data"), "below"))

    def evaluate(key: tuple, group: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        block = load(group)
        words, pairs, _ = totals(answers)
        own = answers[answers["kind"] == 0].sort_values("part")
        _, order = block.context_keys()
        weight, below = np.empty(len(order)), np.empty(len(order))
        weight[order] = np.concatenate([_unpack(x, "<f8") for x in own["data"]])
        below[order] = np.concatenate([_unpack(x, "<u8") for x in own["below"]])
        unigram = lower.probability(words)
        seen = ratio[np.minimum(pairs, DISCOUNTED + 1)] * pairs / np.maximum(below[block.pair_context], 1)
        pair = np.log10(np.where(pairs > 0, seen, weight[block.pair_context] * unigram[block.pair_word]))
        base = np.log10((words + 1) / (lower.total + lower.distinct + 1))
        doc = np.repeat(np.arange(len(block.lengths)), block.lengths)
        n = len(block.lengths)
        return pd.DataFrame({
            "key": group["key"], "held": group["held"], "n_tokens": block.lengths,
            "n_known": np.bincount(doc, words[block.word_at] > 0, n).astype(np.int64), "train_tokens": lower.total,
            "base_score": np.bincount(doc, base[block.word_at], n), "score": np.bincount(doc, pair[block.pair_at], n),
        })

    made = blocks.cogroup(every.groupBy("block")).applyInPandas(evaluate, "key string, held boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    out, _ = stage(made.select(F.col("key").cast(docs.schema[key].dataType).alias(key), F.col("held").alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"), "ngram-scores")
    drop_stage(spark, table_path)
    drop_stage(spark, backoff_path)
    return out
