"""Length-limited canonical Huffman files of token ids.

Global counts of the ids (at most one row for each id of the vocabulary) give code lengths by
package-merge; lengths alone fix the canonical code. A file folder holds ``blocks`` (Parquet rows of
whole documents: keys, lengths, bit offsets of every STEP-th id, coded bits) in ascending order of
the key, and ``code`` (id, length). Every block decodes on its own, all its stretches at once.

Edge cases: null and empty texts give the end id alone; rows with a null key come first; repeated
keys and rows are all kept; an empty table gives empty files; columns besides key and text are not
read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .staging import shuffle_width, stage
from .wordtokens import encoder

END_ID = 1
LONGEST = 16
STEP = 128
BLOCK = 1 << 17
IDS = "<u2"


def code_lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Best code lengths of at most ``longest`` bits for positive ``counts`` (package-merge)."""
    n = len(counts)
    if n < 2:
        return np.ones(n, np.int64)
    longest = max(longest, (n - 1).bit_length())
    order = np.argsort(counts, kind="stable")
    weights = np.asarray(counts, np.int64)[order]
    level, leaf_counts = weights, []
    for _ in range(longest - 1):
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([weights, pairs])
        rank = np.argsort(both, kind="stable")
        leaf_counts.append(np.cumsum(rank < n))
        level = both[rank]
    lengths, take = np.zeros(n, np.int64), 2 * n - 2
    for leaves in reversed(leaf_counts):
        used = int(leaves[take - 1]) if take else 0
        lengths[:used] += 1
        take = 2 * (take - used)
    lengths[:take] += 1
    out = np.empty(n, np.int64)
    out[order] = lengths
    return out


class Code:
    """Canonical code of ``ids`` with ``lengths``."""

    def __init__(self, ids: list[int], lengths: list[int]):
        size = max(ids, default=0) + 1
        self.length = np.zeros(size, np.uint64)
        self.bits = np.zeros(size, np.uint64)
        self.width = max(lengths, default=1)
        order = sorted(zip(lengths, ids))
        code, last, entries = 0, 0, []
        for length, i in order:
            code <<= length - last
            self.length[i], self.bits[i], last = length, code, length
            code += 1
            entries.append((i << 5 | length, 1 << (self.width - length)))
        table = np.repeat(np.array([e for e, _ in entries], np.int64), [k for _, k in entries]) if entries else np.zeros(0, np.int64)
        self.table = np.concatenate([table, np.full((1 << self.width) - len(table), 1, np.int64)])

    def encode(self, ids: np.ndarray) -> tuple[bytes, bytes]:
        """Bit offsets of every STEP-th id, and the coded bits."""
        length = self.length[ids]
        after = np.cumsum(length)
        at = after - length
        word, shifted = (at >> np.uint64(5)).astype(np.int64), self.bits[ids] << (np.uint64(64) - length - (at & np.uint64(31)))
        first = np.concatenate([[0], np.flatnonzero(word[1:] != word[:-1]) + 1])
        out = np.zeros(int(after[-1]) // 32 + 2, np.uint64)
        out[word[first]] += np.add.reduceat(shifted >> np.uint64(32), first)  # codes do not overlap: sums are unions
        out[word[first] + 1] += np.add.reduceat(shifted & np.uint64(0xFFFFFFFF), first)
        return at[::STEP].astype("<u4").tobytes(), out.astype(">u4").tobytes()

    def decode(self, offsets: bytes, payload: bytes, n: int) -> np.ndarray:
        """The ``n`` ids of a block; one table step for all its stretches at a time."""
        data = np.frombuffer(payload, ">u4").astype(np.int64)
        at = np.frombuffer(offsets, "<u4").astype(np.int64)
        out = np.empty((STEP, len(at)), np.dtype(IDS))
        last, mask = len(data) - 2, (1 << self.width) - 1
        for step in range(min(STEP, n)):
            word = np.minimum(at >> 5, last)
            low = at & 31
            window = (data[word] << (low + 16)) & 0xFFFFFFFFFFFF | (data[word + 1] << 16) >> (32 - low)
            entry = self.table[(window >> (48 - self.width)) & mask]
            out[step] = entry >> 5
            at = at + (entry & 31)
        return out.T.reshape(-1)[:n]


def token_ids(docs: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id", end_id: int = END_ID) -> DataFrame:
    """``key`` (as text) and ``ids`` (little-endian 16-bit, the end id last) of every row."""
    end = np.array([end_id], IDS).tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            coded = encoder(tokenizer).encode([t or b"" for t in batch["body"]])
            yield pd.DataFrame({"key": batch["key"], "ids": [c + end for c in coded]})

    rows = docs.select(F.col(key).cast("string").alias("key"), F.col(text).cast("binary").alias("body"))
    return rows.mapInPandas(run, "key string, ids binary")


def count_ids(rows: DataFrame) -> DataFrame:
    """``id``, ``n`` over all rows; each task sends one row for each id it has met."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(batch["ids"]), IDS), minlength=len(total))
        at = np.flatnonzero(total)
        yield pd.DataFrame({"id": at, "n": total[at]})

    return rows.select("ids").mapInPandas(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


_BLOCK_SCHEMA = "part int, block int, start long, n long, keys array<string>, sizes array<long>, offsets binary, bits binary"


def write_files(rows: DataFrame, key_type: str, path: str) -> None:
    """Code ``rows`` (``key``, ``ids``) to ``path`` in ascending order of the key, read as ``key_type``."""
    spark = rows.sparkSession
    counts = count_ids(rows).orderBy("id").collect()  # bounded by the vocabulary
    ids = [r["id"] for r in counts]
    lengths = [int(x) for x in code_lengths(np.array([r["n"] for r in counts], np.int64))]
    spark.createDataFrame(list(zip(ids, lengths)), "id int, length int").coalesce(1).write.parquet(f"{path}/code")

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        code, part = Code(ids, lengths), TaskContext.get().partitionId()
        block, start, keys, held, size = 0, 0, [], [], 0

        def close() -> pd.DataFrame:
            offsets, bits = code.encode(np.frombuffer(b"".join(held), IDS))
            sizes = [len(x) // 2 for x in held]
            return pd.DataFrame({"part": [part], "block": [block], "start": [start], "n": [size], "keys": [keys], "sizes": [sizes], "offsets": [offsets], "bits": [bits]})

        for batch in batches:
            for key, coded in zip(batch["key"], batch["ids"]):
                keys.append(key)
                held.append(coded)
                size += len(coded) // 2
                if size >= BLOCK:
                    yield close()
                    block, start, keys, held, size = block + 1, start + size, [], [], 0
        if held:
            yield close()

    order = [F.col("key").cast(key_type).asc_nulls_first(), F.xxhash64("ids")]
    dealt = rows.repartitionByRange(shuffle_width(spark), *order).sortWithinPartitions(*order)
    dealt.mapInPandas(fill, _BLOCK_SCHEMA).write.option("compression", "zstd").parquet(f"{path}/blocks")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """``key`` (text), ``start``, ``n_tokens`` and ``ids_crc32`` of every document, decoded from its block."""
    code_rows = spark.read.parquet(f"{path}/code").collect()  # bounded by the vocabulary
    ids, lengths = [r["id"] for r in code_rows], [r["length"] for r in code_rows]
    blocks = spark.read.parquet(f"{path}/blocks")
    parts = blocks.groupBy("part").agg(F.sum("n").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        code = Code(ids, lengths)
        for batch in batches:
            for row in batch.itertuples(index=False):
                flat = code.decode(row.offsets, row.bits, row.n).astype("<u4").tobytes()
                sizes = np.asarray(row.sizes, np.int64)
                start = np.cumsum(sizes) - sizes
                crc = [zlib.crc32(flat[4 * a : 4 * (a + n)]) for a, n in zip(start.tolist(), sizes.tolist())]
                yield pd.DataFrame({"key": row.keys, "start": row.start + row.before + start, "n_tokens": sizes, "ids_crc32": crc})

    placed = blocks.join(F.broadcast(before), "part")  # one row for each file part
    return placed.select("start", "before", "n", "keys", "sizes", "offsets", "bits").mapInPandas(run, "key string, start long, n_tokens long, ids_crc32 long")


def save(docs: DataFrame, path: str, tokenizer: str, text: str = "text", key: str = "doc_id", end_id: int = END_ID) -> None:
    """Encode every whole text and write the coded files to ``path``."""
    rows, _ = stage(token_ids(docs, tokenizer, text, key, end_id), "token-ids")
    write_files(rows, docs.schema[key].dataType.simpleString(), path)
