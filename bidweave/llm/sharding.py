"""Minimax contiguous sharding, in DataFrame functions only.

Documents with equal texts form an atomic group. Groups stand in the order of their text digest and
are cut into contiguous shards so that the largest shard is as small as that order allows: a binary
search finds the least capacity that a greedy fill can meet, and the cuts are then placed within
that capacity, each as near as it can be to an even share of what is left.

The ordered group sizes stay on the executors. The driver sees them through a table of cells (least
and greatest group end in a range of bytes, at most CELLS rows at first); where the search touches a
cell that it cannot decide, that cell alone is split further, until no step is undecided.

Edge cases: a null text counts as empty (size 1); equal or null ids are rows of their own; an empty
table gives an empty result; only the id and text columns are read, so other names cannot clash;
with fewer groups than shards some shards stay empty.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import stage

SHARDS = 16
CELLS = 8192
SPLIT_BITS = 6
BUCKET_DIGITS = 3
SLOT_CELLS = 256


class GroupEnds:
    """The cumulative group ends, known by cell; ``touched`` gathers cells that left a lookup open."""

    def __init__(self, ends: DataFrame, total: int):
        self.ends, self.total = ends, total
        bits = max(0, (total // CELLS).bit_length())
        self.touched: set[tuple[int, int]] = set()
        self._set(self._read(bits, None))

    def _read(self, bits: int, within: Column | None) -> list[tuple[int, int, int, int, int]]:
        rows = self.ends if within is None else self.ends.where(within)
        cell = F.shiftright("end", bits)
        found = rows.groupBy(cell.alias("cell")).agg(F.min("end").alias("lo"), F.max("end").alias("hi"), F.count("*").alias("n"))
        return [(r["lo"], r["hi"], r["n"], bits, r["cell"]) for r in found.collect()]

    def _set(self, cells: list[tuple[int, int, int, int, int]]) -> None:
        self.cells = sorted(cells)
        self.starts = [c[0] for c in self.cells]

    def floor(self, x: int) -> int:
        """The last group end that is not beyond ``x`` (0 if there is none), or a lower bound of it."""
        i = bisect_right(self.starts, x) - 1
        if i < 0:
            return 0
        lo, hi, n, bits, cell = self.cells[i]
        if x >= hi:
            return hi
        if n > 2:
            self.touched.add((bits, cell))
        return lo

    def ceil(self, x: int) -> int:
        """The first group end that is not before ``x``, or an upper bound of it."""
        if x <= 0:
            return 0
        i = bisect_right(self.starts, x) - 1
        if i >= 0:
            lo, hi, n, bits, cell = self.cells[i]
            if lo == x:
                return x
            if x <= hi:
                if n > 2:
                    self.touched.add((bits, cell))
                return hi
        return self.cells[i + 1][0]

    def split_touched(self) -> None:
        """One job for each width of touched cells (they are few) splits all of them."""
        kept = [c for c in self.cells if (c[3], c[4]) not in self.touched]
        for bits in sorted({b for b, _ in self.touched}):
            ids = [cell for b, cell in self.touched if b == bits]
            kept += self._read(max(0, bits - SPLIT_BITS), F.shiftright("end", bits).isin(ids))
        self.touched = set()
        self._set(kept)


def _fits(ends: GroupEnds, capacity: int, shards: int) -> bool:
    at = 0
    for _ in range(shards):
        at = ends.floor(at + capacity)
        if at >= ends.total:
            return True
    return False


def _solve(ends: GroupEnds, largest: int, shards: int) -> tuple[int, list[int]]:
    low = max(largest, -(-ends.total // shards))
    high = low + largest
    while low < high:
        middle = (low + high) // 2
        if _fits(ends, middle, shards):
            high = middle
        else:
            low = middle + 1
    latest = [ends.total]
    for _ in range(shards - 1):
        latest.append(ends.ceil(latest[-1] - low))
    latest.reverse()  # latest[k]: the least end of shard k from which the rest still fits
    cuts, at = [], 0
    for k in range(shards - 1):
        even = at + (ends.total - at) // (shards - k)
        before, after = ends.floor(even), ends.ceil(even)
        near = before if even - before <= after - even else after
        at = min(max(near, latest[k]), ends.floor(at + low))
        cuts.append(at)
    return low, cuts


def smallest_capacity(ends: DataFrame, total: int, largest: int, shards: int = SHARDS) -> tuple[int, list[int]]:
    """Least shard capacity and the ends of all shards but the last, over a table of ``end``s."""
    known = GroupEnds(ends, total)
    while True:
        found = _solve(known, largest, shards)
        if not known.touched:
            return found
        known.split_touched()


def assign(docs: DataFrame, text: str = "text", key: str = "doc_id", shards: int = SHARDS) -> DataFrame:
    """``key``, ``size``, ``text_crc32``, ``shard`` and ``slot`` (gapless in each shard) of every row."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows, _ = stage(
        docs.select(
            F.col(key).alias("key"),
            (F.octet_length(body) + 1).cast("long").alias("size"),
            F.crc32(body.cast("binary")).alias("text_crc32"),
            F.md5(body.cast("binary")).alias("digest"),
        ),
        "shard-rows",
    )
    groups = rows.groupBy("digest").agg(F.sum("size").alias("bytes")).withColumn("bucket", F.substring("digest", 1, BUCKET_DIGITS))
    groups, _ = stage(groups, "shard-groups")
    totals = groups.groupBy("bucket").agg(F.sum("bytes").alias("bytes"))
    before = totals.select("bucket", (F.sum("bytes").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("bytes")).alias("before"))
    running = F.sum("bytes").over(Window.partitionBy("bucket").orderBy("digest").rowsBetween(Window.unboundedPreceding, 0))
    # at most 16 ** BUCKET_DIGITS rows are broadcast
    ends, _ = stage(groups.withColumn("running", running).join(F.broadcast(before), "bucket").select("digest", (F.col("running") + F.col("before")).alias("end")), "shard-ends")
    size = groups.agg(F.sum("bytes").alias("total"), F.max("bytes").alias("largest")).first()
    shard = F.lit(0)
    if size["total"]:
        _, cuts = smallest_capacity(ends, size["total"], size["largest"], shards)
        edges = {r["end"]: r["digest"] for r in ends.where(F.col("end").isin(cuts)).collect()}
        for cut in cuts:
            shard = shard + (F.lit(1) if cut == 0 else (F.col("digest") > edges[cut]).cast("int"))
    placed = rows.withColumn("shard", shard.cast("int")).withColumn("cell", F.pmod(F.xxhash64("key", "digest"), F.lit(SLOT_CELLS)).cast("int"))
    counts = placed.groupBy("shard", "cell").agg(F.count("*").alias("n"))
    offsets = counts.select("shard", "cell", (F.sum("n").over(Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("offset"))
    number = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("digest", "key"))
    # at most shards * SLOT_CELLS rows are broadcast
    out = placed.withColumn("number", number).join(F.broadcast(offsets), ["shard", "cell"])
    return out.select(F.col("key").alias(key), "size", "text_crc32", "shard", (F.col("offset") + F.col("number") - 1).alias("slot"))
