"""Best-fit packing of documents into sequences of several permitted lengths.

A document counts its words plus one end mark. One longer than the greatest permitted length gives
whole sequences of that length and a rest. Pieces are packed longest first, each into the open bin
that it fills best; where none fits, a bin of the cheapest permitted size for its place is opened,
and at the end every bin shrinks to the least permitted length that holds its contents.

The lengths are chosen jointly: for every set of permitted lengths that holds the greatest piece, a
block of pieces is packed and priced, and the cheapest packing is kept. Of the lengths of a set, the
one opened has the least cost for each token that can still be put into it, so the size depends on
what is left to pack.

Blocks are cut from the rows that a task reads, so nothing is shuffled, memory is bounded by
BLOCK_PIECES, and a lost task is repeated with the same result; each block adds a few part-filled
bins at most. Only ids and lengths reach Python.

Edge cases: null and empty texts hold the end mark alone; repeated rows and null ids are packed as
rows of their own (``row_no``, unique in the result, keeps them apart); an empty table gives no pieces; columns besides id
and text are not read.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator, Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import SPACE_CLASS

LENGTHS = (512, 1024, 2048, 4096)
MOST_LENGTHS = 6
BLOCK_PIECES = 65_536


def sequence_cost(length: int) -> float:
    """Price of one sequence: its tokens, attention over them, and a fixed part."""
    return length * (1 + length / 16_384) + 64


def pack_block(sizes: Sequence[int], lengths: Sequence[int], cost: Callable[[int], float]) -> tuple[list[int], list[int], list[int]]:
    """Bin of each piece, its offset in the bin, and the final length of each bin."""
    lengths = sorted(set(lengths))
    if len(lengths) > MOST_LENGTHS:
        raise ValueError(f"at most {MOST_LENGTHS} lengths can be chosen from")
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    most = sizes[order[0]] if order else 0
    best = None
    for chosen in sets_of(lengths):
        if chosen[-1] < most:
            continue
        bins, offsets, used = _best_fit(sizes, order, chosen, cost)
        final = [lengths[bisect_left(lengths, x)] for x in used]
        price = sum(map(cost, final))
        if best is None or price < best[0]:
            best = (price, bins, offsets, final)
    return best[1:]


def sets_of(lengths: Sequence[int]) -> Iterator[tuple[int, ...]]:
    return (chosen for n in range(1, len(lengths) + 1) for chosen in combinations(lengths, n))


def _best_fit(sizes: Sequence[int], order: list[int], lengths: Sequence[int], cost: Callable[[int], float]) -> tuple[list[int], list[int], list[int]]:
    priced = [(x, cost(x)) for x in lengths]
    left = sum(sizes)
    bins, offsets, used = [0] * len(sizes), [0] * len(sizes), []
    open_bins: dict[int, list[int]] = {}
    free = 0  # bit r is set where a bin with room r is open
    for i in order:
        n = sizes[i]
        rest = free >> n
        if rest:
            room = n + (rest & -rest).bit_length() - 1
            b = open_bins[room].pop()
            if not open_bins[room]:
                free ^= 1 << room
        else:
            room = min((price / min(x, left), x) for x, price in priced if x >= n)[1]
            b = len(used)
            used.append(0)
        bins[i], offsets[i] = b, used[b]
        used[b] += n
        room -= n
        left -= n
        if room:
            open_bins.setdefault(room, []).append(b)
            free |= 1 << room
    return bins, offsets, used


def _packer(lengths: tuple[int, ...], cost: Callable[[int], float]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    most = max(lengths)

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Pieces in the order of their rows, a block at a time; one huge row may span blocks."""
        held, count, row = [], 0, 0
        for batch in batches:
            n = batch["n"].to_numpy()
            pieces = -(-n // most)
            at = np.repeat(np.arange(len(n)), pieces)
            piece = np.arange(len(at)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = piece * most
            out = pd.DataFrame({"key": batch["key"].take(at).array, "row_no": row + at, "piece": piece, "start": start, "length": np.minimum(n[at] - start, most)})
            row += len(n)
            while len(out):
                take = out.iloc[: BLOCK_PIECES - count]
                held.append(take)
                count += len(take)
                out = out.iloc[len(take) :]
                if count == BLOCK_PIECES:
                    yield pd.concat(held, ignore_index=True)
                    held, count = [], 0
        if held:
            yield pd.concat(held, ignore_index=True)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = first = TaskContext.get().partitionId() << 40
        for block in blocks(batches):
            block["row_no"] += task
            bins, offsets, final = pack_block(block["length"].tolist(), lengths, cost)
            block["bin_id"] = np.asarray(bins, dtype=np.int64) + first
            block["bin_offset"] = offsets
            block["bin_length"] = np.asarray(final, dtype=np.int64)[bins]
            first += len(final)
            yield block

    return run


def pack(
    docs: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    lengths: tuple[int, ...] = LENGTHS,
    cost: Callable[[int], float] = sequence_cost,
) -> DataFrame:
    """One row for each piece: ``key``, ``row_no`` of its row, ``piece``, words ``start`` to ``start + length`` (the end mark
    is the last), and the bin with its final length and the piece's offset in it."""
    n = F.size(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(f"[^{SPACE_CLASS}]+"), F.lit(0))).cast("long") + 1
    rows = docs.select(F.col(key).cast("string").alias("key"), n.alias("n"))  # text keeps null and large ids whole in pandas
    packed = rows.mapInPandas(
        _packer(tuple(lengths), cost),
        "key string, row_no long, piece long, start long, length long, bin_id long, bin_offset long, bin_length long",
    )
    return packed.select(F.col("key").cast(docs.schema[key].dataType).alias(key), "row_no", "piece", "start", "length", "bin_id", "bin_offset", "bin_length")
