"""Exact top-k by inner product over a pivot-distance index.

Every vector is keyed by its nearest pivot and the distance to it; the sorted keys are cut into
annuli, stored as one matrix each, and a directory of them (pivot, range of distances, greatest norm)
goes to all tasks. By the triangle inequality no member of an annulus lies nearer to a query than the
query's own pivot distance lies outside the annulus' range, which bounds their inner product from
above. Each query opens its annuli in the order of these bounds, best first, in rounds of growing
width; after each round the score of its k-th best is its new floor, and the query stops for good at
the first annulus whose bound is below the floor. Bounds keep ties, so the result is exact.

How much is pruned lies with the data: clustered vectors leave most annuli shut, while vectors spread
evenly over many dimensions all lie about as far from each other, and then every annulus is opened.

Pivots are a sample by hash, their number follows the root of the table's size up to MOST_PIVOTS;
every row is indexed. The annuli widen with the table so that there are MOST_ANNULI at most but for
one remainder for each pivot and task, which bounds the directory. Queries travel in blocks to the
annuli, and QUERIES_AT_ONCE bounds what meets an annulus in a task.

Edge cases: vectors that are null or hold a null or non-finite component take no part; shorter
vectors count as ending in zeros; rows with equal ids are rows of their own, and a query leaves out
its own row alone; a null id is a candidate that ties last; an empty table, or one without queries,
gives an empty result; columns besides id and vector are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import scratch, shuffle_width, stage

K = 10
SCALE = 1024
LEAST_PIVOTS, MOST_PIVOTS = 32, 1024
ANNULUS = 512
MOST_ANNULI = 1 << 17
WIDEST_ROUND = 256
BOUNDS_AT_ONCE = 1 << 22
QUERIES_AT_ONCE = 20_000
FOUND = "query_id long, quid long, vec_id long, uid long, score long"
NO_ID = np.iinfo(np.int64).max
NO_SCORE = np.iinfo(np.int64).min


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows."""
    most = max(np.abs(a).max(initial=0), 1) * max(np.abs(b).max(initial=0), 1) * max(1, a.shape[1])
    if float(most) < 2.0**52:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def best(own: np.ndarray, score: np.ndarray, ids: np.ndarray, uids: np.ndarray, floor: int, k: int) -> np.ndarray:
    """Positions of the k best candidates of one query, itself left out, none below ``floor``."""
    at = np.flatnonzero((score >= floor) & ~own)
    if len(at) > k:
        order = np.lexsort((uids[at], ids[at], -score[at]))
        at = at[order[:k]]
    return at


def _norms(vectors: np.ndarray) -> np.ndarray:
    return np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1))


def _distances(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    out = np.empty((len(vectors), len(pivots)))
    for j, p in enumerate(pivots.astype(np.float64)):
        out[:, j] = np.sqrt(((vectors - p) ** 2).sum(axis=1))
    return out


def integer_vectors(rows: DataFrame, query: Column, vector: str, key: str, scale: int) -> DataFrame:
    """``uid``, ``id``, ``query``, ``v`` of the rows that take part."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    part = rows.where(v.isNotNull() & ~F.coalesce(bad, F.lit(False)))
    return part.select(
        F.monotonically_increasing_id().alias("uid"),
        F.coalesce(F.col(key).cast("long"), F.lit(int(NO_ID))).alias("id"),
        F.coalesce(query, F.lit(False)).alias("query"),
        F.transform(v, lambda x: F.floor(x.cast("double") * scale)).cast("array<long>").alias("v"),
    )


class Packing:
    """Vectors of one length as bytes, in the least integer type that holds all components."""

    def __init__(self, dims: int, most: int):
        self.dims = dims
        self.kind = next(kind for kind in ("<i2", "<i4", "<i8") if kind == "<i8" or most <= np.iinfo(kind).max)

    def dense(self, column: pd.Series) -> np.ndarray:
        out = np.zeros((len(column), self.dims), np.int64)
        for i, v in enumerate(column):
            out[i, : len(v)] = v
        return out

    def pack(self, vectors: np.ndarray) -> bytes:
        return vectors.astype(self.kind).tobytes()

    def unpack(self, data: bytes) -> np.ndarray:
        return np.frombuffer(data, self.kind).reshape(-1, self.dims).astype(np.int64)


def build_index(table: DataFrame, pivots: np.ndarray, packing: Packing, width: int) -> DataFrame:
    """One row for each annulus of at most ``width`` vectors."""

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            vectors = packing.dense(batch["v"])
            d = _distances(vectors, pivots)
            pivot = d.argmin(axis=1)
            yield pd.DataFrame({"pivot": pivot, "distance": d[np.arange(len(d)), pivot], "uid": batch["uid"], "id": batch["id"], "v": [packing.pack(x) for x in vectors]})

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, held = TaskContext.get().partitionId() << 32, None
        for batch in batches:
            held = batch if held is None else pd.concat([held, batch], ignore_index=True)
            while len(held):
                same = held["pivot"].to_numpy() == held["pivot"].iloc[0]
                n = int(same.argmin()) if not same.all() else len(held)
                if n == len(held) and n < width:
                    break  # more of this pivot may follow
                take, held = held.iloc[: min(n, width)], held.iloc[min(n, width) :].reset_index(drop=True)
                yield annulus(number, take)
                number += 1
        if held is not None and len(held):
            yield annulus(number, held)

    def annulus(number: int, rows: pd.DataFrame) -> pd.DataFrame:
        packed = b"".join(rows["v"])
        return pd.DataFrame({
            "annulus": [number], "pivot": [rows["pivot"].iloc[0]], "low": [rows["distance"].min()], "high": [rows["distance"].max()], "norm": [_norms(packing.unpack(packed)).max()],
            "ids": [rows["id"].to_numpy().tobytes()], "uids": [rows["uid"].to_numpy().tobytes()], "vectors": [packed],
        })

    keyed = table.mapInPandas(nearest, "pivot int, distance double, uid long, id long, v binary")
    dealt = keyed.repartitionByRange(shuffle_width(table.sparkSession), "pivot", "distance", "uid").sortWithinPartitions("pivot", "distance", "uid")
    return dealt.mapInPandas(cut, "annulus long, pivot int, low double, high double, norm double, ids binary, uids binary, vectors binary")


class Directory:
    """Pivots, and of every annulus its pivot, range of distances and greatest norm."""

    def __init__(self, pivots: np.ndarray, rows: pd.DataFrame):
        rows = rows.sort_values("annulus")
        self.pivots, self.annulus, self.pivot = pivots, rows["annulus"].to_numpy(np.int64), rows["pivot"].to_numpy(np.int64)
        self.low, self.high, self.norm = (rows[c].to_numpy(np.float64) for c in ("low", "high", "norm"))

    def order(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each query the places of all annuli, best bound first, and these bounds."""
        d, norms = _distances(vectors, self.pivots)[:, self.pivot], _norms(vectors)[:, None]
        outside = np.maximum(0.0, np.maximum(d - self.high, self.low - d))
        bound = np.minimum((norms**2 + self.norm**2 - outside**2) / 2, norms * self.norm)
        bound += np.abs(bound) * 1e-9 + 1  # covers rounding of the distances
        at = np.argsort(-bound, axis=1, kind="stable")
        return at, np.take_along_axis(bound, at, 1)


def openings(asking: DataFrame, directory: Directory, packing: Packing, done: int, step: int) -> DataFrame:
    """Blocks of queries for the next ``step`` annuli that each may still gain from."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            vectors, part = packing.dense(batch["v"]), max(1, BOUNDS_AT_ONCE // max(1, len(directory.annulus)))
            wanted: dict[int, list[int]] = {}
            floors = batch["floor"].to_numpy()
            for a in range(0, len(vectors), part):
                at, bound = directory.order(vectors[a : a + part])
                at, bound = at[:, done : done + step], bound[:, done : done + step]
                for i, j in zip(*np.nonzero(bound >= floors[a : a + part, None])):
                    wanted.setdefault(int(at[i, j]), []).append(a + int(i))
            ids, uids = batch["id"].to_numpy(), batch["uid"].to_numpy()
            yield pd.DataFrame({
                "annulus": [directory.annulus[place] for place in wanted], "n": [len(own) for own in wanted.values()], "qids": [ids[own].tobytes() for own in wanted.values()], "quids": [uids[own].tobytes() for own in wanted.values()],
                "floors": [floors[own].tobytes() for own in wanted.values()], "qvectors": [packing.pack(vectors[own]) for own in wanted.values()],
            })

    return asking.mapInPandas(run, "annulus long, n long, qids binary, quids binary, floors binary, qvectors binary")


def searched(opened: DataFrame, index: DataFrame, packing: Packing, salts: int, k: int) -> DataFrame:
    """The k best of each opened annulus for each of its queries."""
    opened = opened.withColumn("salt", F.pmod(F.xxhash64("quids"), F.lit(salts)).cast("int"))
    wanted = opened.select("annulus", "salt").distinct().toDF("wanted", "share")
    ring = index.join(wanted, index["annulus"] == wanted["wanted"])
    members = ring.select(F.col("wanted").alias("annulus"), F.col("share").alias("salt"), "ids", "uids", "vectors")

    def search(_: tuple, queries: pd.DataFrame, ring: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "quid": [], "vec_id": [], "uid": [], "score": []}
        if len(queries) and len(ring):
            vectors = packing.unpack(ring["vectors"].iloc[0])
            ids, uids = (np.frombuffer(ring[c].iloc[0], np.int64) for c in ("ids", "uids"))
            for q in queries.itertuples(index=False):
                qids, quids, floors = (np.frombuffer(x, np.int64) for x in (q.qids, q.quids, q.floors))
                for i, s in enumerate(scores(packing.unpack(q.qvectors), vectors)):
                    at = best(uids == quids[i], s, ids, uids, floors[i], k)
                    out["query_id"] += [qids[i]] * len(at)
                    out["quid"] += [quids[i]] * len(at)
                    for name, values in (("vec_id", ids), ("uid", uids), ("score", s)):
                        out[name] += values[at].tolist()
        return pd.DataFrame(out)

    return opened.groupBy("annulus", "salt").cogroup(members.groupBy("annulus", "salt")).applyInPandas(search, FOUND)


def top_k(rows: DataFrame, query: Column, vector: str = "embedding", key: str = "vec_id", k: int = K, scale: int = SCALE, counts: list[tuple[int, int]] | None = None) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score`` for every row that ``query`` marks.

    ``counts``, where given, takes for each round the number of (query, annulus) pairs opened and of
    those there are.
    """
    spark = rows.sparkSession
    with scratch(spark) as keep:
        table, _ = stage(integer_vectors(rows, query, vector, key, scale), "vectors")
        most = F.max(F.array_max(F.transform("v", lambda x: F.abs(x))))
        size = table.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dims"), F.count_if("query").alias("queries"), most.alias("most")).first()
        packing, salts = Packing(max(size["dims"] or 0, 1), size["most"] or 0), 1 + size["queries"] // QUERIES_AT_ONCE
        number = min(MOST_PIVOTS, max(LEAST_PIVOTS, int(size["n"] ** 0.5)))
        picked = table.orderBy(F.xxhash64("uid"), "uid").select("v").limit(number).toPandas()
        pivots = np.unique(packing.dense(picked["v"]), axis=0) if len(picked) else np.zeros((1, packing.dims), np.int64)
        index, _ = stage(build_index(table, pivots, packing, max(ANNULUS, size["n"] // MOST_ANNULI)), "annuli")
        directory = Directory(pivots, index.select("annulus", "pivot", "low", "high", "norm").toPandas())
        queries = table.where("query").select("uid", "id", "v")
        found = spark.createDataFrame([], FOUND)
        done, step = 0, 1
        while done < len(directory.annulus):
            floors = found.groupBy("quid").agg(F.when(F.count("*") >= k, F.min("score")).alias("floor"))
            asking = queries.join(floors, queries["uid"] == floors["quid"], "left").withColumn("floor", F.coalesce("floor", F.lit(int(NO_SCORE))))
            opened, _ = stage(openings(asking, directory, packing, done, step), "annuli-opened")
            pairs = opened.agg(F.sum("n")).first()[0] or 0
            if counts is not None:
                counts.append((pairs, size["queries"] * len(directory.annulus)))
            if not pairs:
                break
            ranked = found.union(searched(opened, index, packing, salts, k)).withColumn("rank", F.row_number().over(Window.partitionBy("quid").orderBy(F.desc("score"), "vec_id", "uid")))
            found, _ = stage(ranked.where(F.col("rank") <= k).drop("rank"), "annuli-best")
            done, step = done + step, min(2 * step, WIDEST_ROUND)
        rank = F.row_number().over(Window.partitionBy("quid").orderBy(F.desc("score"), "vec_id", "uid"))
        return keep(stage(found.select("query_id", rank.alias("rank"), F.nullif("vec_id", F.lit(int(NO_ID))).alias("vec_id"), "score"), "top-k"))
