"""Centroid clustering by plain Lloyd rounds over integer vectors.

Vectors are turned to integers once and written to the shared folder. In each round the centroids, K
vectors of a fixed length, are broadcast; every task computes integer squared differences to each of
them in NumPy, takes the nearest (the lowest number on ties) and sends one row of sums for each
centroid and component that it has met. ``groupBy`` merges those sums, so a cluster of a third of all
rows costs no more than any other. Sums and quotients are integers, so the result is the same
whatever the partitions are.

Edge cases: vectors that are null, of another length, or with a null or non-finite component take no
part, nor do those with a component of LARGEST or more in either direction, whose squared distance
no long holds; of fewer vectors than centroids all are centroids; an empty table gives an empty
result; repeated rows are each assigned, and each can be a first centroid; null ids come last when the
first centroids are drawn; other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import scratch, stage

DIMENSIONS = 64
CENTROIDS = 8
ROUNDS = 10
SCALE = 1024
SEED = 3
LARGEST = 1 << 27  # below it, 64 squared differences add up to less than 2 ** 63


def integers(vectors: pd.Series, dimensions: int = DIMENSIONS) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``vectors`` take part, and their integer components, one row each."""
    right = np.array([v is not None and len(v) == dimensions for v in vectors], bool)
    flat = np.array([np.asarray(v, np.float64) for v in vectors[right]], np.float64).reshape(-1, dimensions)
    with np.errstate(invalid="ignore", over="ignore"):
        scaled = np.floor(flat * SCALE)
        fit = (np.abs(scaled) < LARGEST).all(axis=1)  # false for what is not finite too
    right[right] = fit
    return right, scaled[fit].astype(np.int64)


def nearest(points: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid, the lowest on ties, and the squared distance to it."""
    apart = np.empty((len(centroids), len(points)), np.int64)
    for k, c in enumerate(centroids):
        difference = points - c
        apart[k] = np.einsum("ij,ij->i", difference, difference)
    number = apart.argmin(axis=0)
    return number, apart[number, np.arange(len(points))]


def _points(packed: pd.Series, dimensions: int) -> np.ndarray:
    return np.frombuffer(b"".join(packed), "<i4").reshape(-1, dimensions).astype(np.int64)


def _quantised(vectors: DataFrame, vector: str, key: str, dimensions: int) -> DataFrame:
    """``key`` and ``packed`` (little-endian 32-bit components) of the vectors that take part."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            right, points = integers(batch["vector"], dimensions)
            yield pd.DataFrame({"key": batch["key"][right], "packed": [p.tobytes() for p in points.astype("<i4")]})

    rows = vectors.select(F.col(f"`{key}`").cast("string").alias("key"), F.col(f"`{vector}`").cast("array<double>").alias("vector"))
    return rows.mapInPandas(run, "key string, packed binary")


def _first(points: DataFrame, centroids: int, seed: int, dimensions: int) -> np.ndarray:
    """The vectors whose ids hash lowest."""
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), "key"), 256).asc_nulls_last()
    rows = points.orderBy(drawn, "packed").limit(centroids).select("packed").collect()
    return _points(pd.Series([bytes(r["packed"]) for r in rows], dtype=object), dimensions)


def _moved(points: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Floor of the mean of each centroid's vectors; one without vectors stays."""
    shared = points.sparkSession.sparkContext.broadcast(centroids)
    count, dimensions = centroids.shape

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, sizes = np.zeros((count, dimensions), np.int64), np.zeros(count, np.int64)
        for batch in batches:
            rows = _points(batch["packed"], dimensions)
            number, _ = nearest(rows, shared.value)
            for k in np.unique(number):
                sums[k] += rows[number == k].sum(axis=0)
            sizes += np.bincount(number, minlength=count)
        met = np.flatnonzero(sizes)
        yield pd.DataFrame({"cluster": met.repeat(dimensions), "at": np.tile(np.arange(dimensions), len(met)), "total": sums[met].ravel(), "size": sizes[met].repeat(dimensions)})

    merged = points.select("packed").mapInPandas(run, "cluster int, at int, total long, size long").groupBy("cluster", "at").agg(F.sum("total").alias("total"), F.sum("size").alias("size"))
    out = centroids.copy()
    for row in merged.collect():  # at most one row for each centroid and component
        out[row["cluster"], row["at"]] = row["total"] // row["size"]
    shared.unpersist()
    return out


def _inertia(points: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Sum of the squared distances to each centroid of its vectors."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            number, distance = nearest(_points(batch["packed"], centroids.shape[1]), centroids)
            total = np.zeros(len(centroids), np.int64)
            np.add.at(total, number, distance)
            yield pd.DataFrame({"cluster": range(len(total)), "total": total})

    rows = points.select("packed").mapInPandas(run, "cluster int, total long").groupBy("cluster").agg(F.sum("total").alias("total")).collect()
    out = np.zeros(len(centroids), np.int64)
    for row in rows:
        out[row["cluster"]] = row["total"]
    return out


def digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def cluster(vectors: DataFrame, vector: str = "embedding", key: str = "vec_id", centroids: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED, dimensions: int = DIMENSIONS) -> DataFrame:
    """``key``, ``cluster``, ``distance``, ``cluster_inertia``, ``inertia``, ``centroid_sha256`` of every vector that takes part."""
    with scratch(vectors.sparkSession) as keep:
        points = keep(stage(_quantised(vectors, vector, key, dimensions), "lloyd-points"))
        now = _first(points, centroids, seed, dimensions)
        for _ in range(rounds if len(now) else 0):
            before, now = now, _moved(points, now)
            if (before == now).all():
                break  # the rounds left would change nothing
        sums = _inertia(points, now) if len(now) else np.zeros(0, np.int64)
    names = np.array([digest(c) for c in now], object)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            number, distance = nearest(_points(batch["packed"], dimensions), now)
            yield pd.DataFrame({"key": batch["key"], "cluster": number, "distance": distance, "cluster_inertia": sums[number], "inertia": int(sums.sum()), "centroid_sha256": names[number]})

    made = points.mapInPandas(run, "key string, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    own = F.col("key").cast(vectors.schema[key].dataType).alias(key)
    return made.select(own, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
