"""Connected components of a table of links, by alternating large-star and small-star rounds.

Each round is two aggregations and two joins over the links; its table is written to the shared
folder, so a lost executor never costs an earlier round. Rounds end as soon as the links are stars, not with a
further round that changes nothing. Nothing but that answer comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import drop_stage, stage


def _are_stars(edges: DataFrame) -> bool:
    """Whether each node that has a smaller neighbour has but one, and that one has none; ``edges`` are distinct, with u > v."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)))
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not nodes.agg(F.max((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0)))).first()[0]


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.join(least, "u").where((F.col("v") > F.col("u")) & (F.col("v") != F.col("m"))).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def connected(edges: DataFrame) -> DataFrame:
    """``u``, ``root`` for every node ``u`` that is not itself the root (the least node) of its component.

    ``edges`` has columns ``u`` and ``v`` of one ordered type; loops and repeats do no harm.
    """
    now, path = stage(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "links")
    while not _are_stars(now):
        after, new_path = stage(_small_star(_large_star(now)), "links")
        drop_stage(edges.sparkSession, path)
        now, path = after, new_path
    return now.select("u", F.col("v").alias("root"))
