"""Pairwise links to groups by seed-tree pruning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.session import Stash


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, group_id): every id in a link of two different ids, and the smallest id it is linked to directly or over others.

    Links with a null end or with both ends equal count nowhere; direction and repetition don't matter; an empty table gives an
    empty result.

    In each round every vertex takes the smallest id among itself and its neighbours and passes it on to them all. A vertex
    that nobody took as smallest leaves the graph and hangs itself in a forest below the smallest id it was passed; the others
    are linked to the smallest of what they were passed. When no link is left, what remains are the seeds, one of each group,
    and their ids flow down the forest, from the vertices that left last to those that left first. Rounds grow with the
    logarithm of the longest chain. All sums are pre-aggregated; a vertex with very many links is one row on the small side of
    each join, whose other side Spark splits.
    """
    stash = Stash(links.sparkSession)
    links = links.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b")
    graph = stash.keep(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    forest: list[DataFrame] = []
    seeds = None
    while not graph.isEmpty():
        both = graph.unionByName(graph.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("a", "least").alias("least"))
        # v was passed m by a neighbour or by itself
        passed = both.join(least, "a").select(F.col("b").alias("v"), F.col("least").alias("m")).unionByName(least.select(F.col("a").alias("v"), F.col("least").alias("m")))
        passed = stash.keep(passed.distinct())
        summary = passed.groupBy("v").agg(F.min("m").alias("top"), F.max(F.col("m") == F.col("v")).alias("taken"))
        summary = stash.keep(summary)
        left = summary.where(~F.col("taken")).select("v", F.col("top").alias("above"))
        forest.append(left)
        links_now = passed.join(summary.select("v", "top"), "v").where("m <> top").select(F.least("top", "m").alias("a"), F.greatest("top", "m").alias("b")).distinct()
        following = stash.keep(links_now)
        linked = following.select(F.col("a").alias("v")).unionByName(following.select(F.col("b").alias("v")))
        done = summary.where("taken").join(linked, "v", "left_anti").select(F.col("v").alias("id"), F.col("v").alias("group_id"))
        seeds = done if seeds is None else seeds.unionByName(done)
        stash.drop(passed)
        graph = following
    if seeds is None:
        return graph.select(F.col("a").alias("id"), F.col("b").alias("group_id"))
    labels = stash.keep(seeds)
    for level in reversed(forest):
        flowed = level.join(labels.withColumnRenamed("id", "above"), "above").select(F.col("v").alias("id"), "group_id")
        labels = stash.keep(labels.unionByName(flowed))
    return labels
