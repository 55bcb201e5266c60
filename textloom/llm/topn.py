"""The N highest-scoring items of every group, by lower bounds of the partitions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.session import Stash

#: Rows that a task gathers before it cuts them, so that its memory has a bound.
BLOCK_ROWS = 1_000_000


def _best(group: np.ndarray, item: np.ndarray, score: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each group the n best distinct items, an item by its best row; and for each group's rows the n-th best score, or NaN."""
    order = np.lexsort((-score, item, group))
    group, item, score = group[order], item[order], score[order]
    first = np.ones(len(group), bool)
    first[1:] = (group[1:] != group[:-1]) | (item[1:] != item[:-1])
    group, item, score = group[first], item[first], score[first]
    order = np.lexsort((item, -score, group))
    group, item, score = group[order], item[order], score[order]
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.empty(0, int)
    sizes = np.diff(np.r_[starts, len(group)])
    rank = np.arange(len(group)) - np.repeat(starts, sizes)
    nth = np.where(sizes >= n, score[np.minimum(starts + n - 1, max(len(score) - 1, 0))], np.nan) if len(group) else np.empty(0)
    keep = rank < n
    return group[keep], item[keep], score[keep], np.repeat(nth, sizes)[keep]


def top_n(rows: DataFrame, group: str, item: str, score: str, n: int = 5) -> DataFrame:
    """(group, item, score, rank): for each group the n items with the highest scores, an item's score being the best of its rows.

    Of equal scores the smaller item comes first. Rows with a null group, item or score or a NaN score count nowhere; a group
    with fewer than n items keeps them all; an empty table gives an empty result. Group and item are cast to long, the score
    to double, in which floats keep their order and ties.

    Each task cuts its rows to the n best items of each group, of which the n-th score is a bound that the group's n-th best
    over all rows can't be below. The highest bound of each group is joined to what the tasks kept; rows below it are
    dropped before they are ranked. A group of any size so sends at most n rows from each block of a task.
    """
    if n < 1:
        raise ValueError("n has to be 1 or more")
    rows = rows.select(F.col(group).cast("long").alias("g"), F.col(item).cast("long").alias("i"), F.col(score).cast("double").alias("s"))
    rows = rows.where(F.col("g").isNotNull() & F.col("i").isNotNull() & F.col("s").isNotNull() & ~F.isnan("s"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def flush():
            best = _best(*(np.concatenate(x) for x in zip(*held)), n)
            return pa.RecordBatch.from_arrays([pa.array(best[0]), pa.array(best[1]), pa.array(best[2]), pa.array(best[3], from_pandas=True)], names=["g", "i", "s", "bound"])

        for b in batches:
            held.append(tuple(b.column(k).to_numpy(zero_copy_only=False) for k in range(3)))
            size += b.num_rows
            if size >= BLOCK_ROWS:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    # written, as both the bounds and the survivors are made from it
    kept = Stash(rows.sparkSession).keep(rows.mapInArrow(cut, "g long, i long, s double, bound double"))
    bounds = kept.where("bound IS NOT NULL").groupBy("g").agg(F.max("bound").alias("least"))
    alive = kept.join(bounds, "g", "left").where(F.col("least").isNull() | (F.col("s") >= F.col("least")))
    best = alive.groupBy("g", "i").agg(F.max("s").alias("s"))
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy(F.desc("s"), "i")))
    return ranked.where(F.col("rank") <= n).select(F.col("g").alias(group), F.col("i").alias(item), F.col("s").alias(score), "rank")
