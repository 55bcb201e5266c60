"""Given code taken out of matches.

The mask of a file is what of it matches any file of the skeleton submission. A match loses the lines of the mask at its edges on
either side, and goes altogether where a side has none left; lines of the mask inside it stay in the range and are listed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The submission that holds the given code.
SKELETON = "SKELETON CODE"


def masks(ranges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, mask): disjoint ranges (start, end) in order, from rows (keys, start, end) that may overlap or touch."""
    line = Window.partitionBy(*keys).orderBy("start", "end")
    reach = F.max("end").over(line.rowsBetween(Window.unboundedPreceding, -1))
    r = ranges.where("start <= end").withColumn("new", F.when(F.col("start") <= reach + 1, 0).otherwise(1))
    r = r.withColumn("run", F.sum("new").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    whole = r.groupBy(*keys, "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return whole.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("mask"))


def _trimmed(side: str) -> dict[str, F.Column]:
    """As the ranges of a mask are disjoint and don't touch, at most one of them holds either edge."""
    s, e, mask = F.col(f"s{side}"), F.col(f"e{side}"), F.coalesce(f"mask{side}", F.array().cast("array<struct<start:int,end:int>>"))
    first = F.coalesce(F.get(F.filter(mask, lambda m: (m["start"] <= s) & (m["end"] >= s)), F.lit(0))["end"] + 1, s)
    last = F.coalesce(F.get(F.filter(mask, lambda m: (m["start"] <= e) & (m["end"] >= e)), F.lit(0))["start"] - 1, e)
    inside = F.filter(mask, lambda m: (m["start"] > first) & (m["end"] < last))
    return {f"n{side}": first, f"l{side}": last, f"inside{side}": inside}


def subtract(matches: DataFrame, mask: DataFrame, file1: str = "file1_id", file2: str = "file2_id") -> DataFrame:
    """The matches that remain, with their new ranges and ``inside1`` and ``inside2``, the ranges of given code within them.

    ``mask`` is (file, mask) as ``masks`` makes it. Null files have no mask; matches with null lines are dropped.
    """
    m1 = mask.select(F.col("file").alias(file1), F.col("mask").alias("mask1"))
    m2 = mask.select(F.col("file").alias(file2), F.col("mask").alias("mask2"))
    m = matches.where("s1 <= e1 AND s2 <= e2").join(m1, file1, "left").join(m2, file2, "left")
    m = m.withColumns(_trimmed("1") | _trimmed("2")).where("n1 <= l1 AND n2 <= l2")
    return m.withColumns({"s1": F.col("n1"), "e1": F.col("l1"), "s2": F.col("n2"), "e2": F.col("l2")}).drop("n1", "l1", "n2", "l2", "mask1", "mask2").select(*matches.columns, "inside1", "inside2")


def without_skeleton(matches: DataFrame, skeleton_files: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Matches of files that aren't given code, with what matches given code taken out, and none with it.

    ``skeleton_files`` (file) are the files of the skeleton submission; without any all matches remain. ``keys`` (such as the
    detector) keep the masks apart.
    """
    keys = keys or []
    s = skeleton_files.select("file").distinct()
    one = matches.join(s.withColumnRenamed("file", "file1_id"), "file1_id", "left_semi").select(*keys, F.col("file2_id").alias("file"), F.col("s2").alias("start"), F.col("e2").alias("end"))
    two = matches.join(s.withColumnRenamed("file", "file2_id"), "file2_id", "left_semi").select(*keys, F.col("file1_id").alias("file"), F.col("s1").alias("start"), F.col("e1").alias("end"))
    mask = masks(one.unionByName(two), [*keys, "file"])
    own = matches.join(s.withColumnRenamed("file", "file1_id"), "file1_id", "left_anti").join(s.withColumnRenamed("file", "file2_id"), "file2_id", "left_anti")
    if not keys:
        return subtract(own, mask)
    packed = lambda name: F.to_json(F.struct(*keys, F.col(name).alias("file")))
    out = subtract(own.withColumns({"_f1": packed("file1_id"), "_f2": packed("file2_id")}), mask.select(packed("file").alias("file"), "mask"), "_f1", "_f2")
    return out.drop("_f1", "_f2")
