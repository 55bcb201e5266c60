"""Matches to groups of code blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.session import Stash

BLOCKS = "group_id long, detector string, grp long, file_id long, score float, ranges array<struct<start_line:int,end_line:int>>, weight int, comment string"


def _label(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node of each connected set. Each round takes the least label around and then the label of the
    label, so that labels come twice as far every time."""
    stash = Stash(edges.sparkSession)
    edges = stash.keep(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = stash.keep(edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"))
    while True:
        around = edges.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("least"))
        near = stash.keep(labels.join(around, "node").select("node", F.least("label", "least").alias("label"), F.col("label").alias("before")))
        jump = near.select(F.col("node").alias("label"), F.col("label").alias("further"))
        following = stash.keep(near.join(jump, "label").select("node", F.least("label", "further").alias("label"), "before"))
        changed = not following.where("label <> before").isEmpty()
        stash.drop(labels, near)
        labels = following
        if not changed:
            return labels.select("node", "label")


def linked_matches(matches: DataFrame, files: DataFrame | None = None, threshold: float = 1.0, stash: Stash | None = None) -> DataFrame:
    """Blocks of groups of matches that are linked by an equal range of a file that both have.

    Of two matches the first file that both have decides, in the order of the file ids: matches of the same two files are linked if
    they have the same range of the first of them, whatever they have of the second; matches that share one file are linked if they
    have the same range of it. A group is a connected set of linked matches, whatever their order. Each of its files has one block:
    the mean similarity of the matches it is in, and the range of the first of them by (start, end). Groups in more than
    ``threshold`` of the group's files (``files``: grp, n_files) are common code and dropped. Null or NaN similarities count nowhere.
    With a ``stash`` the blocks are made once, and not again for the sizes of the groups.
    """
    m = matches.where("similarity IS NOT NULL AND NOT isnan(similarity) AND s1 IS NOT NULL AND e1 IS NOT NULL AND s2 IS NOT NULL AND e2 IS NOT NULL AND file1_id <> file2_id")
    turned = F.col("file1_id") > F.col("file2_id")
    m = m.select("grp", "similarity", *[F.when(turned, b).otherwise(F.col(a)).alias(a) for x, y in (("file1_id", "file2_id"), ("s1", "s2"), ("e1", "e2")) for a, b in ((x, F.col(y)), (y, F.col(x)))])
    m = m.withColumns({"a": F.xxhash64("grp", "file1_id", "s1", "e1"), "b": F.xxhash64("grp", "file2_id", "s2", "e2"), "pair": F.xxhash64("file1_id", "file2_id")})
    # A range links all that have it, but for matches of the same two files of which it is a range of the second: those need another
    # match, of other files, in between.
    ranges = m.select(F.col("a").alias("b"), "pair").unionByName(m.select("b", "pair")).groupBy("b").agg(F.min("pair").alias("low"), F.max("pair").alias("high"))
    m = m.join(ranges.where("low <> high").select("b", F.lit(True).alias("links")), "b", "left")
    labels = _label(m.select("a", F.when(F.col("links"), F.col("b")).otherwise(F.col("a")).alias("b")).distinct())
    m = m.join(labels.withColumnRenamed("node", "a"), "a")
    sides = m.select("grp", "label", F.col("file1_id").alias("file_id"), F.col("s1").alias("start_line"), F.col("e1").alias("end_line"), "similarity").unionByName(
        m.select("grp", "label", F.col("file2_id").alias("file_id"), F.col("s2").alias("start_line"), F.col("e2").alias("end_line"), "similarity")
    )
    blocks = sides.groupBy("grp", "label", "file_id").agg(F.avg("similarity").cast("float").alias("score"), F.min(F.struct("start_line", "end_line")).alias("range"))
    return _of_sizes(blocks, files, threshold, stash)


def linked_blocks(parts: DataFrame, files: DataFrame, threshold: float, stash: Stash) -> DataFrame:
    """The blocks of ``linked_matches`` of what ``ngram.links`` gives."""
    parts = stash.keep(parts)
    first, second = (F.xxhash64("grp", f"file{k}_id", f"s{k}", f"e{k}") for k in (1, 2))
    seen = parts.where("kind = 0").groupBy("grp", F.col("file1_id").alias("file_id"), F.col("s1").alias("start_line"), F.col("e1").alias("end_line"))
    seen = seen.agg(*[f(c).alias(c) for f, c in ((F.sum, "n"), (F.sum, "total"), (F.min, "low"), (F.max, "high"))])
    seen = stash.keep(seen.withColumn("a", F.xxhash64("grp", "file_id", "start_line", "end_line")))
    unsure = parts.where("kind = 2").select("grp", "file2_id", "s2", "e2", "total", first.alias("a"), second.alias("b"))
    linked = seen.where("low <> high").select(F.col("a").alias("b"), F.lit(True).alias("links"))
    edges = parts.where("kind = 1").select(first.alias("a"), second.alias("b"))
    edges = edges.unionByName(unsure.join(linked, "b", "left").select("a", F.when(F.col("links"), F.col("b")).otherwise(F.col("a")).alias("b")))
    labels = _label(edges.unionByName(seen.where("n > 0").select("a", F.col("a").alias("b"))))
    sides = seen.where("n > 0").select("grp", "a", "file_id", "start_line", "end_line", "n", "total")
    sides = sides.unionByName(unsure.select("grp", "a", F.col("file2_id").alias("file_id"), F.col("s2").alias("start_line"), F.col("e2").alias("end_line"), F.lit(1).cast("long").alias("n"), "total"))
    blocks = sides.join(labels.withColumnRenamed("node", "a"), "a").groupBy("grp", "label", "file_id")
    return _of_sizes(blocks.agg((F.sum("total") / F.sum("n")).cast("float").alias("score"), F.min(F.struct("start_line", "end_line")).alias("range")), files, threshold, stash)


def _of_sizes(blocks: DataFrame, files: DataFrame | None, threshold: float, stash: Stash | None) -> DataFrame:
    """The blocks of groups of more than one file, and of not too many."""
    blocks = stash.keep(blocks) if stash else blocks
    sizes = blocks.groupBy("grp", "label").agg(F.count("*").alias("n"))
    keep = sizes.where("n > 1")
    if files is not None:
        keep = keep.join(files.select("grp", "n_files"), "grp").where((F.col("n") / F.col("n_files")).cast("float") <= F.lit(threshold).cast("float"))
    return blocks.join(keep.select("grp", "label"), ["grp", "label"], "left_semi").select(
        F.xxhash64(F.lit("linked"), "grp", "label").alias("group_id"), F.lit("NGramDetector").alias("detector"), "grp", "file_id", "score", F.array("range").alias("ranges"), F.lit(None).cast("int").alias("weight"), F.lit("N-Gram Match Group").alias("comment")
    )


def variable_groups(declared: DataFrame) -> DataFrame:
    """A group for every declaration that stands in two submissions of a group, with a block of score 1 for each file; straight from
    the declarations, without making their pairs."""
    lines = shared_declarations(declared).groupBy("grp", "value", "id").agg(F.array_sort(F.collect_set(F.struct(F.col("line").alias("start_line"), F.col("line").alias("end_line")))).alias("ranges"))
    return lines.select(
        F.xxhash64(F.lit("variable"), "grp", "value").alias("group_id"), F.lit("VariableNameDetector").alias("detector"), "grp", F.col("id").alias("file_id"), F.lit(1.0).cast("float").alias("score"), "ranges", F.lit(None).cast("int").alias("weight"),
        F.concat(F.lit("Variable: "), F.col("value")).alias("comment"),
    )


def own_declarations(declared: DataFrame, skeleton_files: DataFrame) -> DataFrame:
    """Declarations of files that aren't given code, on lines on which the file declares nothing that given code of another submission
    of its group declares as well. ``skeleton_files`` (file)."""
    given = declared.join(skeleton_files.select(F.col("file").alias("id")).distinct(), "id", "left_semi")
    lent = given.groupBy("grp", "value").agg(F.min("sub").alias("_low"), F.max("sub").alias("_high"))
    masked = declared.join(lent, ["grp", "value"]).where("sub <> _low OR sub <> _high").select("id", "line").distinct()
    own = declared.join(skeleton_files.select(F.col("file").alias("id")).distinct(), "id", "left_anti")
    return own.join(masked, ["id", "line"], "left_anti").select(*declared.columns)


def shared_declarations(declared: DataFrame) -> DataFrame:
    """Declarations that another submission of the group has as well."""
    shared = declared.groupBy("grp", "value").agg(F.min("sub").alias("low"), F.max("sub").alias("high")).where("low <> high").select("grp", "value")
    return declared.join(shared, ["grp", "value"], "left_semi")


def variable_totals(declared: DataFrame) -> DataFrame:
    """(detector, file_id, total): how many declarations a file has."""
    return declared.groupBy(F.col("id").alias("file_id")).agg(F.count("*").cast("int").alias("total")).select(F.lit("VariableNameDetector").alias("detector"), "file_id", "total")


def tree_groups(matches: DataFrame) -> DataFrame:
    """A group of two blocks for every match of two trees."""
    m = matches.withColumn("group_id", F.xxhash64(F.lit("tree"), "grp", "file1_id", "file2_id", "match_ix"))
    side = lambda k: m.select(
        "group_id", F.lit("ASTDetector").alias("detector"), "grp", F.col(f"file{k}_id").alias("file_id"), F.col("similarity").alias("score"),
        F.array(F.struct(F.col(f"s{k}").alias("start_line"), F.col(f"e{k}").alias("end_line"))).alias("ranges"), F.col(f"weight{k}").alias("weight"), F.lit("AST Structural Match").alias("comment"),
    )
    return side(1).unionByName(side(2))


def tree_totals(nodes: DataFrame, id: str = "file_id") -> DataFrame:
    """(detector, file_id, total): the nodes of a file's tree."""
    return nodes.where("node_id = 0").select(F.lit("ASTDetector").alias("detector"), F.col(id).alias("file_id"), F.col("weight").alias("total"))


def populated(blocks: DataFrame) -> DataFrame:
    """Blocks of groups that have more than one file."""
    many = blocks.groupBy("group_id").agg(F.countDistinct("file_id").alias("n")).where("n > 1")
    return blocks.join(many.select("group_id"), "group_id", "left_semi")


def groups_of_file(blocks: DataFrame, file_id: int, other: int | None = None) -> DataFrame:
    """Groups with a block of the file, or of both files."""
    out = blocks.where(F.col("file_id") == file_id).select("group_id").distinct()
    return out if other is None else out.join(blocks.where(F.col("file_id") == other).select("group_id").distinct(), "group_id", "left_semi")


def append_block(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Blocks of the same group and file as one: the mean of all scores, and the different ranges."""
    return blocks.groupBy(*keys).agg(F.avg("score").cast("float").alias("score"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("ranges")))).alias("ranges"), F.min("weight").alias("weight"))
