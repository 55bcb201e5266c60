"""Parent-child rows to full hierarchies by nested sets.

Subtree sizes are summed upward, siblings get preorder ranges by prefix sums, and the ranges are added up downward. Both sums
run along paths by doubling: round k handles distances of 2^k to 2^(k+1), so that a tree of depth D takes log2 D rounds and not
D. A node that is completed leaves the rounds, so that these get smaller with every one. A node that is in a circle, or below one,
is in no round completed; the rounds end when one completes nothing more.

The joins of the rounds have one row for each node on the side of the ancestors. Where very many nodes have the same one, it is
the other side that has a hot key, which Spark splits at run time; all sums are pre-aggregated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.session import Stash


#: Rows of a round that are worth a task and a file of their own.
ROWS = 200_000


def _packed(df: DataFrame, rows: int) -> DataFrame:
    """The same rows in no more tasks than so many are worth, where these are few: late rounds have a handful of nodes."""
    parts = rows // ROWS + 1
    return df.coalesce(parts) if parts < df.sparkSession.sparkContext.defaultParallelism else df


def distinct_nodes(rows: DataFrame, node: str = "dir_id", parent: str = "parent_id", name: str | None = "name") -> DataFrame:
    """One row (node, parent, name) for each node id; null ids are no nodes.

    Rows that repeat an id count once; where they differ, the smallest (parent, name) with a parent counts.
    """
    label = F.col(name).cast("string") if name else F.lit(None).cast("string")
    rows = rows.select(F.col(node).cast("long").alias("node"), F.col(parent).cast("long").alias("parent"), label.alias("name"))
    return (
        rows.where(F.col("node").isNotNull())
        .groupBy("node")
        .agg(F.min(F.struct(F.col("parent").isNull().alias("none"), "parent", "name")).alias("x"))
        .select("node", F.col("x.parent").alias("parent"), F.col("x.name").alias("name"))
    )


def grouped_prefix_sum(stash: Stash, df: DataFrame, group: str, order: list[Column], value: str, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows of the same group before this one.

    No group has to fit in a task: rows are ranged over all partitions by (group, order), summed within each (group, partition),
    and the sums of a group's earlier partitions, at most one row for each partition, are added. ``order`` has to be total.
    """
    ranged = df.repartitionByRange(F.col(group), *order).withColumn("_part", F.spark_partition_id())
    ranged = stash.keep(ranged)
    within = Window.partitionBy(group, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = ranged.groupBy(group, "_part").agg(F.sum(value).alias("_sum"))
    base = base.withColumn("_base", F.coalesce(F.sum("_sum").over(across), F.lit(0))).drop("_sum")
    local = ranged.withColumn("_local", F.coalesce(F.sum(value).over(within), F.lit(0)))
    return local.join(base, [group, "_part"]).withColumn(out, F.col("_local") + F.col("_base")).drop("_part", "_local", "_base")


def nested_sets(rows: DataFrame, node: str = "dir_id", parent: str = "parent_id", name: str | None = "name", weights: DataFrame | None = None, paths: bool = True) -> DataFrame:
    """For each node: root_id, depth, path (array of names), pre, last, n_below, weight_below and is_cycle.

    ``pre`` numbers a root's nodes in preorder from 0, siblings by name and id; the node's descendants are those of the same root
    with ``pre < their pre <= last``. A node without a parent, or whose parent is not in the table, is a root of depth 0. Nodes
    that reach no root get root_id and depth -1, null ranges and path, and is_cycle. A null name stands as ``#id`` in the path.
    ``weights`` (node, weight), such as files by directory, is summed over the node and all below it; null or unknown nodes in it
    count nowhere. Without ``paths`` the path is left out, whose total length grows with the depth of the trees. An empty table
    gives an empty result.
    """
    stash = Stash(rows.sparkSession)
    nodes = distinct_nodes(rows, node, parent, name)
    known = nodes.select(F.col("node").alias("parent"), F.lit(True).alias("_known"))
    nodes = nodes.join(known, "parent", "left").withColumn("parent", F.when(F.col("_known"), F.col("parent"))).drop("_known")
    if weights is None:
        nodes = nodes.withColumn("own", F.lit(0).cast("long"))
    else:
        own = weights.where(F.col("node").isNotNull()).groupBy("node").agg(F.sum("weight").cast("long").alias("own"))
        nodes = nodes.join(own, "node", "left").withColumn("own", F.coalesce("own", F.lit(0)))
    nodes, open_now = stash.keep_counted(nodes.select("node", "parent", "name", "own"), F.col("parent").isNotNull())
    sized, stuck = _sizes(stash, nodes, open_now)

    # Siblings: the offset of a node within its parent's range.
    trees = nodes.select("node", "parent", "name").join(sized, "node")
    offsets = grouped_prefix_sum(stash, trees.where(F.col("parent").isNotNull()), "parent", [F.col("name"), F.col("node")], "size", "before")
    label = F.array(F.coalesce("name", F.concat(F.lit("#"), F.col("node").cast("string")))) if paths else F.lit(None).cast("array<string>")
    root = trees.where(F.col("parent").isNull()).select("node", F.lit(None).cast("long").alias("jump"), F.col("node").alias("root_id"), F.lit(0).alias("depth"), F.lit(0).cast("long").alias("pre"), "size", "weight", "reach", label.alias("path"))
    below = offsets.select("node", F.col("parent").alias("jump"), F.lit(None).cast("long").alias("root_id"), F.lit(1).alias("depth"), (F.col("before") + 1).alias("pre"), "size", "weight", "reach", label.alias("path"))

    # Downward: offsets, depths and names added up along the path to the root.
    kept, open_now = stash.keep_counted(root.unionByName(below), F.col("jump").isNotNull())
    done = kept.where(F.col("jump").isNull())
    k = 0
    while open_now:
        active = kept.where(F.col("jump").isNotNull())
        # only what has a node at distance 2^k below it is looked up
        above = done.unionByName(active).where(F.col("reach") >= k).select(F.col("node").alias("jump"), F.col("jump").alias("_jump"), F.col("root_id").alias("_root"), F.col("depth").alias("_depth"), F.col("pre").alias("_pre"), F.col("path").alias("_path"))
        moved = active.join(above, "jump").select(
            "node", F.col("_jump").alias("jump"), F.col("_root").alias("root_id"), (F.col("depth") + F.col("_depth")).alias("depth"), (F.col("pre") + F.col("_pre")).alias("pre"), "size", "weight", "reach", F.concat("_path", "path").alias("path")
        )
        kept, open_now = stash.keep_counted(_packed(moved, open_now), F.col("jump").isNotNull())
        done = done.unionByName(kept.where(F.col("jump").isNull()))
        k += 1
    tree = done.select(
        F.col("node").alias(node), "root_id", "depth", "path", "pre", (F.col("pre") + F.col("size") - 1).alias("last"), (F.col("size") - 1).alias("n_below"), F.col("weight").alias("weight_below"), F.lit(False).alias("is_cycle")
    )
    lost = stuck.select(
        F.col("node").alias(node), F.lit(-1).cast("long").alias("root_id"), F.lit(-1).alias("depth"), F.lit(None).cast("array<string>").alias("path"), F.lit(None).cast("long").alias("pre"),
        F.lit(None).cast("long").alias("last"), F.lit(None).cast("long").alias("n_below"), F.lit(None).cast("long").alias("weight_below"), F.lit(True).alias("is_cycle"),
    )
    out = tree.unionByName(lost)
    return out if paths else out.drop("path")


def _sizes(stash: Stash, nodes: DataFrame, open_now: int) -> tuple[DataFrame, DataFrame]:
    """(node, size, weight, reach) of the nodes that reach a root, and (node) of those that don't, which no round completes.

    Before round k a node has counted what is nearer than 2^k below it, and ``jump`` is its ancestor at distance 2^k. A node
    without such an ancestor leaves; what it gains later comes as rows of its own, which are added up at the end. ``reach`` is the
    last round in which a node gained anything, -1 for leaves: it has nodes at distance 2^reach below it.
    """
    kept = nodes.select("node", F.col("parent").alias("jump"), F.lit(1).cast("long").alias("size"), F.col("own").alias("weight"), F.lit(-1).alias("reach"))
    done = kept.where(F.col("jump").isNull())
    active = kept.where(F.col("jump").isNotNull())
    open_before, k = -1, 0
    while open_now not in (0, open_before):
        gained = active.groupBy(F.col("jump").alias("node")).agg(F.sum("size").alias("more"), F.sum("weight").alias("more_weight"))
        far = active.select(F.col("node").alias("jump"), F.col("jump").alias("next"))
        moved = active.join(far, "jump", "left").select("node", F.col("next").alias("jump"), "size", "weight", "reach").join(gained, "node", "full")
        zero = F.lit(0).cast("long")
        sums = [(F.coalesce(a, zero) + F.coalesce(b, zero)).alias(a) for a, b in (("size", "more"), ("weight", "more_weight"))]
        moved = moved.select("node", "jump", *sums, F.when(F.col("more").isNotNull(), k).otherwise(F.col("reach")).alias("reach"))
        open_before = open_now
        kept, open_now = stash.keep_counted(_packed(moved, 2 * open_now), F.col("jump").isNotNull())
        done = done.unionByName(kept.where(F.col("jump").isNull()))
        active = kept.where(F.col("jump").isNotNull())
        k += 1
    sized = done.groupBy("node").agg(F.sum("size").alias("size"), F.sum("weight").alias("weight"), F.max("reach").alias("reach"))
    return sized, active.select("node")


def descendants(tree: DataFrame, node: str = "dir_id", levels: int = 40) -> DataFrame:
    """(ancestor, descendant, distance) for every node below another, from nested sets.

    A range of preorder numbers is cut into at most two aligned blocks for each power of two, and each number lies in one block
    of every size: the containment of numbers in ranges becomes an equi-join that makes each pair exactly once. ``levels``
    bounds the sizes of trees to 2^levels nodes; only the sizes that a block of the same root has are made for the numbers.
    """
    tree = tree.where(~F.col("is_cycle")).select(F.col(node).alias("node"), "root_id", "depth", "pre", "last")
    a, b = F.col("pre") + 1, F.col("last") + 1
    up = lambda x, level: F.expr(f"shiftright({x} + shiftleft(1L, {level}) - 1, {level})")
    blocks = (
        tree.where(F.col("last") > F.col("pre"))
        .withColumn("a", a)
        .withColumn("b", b)
        .withColumn("level", F.explode(F.expr(f"sequence(0, least({levels}, cast(ceil(log2(b)) as int)))")))
        .withColumn("a", up("a", "level"))
        .withColumn("b", F.expr("shiftright(b, level)"))
        .where("a < b")
        .withColumn("block", F.explode(F.expr("filter(array(if(a % 2 = 1, a, null), if(b % 2 = 1, b - 1, null)), x -> x is not null)")))
        .select("root_id", "level", "block", F.col("node").alias("ancestor"), F.col("depth").alias("_depth"))
    )
    sizes = tree.groupBy("root_id").agg(F.max("pre").alias("most"))
    points = (
        tree.join(sizes, "root_id")
        .withColumn("level", F.explode(F.expr(f"sequence(0, least({levels}, cast(ceil(log2(most + 2)) as int)))")))
        .select("root_id", "level", F.expr("shiftright(pre, level)").alias("block"), F.col("node").alias("descendant"), "depth")
    )
    return blocks.join(points, ["root_id", "level", "block"]).select("ancestor", "descendant", (F.col("depth") - F.col("_depth")).alias("distance"))
