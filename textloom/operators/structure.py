"""Trees and declarations of files, and the matches between them."""

from __future__ import annotations

import sys
import zlib
from bisect import bisect_left, bisect_right, insort
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions import haskell_tree, java_tree, trees
from textloom.functions.columns import language_key
from textloom.operators.pairs import in_blocks, keyed_pairs, submission_key, within_groups
from textloom.session import Stash, spread

#: Frames of Python that a character of source text can take, more than any does.
FRAMES = 64
#: Files whose nodes a task holds at a time.
HELD = 64
#: Files on either side of a block of trees, at most.
TREES = 2048
PARSERS: dict[str, Callable] = {"java": java_tree.tree, "haskell": haskell_tree.tree}
NODE = "struct<node_id:int,parent_id:int,child_ix:int,kind:string,value:string,start_line:int,start_char:int,end_line:int,end_char:int,weight:int,height:int,bfs_ix:int,post_ix:int,fp_strict:string,fp_abstract:string>"
_FIELDS = [f.split(":") for f in NODE[7:-1].split(",")]
_NODES = pa.list_(pa.struct([(n, pa.int32() if t == "int" else pa.string()) for n, t in _FIELDS]))
_VARIABLES = pa.list_(pa.struct([("line", pa.int32()), ("value", pa.string())]))


def parse(files: DataFrame, id: str = "file_id", text: str = "content", lang: str = "lang", with_nodes: bool = True) -> DataFrame:
    """(id, lang, nodes, variables, problem), one row for each file with a text and a known language.

    A file that doesn't parse has the one node UNKNOWN and says why in ``problem``; an empty one has its root alone. Without
    ``with_nodes`` the nodes are left out, for those who only want the declarations.
    """
    build = _builder(with_nodes, None)
    return _parsable(files, id, text, lang).mapInArrow(build, f"id long, lang string, nodes array<{NODE}>, variables array<struct<line:int,value:string>>, problem string").withColumnRenamed("id", id)


def parse_packed(files: DataFrame, abstract: bool = True, least_height: int = 1, id: str = "file_id", group: str = "workspace_id", text: str = "content", lang: str = "lang") -> DataFrame:
    """(id, tree, variables, total, grp, sub) of the files that ``parse`` has, with trees as ``slim`` makes them and the number of all
    their nodes, in the task that parses them. Files have one row each."""
    keys = {"grp": F.col(group).cast("long"), "sub": submission_key("submission", id)}
    made = "id long, tree binary, variables array<struct<line:int,value:string>>, total int, grp long, sub string"
    return _parsable(files, id, text, lang, keys).mapInArrow(_builder(True, abstract, least_height), made).withColumnRenamed("id", id)


def _parsable(files: DataFrame, id: str, text: str, lang: str, keys: dict | None = None) -> DataFrame:
    rows = files.select(F.col(id).cast("long").alias("id"), language_key(lang).alias("lang"), F.col(text).alias("text"), *[c.alias(k) for k, c in (keys or {}).items()])
    return spread(rows.where(F.col("id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isin(*PARSERS)))


def _builder(with_nodes: bool, packed: bool | None, least_height: int = 1) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What makes the rows of ``parse``, or, where ``packed`` says whether they are abstract, of ``parse_packed``."""
    parsers, held = PARSERS, HELD

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [n for n, _ in _FIELDS]
        for b in (batch.slice(k, held) for batch in batches for k in range(0, len(batch), held)):
            nodes, variables, problems, totals = [], [], [], []
            for lang, text in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                # frames stand on the heap: only memory bounds how deeply a text may be nested
                sys.setrecursionlimit(max(sys.getrecursionlimit(), 10_000 + FRAMES * len(text)))
                root, found, problem = parsers[lang](text)
                rows = trees.rows(root, lang) if with_nodes else []
                nodes.append([dict(zip(names, r)) for r in rows] if packed is None else slim(rows, packed, least_height))
                totals.append(len(rows))
                variables.append([{"line": n, "value": v} for n, v in found])
                problems.append(problem)
            if packed is not None:
                made = [b.column(0), pa.array(nodes, pa.binary()), pa.array(variables, _VARIABLES), pa.array(totals, pa.int32())]
                yield pa.RecordBatch.from_arrays([*made, *b.columns[3:]], names=["id", "tree", "variables", "total", *b.schema.names[3:]])
                continue
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(nodes, _NODES), pa.array(variables, _VARIABLES), pa.array(problems, pa.string())], names=["id", "lang", "nodes", "variables", "problem"])

    return build


def artifacts(files: DataFrame, makers: dict[str, Callable[[str], list[str]]], id: str = "file_id", text: str = "content", lang: str = "lang") -> DataFrame:
    """(id, lang, n, value): what the maker of a file's language makes of its text, in order. Files with null id or text, or in a language
    without a maker, have no rows; a maker that fails gives none."""
    rows = files.select(F.col(id).cast("long").alias("id"), language_key(lang).alias("lang"), F.col(text).alias("text"))
    rows = rows.where(F.col("id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isin(*makers))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def values(lang: str, text: str) -> list[str]:
            try:
                return list(makers[lang](text))
            except Exception:
                return []

        for b in batches:
            found = [values(lang, text.as_py()) for lang, text in zip(b.column(1).to_pylist(), b.column(2))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.list_(pa.string()))], names=["id", "lang", "x"])

    made = spread(rows).mapInArrow(make, "id long, lang string, x array<string>")
    return made.select(F.col("id").alias(id), "lang", F.posexplode("x").alias("n", "value"))


def nodes(parsed: DataFrame, id: str = "file_id") -> DataFrame:
    """One row for each node, in preorder."""
    return parsed.select(id, "lang", F.explode("nodes").alias("n")).select(id, "lang", "n.*")


def below(nodes_: DataFrame, node_id: int, id: str = "file_id") -> DataFrame:
    """The node and all below it: the weight of a node says how many rows of the preorder are its own."""
    top = nodes_.where(F.col("node_id") == node_id).select(id, F.col("node_id").alias("_first"), F.col("weight").alias("_weight"))
    return nodes_.join(top, id).where((F.col("node_id") >= F.col("_first")) & (F.col("node_id") < F.col("_first") + F.col("_weight"))).drop("_first", "_weight")


# declarations of variables


def variables(parsed: DataFrame, files: DataFrame, id: str = "file_id", group: str = "workspace_id") -> DataFrame:
    """(grp, sub, id, line, value) of all declarations."""
    known = files.where(F.col(id).isNotNull() & F.col(group).isNotNull()).select(F.col(id).cast("long").alias("id"), F.col(group).cast("long").alias("grp"), submission_key("submission", id).alias("sub")).dropDuplicates(["id"])
    v = parsed.select(F.col(id).alias("id"), F.explode("variables").alias("v")).select("id", F.col("v.line").alias("line"), F.col("v.value").alias("value"))
    return v.join(known, "id").select("grp", "sub", "id", "line", "value")


def variable_matches(declared: DataFrame) -> DataFrame:
    """Every pair of equal declarations of two files of different submissions of a group, in as many rows as there are such pairs.

    Names that very many files declare are dealt to many tasks.
    """
    both = keyed_pairs(declared.select("grp", "value", "id", "sub", "line"), ["grp", "value"], Stash(declared.sparkSession)).where("sub_a <> sub_b")
    lines = [F.col(f"line_{x}").alias(c) for x, k in (("a", 1), ("b", 2)) for c in (f"s{k}", f"e{k}")]
    return both.select("grp", F.col("id_a").alias("file1_id"), F.col("id_b").alias("file2_id"), *lines, F.col("value").alias("string"), F.lit(1.0).cast("float").alias("similarity"))


# trees


#: Columns of a packed tree; -1 stands for null.
PACKED = ("parent", "kind", "start", "end", "weight", "height", "bfs", "post", "print")


def pack(rows: list[dict], abstract: bool) -> tuple[bytes, list[int]]:
    """A tree as a matrix of numbers, kinds and fingerprints as hashes of them; and its different (height, fingerprint) as keys."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    m = np.empty((len(PACKED), len(rows)), np.int64)
    none = lambda name: [-1 if r[name] is None else r[name] for r in rows]
    m[0], m[2], m[3] = none("parent_id"), none("start_line"), none("end_line")
    m[1] = np.array([digest(r["kind"]) for r in rows], np.uint64).view(np.int64)
    m[4], m[5], m[6], m[7] = ([r[c] for r in rows] for c in ("weight", "height", "bfs_ix", "post_ix"))
    m[8] = np.array([int(r["fp_abstract" if abstract else "fp_strict"][:16], 16) for r in rows], np.uint64).view(np.int64)
    return m.tobytes(), m[8].tolist()


def pack_all(nodes: pa.ListArray, abstract: bool) -> list[bytes | None]:
    """The trees that ``pack`` makes of the nodes of many files, column by column, without a dictionary for each node."""
    import xxhash

    rows, ends = nodes.flatten(), np.cumsum(nodes.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    m = np.empty((len(PACKED), len(rows)), np.int64)
    for k, name in enumerate(("parent_id", None, "start_line", "end_line", "weight", "height", "bfs_ix", "post_ix")):
        if name:
            m[k] = rows.field(name).fill_null(-1).to_numpy(zero_copy_only=False)

    def of(name: str, number: Callable[[str], int]) -> np.ndarray:
        column = rows.field(name).dictionary_encode()
        values = np.array([number(x) for x in column.dictionary.to_pylist()], np.uint64).view(np.int64)
        return values[column.indices.to_numpy(zero_copy_only=False)]

    if len(rows):
        m[1] = of("kind", xxhash.xxh64_intdigest)
        m[8] = of("fp_abstract" if abstract else "fp_strict", lambda x: int(x[:16], 16))
    begins = [0, *ends[:-1].tolist()]
    return [m[:, a:b].tobytes() if there else None for a, b, there in zip(begins, ends.tolist(), nodes.is_valid().to_pylist())]


def slim(rows: list[tuple], abstract: bool, least_height: int) -> bytes:
    """What ``Tree.read`` needs of a tree (``trees.rows``): the nodes from ``least_height`` on, of which alone matches are made, with
    the weights that they have in the whole tree. What follows from the parents isn't stored."""
    import xxhash

    kept = [r for r in rows if r[10] >= least_height]
    at = {r[0]: k for k, r in enumerate(kept)}
    kinds: dict[str, int] = {}
    m = np.empty((5, len(kept)), np.int32)
    m[0] = [at.get(r[1], -1) for r in kept]
    m[1] = [kinds.setdefault(r[3], len(kinds)) for r in kept]
    m[2], m[3] = ([-1 if r[c] is None else r[c] for r in kept] for c in (5, 7))
    m[4] = [r[9] for r in kept]
    prints = np.array([int(r[14 if abstract else 13][:16], 16) for r in kept], np.uint64)
    digests = np.array([xxhash.xxh64_intdigest(k) for k in kinds], np.uint64)
    return zlib.compress(np.array([len(kept), least_height], np.int32).tobytes() + m.tobytes() + prints.tobytes() + digests.tobytes(), 1)


class Tree:
    """Lists over the preorder of a tree. ``span`` has how many of the nodes stand in a subtree, ``weight`` how many did before ``slim``."""

    __slots__ = ("parent", "kind", "start", "end", "weight", "height", "rank", "post", "print", "span", "alike")

    @classmethod
    def read(cls, packed: bytes) -> "Tree":
        """The tree of what ``slim`` made."""
        data = zlib.decompress(packed)
        n, lowest = np.frombuffer(data, np.int32, 2).tolist()
        m = np.frombuffer(data, np.int32, 5 * n, 8).reshape(5, n)
        prints, kinds = np.frombuffer(data, np.int64, n, 8 + 20 * n), np.frombuffer(data, np.int64, -1, 8 + 28 * n)
        out = cls.__new__(cls)
        out.parent, out.start, out.end, out.weight = (m[k].tolist() for k in (0, 2, 3, 4))
        out.kind, out.print = kinds[m[1]].tolist(), prints.tolist()
        depth, span, height = [0] * n, [1] * n, [lowest] * n
        for i, p in enumerate(out.parent):
            depth[i] = depth[p] + 1 if p >= 0 else 0
        for i in range(n - 1, 0, -1):
            p = out.parent[i]
            span[p] += span[i]
            # a node whose children are all lower than those kept is itself as low as any kept
            height[p] = max(height[p], height[i] + 1)
        out.span, out.height = span, height
        out.rank, out.post = [0] * n, [i + s - 1 - d for i, (s, d) in enumerate(zip(span, depth))]
        for k, i in enumerate(np.argsort(depth, kind="stable").tolist()):
            out.rank[i] = k
        out.alike = None
        return out

    def __init__(self, packed: bytes):
        m = np.frombuffer(packed, np.int64).reshape(len(PACKED), -1)
        self.parent, self.kind, self.start, self.end, self.weight, self.height, self.rank, self.post, self.print = (row.tolist() for row in m)
        self.span = self.weight
        self.alike: tuple[int, dict[tuple[int, int], list[int]]] | None = None

    def prints(self, least_height: int) -> dict[tuple[int, int], list[int]]:
        """The nodes of each (height, fingerprint) from ``least_height`` on, in the order of the breadth."""
        if self.alike is None or self.alike[0] != least_height:
            out: dict[tuple[int, int], list[int]] = {}
            for j in sorted((j for j, h in enumerate(self.height) if h >= least_height), key=self.rank.__getitem__):
                out.setdefault((self.height[j], self.print[j]), []).append(j)
            self.alike = least_height, out
        return self.alike[1]


def match_trees(one: Tree, two: Tree, least_height: int, least_dice: float) -> list[tuple[int, int, int, int, float, int, int]]:
    """(s1, e1, s2, e2, similarity, weight1, weight2) of equal and of similar subtrees.

    Anchors: from the highest down, subtrees of equal height and fingerprint, each with the first of the other tree that is
    free; all below them belongs to them. Containers: from the leaves up, inner nodes of the same kind that hold partners of an
    anchor's nodes; of those the one with the highest Dice coefficient, the first of equal ones. What a container holds of
    anchors neither counts for its weight nor for the containers around it.

    Only nodes that the other tree has as well can be anchors, and only what is above anchors can be containers: nothing else of
    the trees is looked at.
    """
    prints1, prints2 = one.prints(least_height), two.prints(least_height)
    both = prints1.keys() & prints2.keys()
    if not both:
        return []
    parent1, parent2, weight1, weight2 = one.parent, two.parent, one.weight, two.weight
    rank, height = one.rank, one.height
    nodes = [i for key in both for i in prints1[key]]
    nodes.sort(key=lambda i: (-height[i], rank[i]))
    free = {key: deque(prints2[key]) for key in both}
    # the ends of the stretches that anchors take of the preorder, by their begins, which are in order
    begin1: list[int] = []
    begin2: list[int] = []

    def taken(begin: list[int], span: list[int], i: int) -> bool:
        k = bisect_right(begin, i) - 1
        return k >= 0 and i < begin[k] + span[begin[k]]

    out = []
    anchors: list[tuple[int, int]] = []
    for i in nodes:
        if taken(begin1, one.span, i):
            continue
        line = free[height[i], one.print[i]]
        while line and taken(begin2, two.span, line[0]):
            line.popleft()
        if not line:
            continue
        j = line.popleft()
        if one.start[i] >= 0 and two.start[j] >= 0:
            out.append((one.start[i], one.end[i], two.start[j], two.end[j], 1.0, weight1[i], weight2[j]))
        anchors.append((i, j))
        insort(begin1, i)
        insort(begin2, j)
    # what is above an anchor is never below another: anchors come from the highest down
    above2 = {}
    mass1: dict[int, int] = {}
    mass2: dict[int, int] = {}
    for i, j in anchors:
        p = parent1[i]
        while p >= 0:
            mass1[p] = mass1.get(p, 0) + weight1[i]
            p = parent1[p]
        line = []
        p = parent2[j]
        while p >= 0:
            mass2[p] = mass2.get(p, 0) + weight2[j]
            line.append(p)
            p = parent2[p]
        above2[i] = line
    live = sorted(above2)
    for i in sorted(mass1, key=one.post.__getitem__):
        w = weight1[i]
        if mass1[i] <= 0:
            continue
        low, high = bisect_left(live, i), bisect_left(live, i + one.span[i])
        # nodes of the anchors below, counted for all that is above their partners
        common: dict[int, int] = {}
        for a in live[low:high]:
            for j in above2[a]:
                common[j] = common.get(j, 0) + weight1[a]
        kind = one.kind[i]
        order = [j for j in common if two.kind[j] == kind]
        if not order:
            continue
        order.sort(key=two.rank.__getitem__)
        best, best_dice = -1, np.float32(0)
        for j in order:
            dice = np.float32(2 * common[j]) / np.float32(w + weight2[j])
            if dice > best_dice:
                best, best_dice = j, dice
        if best < 0 or best_dice < np.float32(least_dice):
            continue
        hidden1, hidden2 = mass1[i], mass2[best]
        own1, own2 = w - hidden1, weight2[best] - hidden2
        if own1 <= 0 or own2 <= 0:
            continue
        if one.start[i] >= 0 and two.start[best] >= 0:
            out.append((one.start[i], one.end[i], two.start[best], two.end[best], float(best_dice), own1, own2))
        p = parent1[i]
        while p >= 0:
            mass1[p] = max(0, mass1[p] - hidden1)
            p = parent1[p]
        p = parent2[best]
        while p >= 0:
            mass2[p] = max(0, mass2[p] - hidden2)
            p = parent2[p]
        del live[low:high]
    return out


def alike(held: list[Tree], least_height: int) -> Iterator[tuple[int, np.ndarray]]:
    """(k, which of those before it) of the trees that share a fingerprint from ``least_height`` on with one before them."""
    # by key the trees that have it, as bits
    have: dict[tuple[int, int], int] = {}
    for k, tree in enumerate(held):
        found = 0
        for key in tree.prints(least_height):
            before = have.get(key, 0)
            found |= before
            have[key] = before | 1 << k
        if found:
            yield k, np.unpackbits(np.frombuffer(found.to_bytes(-(-k // 8), "little"), np.uint8), count=k, bitorder="little").view(bool)


def tree_matches(parsed: DataFrame, files: DataFrame, least_height: int = 5, least_dice: float = 0.8, abstract: bool = True, id: str = "file_id", group: str = "workspace_id", pairs: DataFrame | None = None) -> DataFrame:
    """Matches of the trees of all pairs of files of different submissions of a group and the same language.

    Only pairs that share a fingerprint of a subtree of ``least_height`` are looked at: without it there is no anchor, and without
    an anchor no container. ``parsed`` is what ``parse`` gives, or ``parse_packed`` of the same ``abstract`` and no higher ``least_height``. Pairs are
    found in blocks of files, without rows of keys or of pairs; ``pairs`` (grp, a, b) restricts them. The file with the smaller id is
    the first.
    """
    if "tree" in parsed.columns:
        t = parsed.select(F.col(id).alias("id"), "grp", "sub", "tree").where("grp IS NOT NULL")
    else:
        known = files.where(F.col(id).isNotNull() & F.col(group).isNotNull()).select(F.col(id).cast("long").alias("id"), F.col(group).cast("long").alias("grp"), submission_key("submission", id).alias("sub")).dropDuplicates(["id"])
        held_ = HELD

        def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in (b.slice(k, held_) for b in batches for k in range(0, len(b), held_)):
                made = [None if rows is None else slim([tuple(r.values()) for r in rows], abstract, least_height) for rows in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["id", "tree"])

        # packed before anything is shuffled; stored trees may be too few bytes for as many tasks as there are cores
        t = parsed.select(F.col(id).alias("id"), "nodes").where("nodes IS NOT NULL")
        t = (spread(t) if hasattr(parsed, "_stash_path") else t).mapInArrow(packed, "id long, tree binary")
        t = t.dropDuplicates(["id"]).join(known, "id").select("id", "grp", "sub", "tree")
    if not hasattr(parsed, "_stash_path"):
        t = Stash(files.sparkSession).keep(t)

    def load(tree: pa.Scalar, shared: dict) -> Tree:
        return Tree.read(tree.as_py())

    def match(held: list[Tree], partners: Callable[[int], np.ndarray]) -> Iterator[tuple]:
        for k, shared in alike(held, least_height):
            for i in np.flatnonzero(shared & partners(k)).tolist():
                if found := match_trees(held[i], held[k], least_height, least_dice):
                    yield i, k, [(x, *m) for x, m in enumerate(found)]

    schema = "grp long, file1_id long, file2_id long, match_ix int, s1 int, e1 int, s2 int, e2 int, similarity float, weight1 int, weight2 int"
    types = [pa.int64()] * 3 + [pa.int32()] * 5 + [pa.float32()] + [pa.int32()] * 2
    if pairs is None:
        return within_groups(t, "tree", load, match, schema, types, TREES)
    two = lambda one, other: ((x, *m) for x, m in enumerate(match_trees(one, other, least_height, least_dice)))
    return in_blocks(pairs, t.select("id", "grp", "tree"), "tree", load, two, schema, types)
