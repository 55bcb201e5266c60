"""Pairs of files to be compared."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.columns import display_name
from textloom.session import Stash, tasks

#: Rows of a key that are worked on in one part; how many a key has is told by one of SAMPLE ids.
PART, SAMPLE = 256, 32
#: Files on either side of a block of pairs.
SIDE = 64
#: Files on either side of a block of all its pairs, and into how many buckets a group is dealt for the sake of many tasks alone.
BLOCK, BUCKETS = 128, 4
#: Files on either side of a block in which only keys are compared, and rows of a batch that such a block gives.
WIDE, BATCH = 1536, 1 << 16
#: Files of a key from which their pairs are set as bits.
DENSE = 64


def submission_key(submission: str = "submission", file: str = "file_id") -> Column:
    """The submission, or for a file without one a key of its own, so that it is compared with all others."""
    return F.coalesce(F.col(submission), F.concat(F.lit("#"), F.col(file).cast("string")))


def one_row_per_file(files: DataFrame, id: str = "file_id") -> DataFrame:
    """Rows that repeat a file count once; null ids are no files. All columns are those of one and the same row."""
    rest = [c for c in files.columns if c != id]
    first = files.where(F.col(id).isNotNull()).groupBy(id).agg(F.min_by(F.struct(*rest), F.xxhash64(*rest)).alias("_row"))
    return first.select(id, *[F.col(f"_row.{c}").alias(c) for c in rest])


def file_pairs(files: DataFrame, group: str = "workspace_id", id: str = "file_id", same_name: bool = False) -> DataFrame:
    """(group, file1_id, file2_id), file1_id < file2_id: all pairs of files of different submissions of a group.

    With ``same_name`` only files of the same name and extension are paired, which makes the name a key of the join. The number of
    rows is by definition that of the pairs; detectors find their pairs by keys that similar files share, and don't use this.
    """
    f = files.where(F.col(id).isNotNull() & F.col(group).isNotNull()).select(F.col(group).alias("grp"), F.col(id).alias("id"), submission_key("submission", id).alias("sub"), *([display_name("filename", "extension").alias("name")] if same_name else [])).distinct()
    a, b = f.select(*[F.col(c).alias(f"{c}_a") for c in f.columns]), f.select(*[F.col(c).alias(f"{c}_b") for c in f.columns])
    on = (F.col("grp_a") == F.col("grp_b")) & (F.col("id_a") < F.col("id_b")) & (F.col("sub_a") != F.col("sub_b"))
    if same_name:
        on = on & (F.col("name_a") == F.col("name_b"))
    return a.join(b, on).select(F.col("grp_a").alias(group), F.col("id_a").alias("file1_id"), F.col("id_b").alias("file2_id"))


def pair_counts(files: DataFrame, group: str = "workspace_id", id: str = "file_id") -> DataFrame:
    """(group, n_files, n_pairs): how many pairs ``file_pairs`` has, without making them."""
    f = files.where(F.col(id).isNotNull() & F.col(group).isNotNull()).select(F.col(group).alias("grp"), F.col(id).alias("id"), submission_key("submission", id).alias("sub")).distinct()
    by_sub = f.groupBy("grp", "sub").agg(F.count("*").alias("n"))
    sums = by_sub.groupBy("grp").agg(F.sum("n").alias("n_files"), F.sum(F.col("n") * F.col("n")).alias("own"))
    return sums.select(F.col("grp").alias(group), "n_files", F.expr("(n_files * n_files - own) div 2").alias("n_pairs"))


def keyed_pairs(rows: DataFrame, on: list[str], stash: Stash) -> DataFrame:
    """All pairs a < b of rows (on, id, ...) with the same key: (on, id_a, ..._a, id_b, ..._b).

    A key with very many rows is salted: each of its rows stands in one part on the one side and in all parts on the other, so that
    no task has a whole key. Which keys these are is estimated from one of SAMPLE ids, which changes nothing but the work's order.
    """
    rest = [c for c in rows.columns if c not in on]
    sample = rows.where(F.pmod(F.xxhash64("id"), F.lit(SAMPLE)) == 0).groupBy(*on).agg(F.count("*").alias("n"))
    hot = stash.keep(sample.where(F.col("n") * SAMPLE > 2 * PART).select(*on, F.ceil(F.col("n") * SAMPLE / PART).cast("int").alias("_parts")))
    one, two = rows.select(*on, *[F.col(c).alias(f"{c}_a") for c in rest]), rows.select(*on, *[F.col(c).alias(f"{c}_b") for c in rest])
    key = on
    if not hot.isEmpty():
        parts = F.coalesce("_parts", F.lit(1))
        one = one.join(hot, on, "left").withColumn("_part", F.pmod(F.xxhash64("id_a"), parts).cast("int")).drop("_parts")
        two = two.join(hot, on, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
        key = [*on, "_part"]
    return one.join(two, key).where("id_a < id_b").select(*on, *[f"{c}_a" for c in rest], *[f"{c}_b" for c in rest])


def in_blocks(pairs: DataFrame, records: DataFrame, payload: str, load: Callable, match: Callable, schema: str, arrow: list[pa.DataType], sizes: DataFrame | None = None) -> DataFrame:
    """Rows of ``schema`` (grp, a, b, ...) that ``match(load(payload of a), load(payload of b))`` makes of each pair (grp, a, b).

    The files of a group are dealt to buckets of about SIDE, and the pairs to blocks of two buckets. A file's payload (``records``:
    id, grp, payload) is sent and loaded once for each block that has a pair of it, and not once for each pair; a task holds
    the files of one block at a time. ``load`` gets the payload and a dictionary that lasts as long as the block. ``sizes`` (grp, _n)
    spares counting the files of groups where that is cheaper without their payloads.
    """
    sizes = records.groupBy("grp").agg(F.count("*").alias("_n")) if sizes is None else sizes
    bucket = lambda c: F.pmod(F.xxhash64(c), F.ceil(F.col("_n") / SIDE)).cast("int")
    p = pairs.select("grp", "a", "b").join(sizes, "grp").select("grp", bucket("a").alias("x"), bucket("b").alias("y"), "a", "b")
    p = p.select("grp", F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), "a", "b")
    needed = p.select("grp", "x", "y", F.col("a").alias("id")).unionByName(p.select("grp", "x", "y", F.col("b").alias("id"))).distinct()
    sent = needed.join(records.select("id", payload), "id").select("grp", "x", "y", F.col("id").alias("a"), F.lit(None).cast("long").alias("b"), payload)
    # the work is in the pairs, not in their bytes: a number of tasks that Spark doesn't merge by size
    rows = sent.unionByName(p.withColumn(payload, F.lit(None).cast(records.schema[payload].dataType)))
    rows = rows.repartition(tasks(pairs.sparkSession), "grp", "x", "y").sortWithinPartitions("grp", "x", "y", F.asc_nulls_first("b"), "a")
    names = [f.split()[0] for f in schema.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, shared = None, {}, {}
        for batch in batches:
            out: list[tuple] = []
            column = batch.column(5)
            for k, (g, x, y, a, b) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(5)))):
                if block != (g, x, y):
                    block, held, shared = (g, x, y), {}, {}
                if b is None:
                    held[a] = load(column[k], shared)
                else:
                    out.extend((g, a, b, *m) for m in match(held[a], held[b]))
            cols = list(zip(*out)) if out else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, arrow)], names=names)

    return rows.select("grp", "x", "y", "a", "b", payload).mapInArrow(work, schema)


def within_groups(records: DataFrame, payload: str, load: Callable, match: Callable, schema: str, arrow: list[pa.DataType], most: int | None = None) -> DataFrame:
    """Rows of ``schema`` (grp, a, b, ...), a < b, of files of different submissions of a group, of records (id, grp, sub, payload).

    A group's files are dealt to buckets of about BLOCK, and each two buckets are a block, of which a task holds one at a time: neither
    pairs nor keys are rows. A file is sent once for each bucket of its group: with ``most``, for payloads of which a task can hold
    twice as many, larger groups have BUCKETS buckets until these have so many files. ``load`` gets the payload and a dictionary that lasts as long as the block. ``match(files, partners)`` gets
    the files of a block in the order of their ids, and which of those before the k-th it is paired with as ``partners(k)``; it gives
    (i, k, rows) for pairs of them, or batches of ``schema``.
    """
    number = F.ceil(F.count("*") / BLOCK)
    number = F.greatest(F.least(number, F.lit(BUCKETS)), F.ceil(F.count("*") / most)) if most else number
    sizes = records.groupBy("grp").agg(number.cast("int").alias("_n"))
    dealt = records.join(sizes, "grp").withColumn("_own", F.pmod(F.xxhash64("id"), F.col("_n")).cast("int")).withColumn("_with", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    rows = dealt.select("grp", F.least("_own", "_with").alias("x"), F.greatest("_own", "_with").alias("y"), (F.col("_own") > F.col("_with")).alias("second"), "id", "sub", payload)
    rows = rows.repartition(4 * tasks(records.sparkSession), "grp", "x", "y").sortWithinPartitions("grp", "x", "y", "id")
    names, size = [f.split()[0] for f in schema.split(", ")], BATCH

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), arrow)], names=names)

    def compared(block: tuple, ids: list[int], subs: list[str], seconds: list[bool], files: list) -> Iterator[pa.RecordBatch]:
        if block[1] != block[2] and len(set(seconds)) < 2:
            return
        number: dict[str, int] = {}
        sub, second = np.array([number.setdefault(s, len(number)) for s in subs]), np.array(seconds)

        def partners(k: int) -> np.ndarray:
            other = sub[:k] != sub[k]
            return other if block[1] == block[2] else other & (second[:k] != second[k])

        out: list[tuple] = []
        for made in match(files, partners):
            if isinstance(made, pa.RecordBatch):
                yield made
                continue
            i, k, found = made
            a, b = ids[i], ids[k]
            out += [(block[0], a, b, *m) for m in found]
            if len(out) >= size:
                yield batch_of(out)
                out = []
        if out:
            yield batch_of(out)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, shared = None, ([], [], [], []), {}
        for batch in batches:
            for k, (g, x, y, second, id, sub) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(6)))):
                if block != (g, x, y):
                    if block:
                        yield from compared(block, *held)
                    block, held, shared = (g, x, y), ([], [], [], []), {}
                for column, value in zip(held, (id, sub, second, load(batch.column(6)[k], shared))):
                    column.append(value)
        if block:
            yield from compared(block, *held)

    return rows.mapInArrow(work, schema)


def sharing(files: list[np.ndarray], first: int, keys: Callable[[np.ndarray], Iterator[np.ndarray]], window: int) -> np.ndarray:
    """Which of the first ``first`` of some files share a key with which of the others, as a matrix; with no others, which of them all.

    A file is a sequence of numbers, and ``keys`` gives the key of each of its windows, in one or more ways, of which each is compared
    by itself. Keys that the same files have are one set of files, whose pairs are set once, however many keys and rows these are.
    """
    n, alone = len(files), first == len(files)
    ends = np.cumsum([len(f) for f in files])
    owner = np.repeat(np.arange(n, dtype=np.int32), [len(f) for f in files])
    whole = np.arange(len(owner)) + window <= (ends[owner] if n else 0)
    width, from_ = n if alone else n - first, 0 if alone else first
    out, bits = np.zeros((first, width), bool), np.zeros((first, -(-width // 8)), np.uint8)
    # a set of files is told by the sum of random numbers of theirs
    label = np.random.default_rng(0).integers(0, 1 << 64, n, np.uint64, endpoint=False)
    seen = np.empty(0, np.uint64)
    for k in keys(np.concatenate(files) if n else np.empty(0, np.uint64)):
        inside = whole[: len(k)]
        k, at = k[inside], owner[: len(k)][inside]
        order = np.argsort(k, kind="stable")
        k, at = k[order], at[order]
        fresh = np.ones(len(k), bool)
        fresh[1:] = (k[1:] != k[:-1]) | (at[1:] != at[:-1])
        k, at = k[fresh], at[fresh]
        if not len(k):
            continue
        begin = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        end = np.append(begin[1:], len(k))
        split = end if alone else begin + np.add.reduceat(at < first, begin, dtype=np.int64)
        useful = end - begin > 1 if alone else (split > begin) & (split < end)
        with np.errstate(over="ignore"):
            sums = np.add.reduceat(label[at], begin)[useful]
        begin, end, split = begin[useful], end[useful], split[useful]
        sums, one = np.unique(sums, return_index=True)
        one = one[~np.isin(sums, seen)]
        seen = np.union1d(seen, sums)
        begin, end, split = begin[one], end[one], split[one]
        two = end - begin == 2
        out[at[begin[two]], at[begin[two] + 1] - from_] = True
        for b, m, e in zip(*(x[~two].tolist() for x in (begin, split, end))):
            x, y = at[b:m], (at[b:e] if alone else at[m:e]) - from_
            if e - b < DENSE:
                out[x[:, None], y] = True
            else:
                row = np.zeros(width, bool)
                row[y] = True
                bits[x] |= np.packbits(row)
    return out | np.unpackbits(bits, axis=1, count=width).view(bool) if width else out


def sharing_pairs(records: DataFrame, payload: str, load: Callable, keys: Callable[[np.ndarray], Iterator[np.ndarray]], window: int) -> DataFrame:
    """(grp, a, b), a < b: files of different submissions of a group that share a key, of records (id, grp, sub, payload).

    A group's files are dealt to buckets of about WIDE, and each two buckets are a block. The work follows the files and their keys
    in a block, and not the pairs that each key has. ``load`` makes a sequence of numbers of a payload, with a dictionary that lasts
    as long as the task; ``keys`` and ``window`` are those of ``sharing``.
    """
    sizes = records.groupBy("grp").agg(F.ceil(F.count("*") / WIDE).cast("int").alias("_n"))
    dealt = records.join(sizes, "grp").withColumn("_own", F.pmod(F.xxhash64("id"), F.col("_n")).cast("int")).withColumn("_with", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    rows = dealt.select("grp", F.least("_own", "_with").alias("x"), F.greatest("_own", "_with").alias("y"), (F.col("_own") > F.col("_with")).alias("second"), "id", "sub", payload)
    rows = rows.repartition(4 * tasks(records.sparkSession), "grp", "x", "y").sortWithinPartitions("grp", "x", "y", "second", "id")

    def compared(grp: int, ids: list[int], subs: list[str], files: list[np.ndarray], first: int, alone: bool) -> Iterator[pa.RecordBatch]:
        if not alone and not 0 < first < len(ids):
            return
        found = sharing(files, first, keys, window)
        number: dict[str, int] = {}
        sub = np.array([number.setdefault(s, len(number)) for s in subs])
        id = np.array(ids, np.int64)
        start = 0 if alone else first
        found &= sub[:first, None] != sub[None, start:]
        if alone:
            found = np.triu(found, 1)
        for low in range(0, first, step := max(1, BATCH // found.shape[1])):
            x, y = np.nonzero(found[low : low + step])
            a, b = id[x + low], id[y + start]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), grp)), pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["grp", "a", "b"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory: dict = {}
        block, ids, subs, files, first = None, [], [], [], 0
        for batch in batches:
            for k, (g, x, y, second, id, sub) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(6)))):
                if block != (g, x, y):
                    if block:
                        yield from compared(block[0], ids, subs, files, first, block[1] == block[2])
                    block, ids, subs, files, first = (g, x, y), [], [], [], 0
                ids.append(id)
                subs.append(sub)
                files.append(load(batch.column(6)[k], memory))
                first += not second
        if block:
            yield from compared(block[0], ids, subs, files, first, block[1] == block[2])

    return rows.mapInArrow(work, "grp long, a long, b long")
