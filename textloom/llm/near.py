"""Near-duplicate records by ProbMinHash, banding and verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.components import components
from textloom.llm.hashing import CODE_TOKEN, TokenHash, hashed, mix, ordered, signed, stream, unit
from textloom.session import Stash

#: Shingles whose arrivals are drawn at once.
CHUNK = 200_000
#: Registers whose last byte goes into a record's sketch.
SKETCH = 64
#: A bucket of a band is worked on in parts of about so many records; how many there are is told by one of SAMPLE records.
BUCKET, SAMPLE = 256, 32


def shingles(tokens: list[str], n: int, memory: TokenHash) -> np.ndarray:
    """Hashes of the sequences of n consecutive tokens, repeated ones too."""
    return ordered(hashed(tokens, memory), n)


def prob_min_hash(sets: list[tuple[np.ndarray, np.ndarray | None]], m: int) -> np.ndarray:
    """Signatures of m registers for sets of (elements, weights or None for equal ones); a row of zeros for an empty set.

    Every element is a Poisson process whose rate is its weight and which the element itself seeds; each arrival falls into a
    register at random, and a register keeps the element that arrived first. Two signatures agree in a register with the
    probability Jaccard similarity of the sets, which for equal weights is the share of common elements. All processes are drawn
    side by side; one ends as soon as its next arrival is later than the latest register of its set.
    """
    sizes = np.array([len(e) for e, _ in sets])
    q, z = np.full(len(sets) * m, np.inf), np.zeros(len(sets) * m, np.uint64)
    if not 0 < m <= 2048:
        raise ValueError("1 to 2048 registers")
    if not sizes.sum():
        return z.reshape(len(sets), m)
    e = np.concatenate([e for e, _ in sets])
    rate = np.concatenate([np.ones(len(e)) if w is None else w.astype(np.float64) for e, w in sets])
    f = np.repeat(np.arange(len(sets)), sizes)
    h = np.zeros(len(e))
    latest = np.full(len(sets), np.inf)
    live = np.flatnonzero(rate > 0)
    even = bool((rate == 1.0).all())
    step = 0
    while len(live):
        # the waiting time is made of the number's upper 53 bits, the register of the lower 11
        x = stream(e[live], step)
        wait = -np.log(unit(x))
        lh = h[live] + (wait if even else wait / rate[live])
        lf = f[live]
        early = lh < latest[lf]
        live, lh, lf, x = live[early], lh[early], lf[early], x[early]
        h[live] = lh
        at = lf * m + (((x & np.uint64(2047)) * np.uint64(m)) >> np.uint64(11)).astype(np.int64)
        np.minimum.at(q, at, lh)
        won = lh == q[at]
        z[at[won]] = e[live[won]]
        if len(lf):
            touched = lf[np.r_[True, lf[1:] != lf[:-1]]]
            latest[touched] = q.reshape(-1, m)[touched].max(axis=1)
            live = live[lh < latest[lf]]
        step += 1
    return z.reshape(len(sets), m)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], weighted: bool) -> float:
    """Exact probability Jaccard of two sets (elements in order, weights); of equal weights, the plain Jaccard."""
    common, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    if not weighted:
        return len(common) / (len(a[0]) + len(b[0]) - len(common))
    union = np.union1d(a[0], b[0])
    x, y = np.zeros(len(union)), np.zeros(len(union))
    x[np.searchsorted(union, a[0])] = a[1]
    y[np.searchsorted(union, b[0])] = b[1]
    wa, wb = a[1][i], b[1][j]
    return float(sum(1.0 / np.maximum(x / p, y / q).sum() for p, q in zip(wa, wb)))


def weigher(weighted: bool):
    """What makes of shingles the different ones, in order, and their weights."""

    def weigh(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        e, c = np.unique(x, return_counts=True)
        return e, c.astype(np.float64) if weighted else np.ones(len(e))

    return weigh


class Near:
    """Links between records of one group (a workspace) whose similarity is ``threshold`` or more.

    Shingles are sequences of ``n`` consecutive tokens. With ``weighted`` a shingle weighs as often as it stands in the text,
    and the similarity is the probability Jaccard; else all weigh the same, and it is the share of distinct shingles in common.
    ``bands`` of ``rows`` registers: records of similarity s meet in a band with 1 - (1 - s^rows)^bands, at the defaults 0.996
    for 0.5, 0.99999 for 0.6 and 0.008 for 0.1. Pairs whose sketches, a byte of each of the first SKETCH registers, agree in
    fewer than ``threshold - slack`` of them are not verified (4.5 standard deviations at the defaults, where one pair of
    300,000 at the threshold is lost); all others are, on their whole texts. Buckets with very many records are salted: each
    record stands in one part of its bucket and meets all parts, so that no task has a whole one.

    Null ids, groups and texts count nowhere, rows that repeat an id count once, texts of fewer than n tokens have no shingles
    and resemble nothing; an empty table gives an empty result. Texts with the same shingles are one class from the start, so
    that copies cost nothing but their own row; links hold between classes, and ``members`` says who belongs to which.
    """

    def __init__(self, records: DataFrame, id: str, text: str, group: str, threshold: float = 0.5, n: int = 5, weighted: bool = False, bands: int = 84, rows: int = 4, slack: float = 0.28, pattern=CODE_TOKEN):
        self.stash = Stash(records.sparkSession)
        self.records = records.select(F.col(id).cast("long").alias("id"), F.col(group).cast("long").alias("grp"), F.col(text).alias("text")).where("id IS NOT NULL AND grp IS NOT NULL AND text IS NOT NULL")
        self.threshold, self.n, self.weighted, self.bands, self.rows, self.slack, self.pattern = threshold, n, weighted, bands, rows, slack, pattern
        signatures = self.stash.keep(self._signatures())
        members = signatures.groupBy("grp", "same1", "same2", "id").agg(F.lit(1)).select("grp", "same1", "same2", "id")
        first = members.groupBy("grp", "same1", "same2").agg(F.min("id").alias("rep"))
        self.members = self.stash.keep(members.join(first, ["grp", "same1", "same2"]).select("grp", "rep", "id", "same1", "same2"))
        # by those that are no representatives, which are fewer, in a table of their own whose true size the join's check sees: while
        # they are few, the signatures needn't be shuffled
        copies = self.stash.keep(self.members.where("rep <> id").select("id", "same1", "same2"))
        self.reps = signatures.join(copies, ["id", "same1", "same2"], "left_anti")
        self.links = self.stash.keep(self._verified(self._candidates()))

    def _signatures(self) -> DataFrame:
        m, rows, bands, n, find, weigh = self.bands * self.rows, self.rows, self.bands, self.n, self.pattern.findall, weigher(self.weighted)

        def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            memory = TokenHash()
            ids: list[int] = []
            groups: list[int] = []
            sets: list[tuple[np.ndarray, np.ndarray]] = []

            def flush() -> pa.RecordBatch:
                z = prob_min_hash(sets, m)
                keys = np.zeros((len(sets), bands), np.uint64)
                salt = np.array(groups, np.int64).view(np.uint64)
                with np.errstate(over="ignore"):
                    for b in range(bands):
                        key = stream(salt, b)
                        for r in range(rows):
                            key = mix(key * np.uint64(31) + z[:, b * rows + r])
                        keys[:, b] = key
                    same = [(int(s.sum(dtype=np.uint64)), int(mix(s ^ np.uint64(len(s))).sum(dtype=np.uint64))) for s in (mix(e) * mix((w * 977).astype(np.uint64)) for e, w in sets)]
                    sketch = (mix(z[:, :SKETCH]) & np.uint64(255)).astype(np.uint8)
                offsets = np.arange(0, len(sets) * bands + 1, bands, dtype=np.int32)
                return pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids, pa.int64()), pa.array(groups, pa.int64()), pa.array(signed(np.array([s[0] for s in same], np.uint64))), pa.array(signed(np.array([s[1] for s in same], np.uint64))),
                        pa.array([r.tobytes() for r in sketch], pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(signed(keys.reshape(-1)))),
                    ], names=["id", "grp", "same1", "same2", "sketch", "keys"],
                )

            size = 0
            for batch in batches:
                for i, g, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                    s = shingles(find(t.as_py()), n, memory)
                    if not len(s):
                        continue
                    ids.append(i)
                    groups.append(g)
                    sets.append(weigh(s))
                    size += len(sets[-1][0])
                    if size >= CHUNK:
                        yield flush()
                        ids, groups, sets, size = [], [], [], 0
            if sets:
                yield flush()

        return self.records.mapInArrow(sign, "id long, grp long, same1 long, same2 long, sketch binary, keys array<long>")

    def _bucket_parts(self, keys: DataFrame) -> DataFrame:
        """(key, parts) of buckets that are estimated to have more than two parts. It only says how they are worked on."""
        sample = keys.where(F.pmod(F.xxhash64("id"), F.lit(SAMPLE)) == 0).groupBy("key").agg(F.count("*").alias("n"))
        return self.stash.keep(sample.where(F.col("n") * SAMPLE > 2 * BUCKET).select("key", F.ceil(F.col("n") * SAMPLE / BUCKET).cast("int").alias("parts")))

    def _candidates(self) -> DataFrame:
        keys = self.reps.select("id", F.explode("keys").alias("key"))
        hot = self._bucket_parts(keys)
        if hot.isEmpty():
            left, right, on = keys.withColumnRenamed("id", "a"), keys.withColumnRenamed("id", "b"), ["key"]
        else:
            parted = keys.join(hot, "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
            left = parted.select("key", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), F.col("id").alias("a"))
            right = parted.select("key", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("id").alias("b"))
            on = ["key", "part"]
        pairs = self.stash.keep(left.join(right, on).where("a < b").select("a", "b").distinct())
        sketch = self.reps.select("id", "sketch")
        pairs = pairs.join(sketch.select(F.col("id").alias("a"), F.col("sketch").alias("sa")), "a").join(sketch.select(F.col("id").alias("b"), F.col("sketch").alias("sb")), "b")
        least = (self.threshold - self.slack) * min(SKETCH, self.bands * self.rows)

        def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("sa", "sb"))
                keep = pa.array((x == y).sum(axis=1) >= least)
                yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in ("a", "b")], names=["a", "b"])

        return self.stash.keep(pairs.select("a", "b", "sa", "sb").mapInArrow(likely, "a long, b long"))

    def _verified(self, pairs: DataFrame) -> DataFrame:
        threshold, n, find, weigh, weighted = self.threshold, self.n, self.pattern.findall, weigher(self.weighted), self.weighted
        # only texts that are in a pair travel
        ids = self.stash.keep(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct())
        text = self.records.select("id", "text").join(ids, "id", "left_semi")
        both = pairs.join(text.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a").join(text.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")

        def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            memory = TokenHash()
            seen: dict[int, tuple[np.ndarray, np.ndarray]] = {}

            def of(i: int, t: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
                if i not in seen:
                    if len(seen) >= 300:
                        seen.clear()
                    seen[i] = weigh(shingles(find(t.as_py()), n, memory))
                return seen[i]

            for batch in batches:
                a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                s = [similarity(of(x, tx), of(y, ty), weighted) for x, y, tx, ty in zip(a, b, batch.column(2), batch.column(3))]
                keep = [k for k, v in enumerate(s) if v >= threshold]
                yield pa.RecordBatch.from_arrays([pa.array([a[k] for k in keep], pa.int64()), pa.array([b[k] for k in keep], pa.int64()), pa.array([s[k] for k in keep], pa.float64())], names=["a", "b", "similarity"])

        return both.select("a", "b", "ta", "tb").mapInArrow(verify, "a long, b long, similarity double").distinct()

    def pairs(self) -> DataFrame:
        """(a, b), a < b: all pairs of records, copies too; as many rows as there are such pairs."""
        m = self.members.select("rep", "id")
        left, right = m.select(F.col("rep").alias("ra"), F.col("id").alias("x")), m.select(F.col("rep").alias("rb"), F.col("id").alias("y"))
        linked = self.links.select(F.col("a").alias("ra"), F.col("b").alias("rb")).join(left, "ra").join(right, "rb").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        copies = left.join(right, F.col("ra") == F.col("rb")).where("x < y").select(F.col("x").alias("a"), F.col("y").alias("b"))
        return linked.unionByName(copies)

    def groups(self) -> DataFrame:
        """(id, grp, class_id, n_links): for each record with shingles the smallest id linked to it directly or over others, and
        the number of other classes that its own class is linked to."""
        ends = self.links.select(F.col("a").alias("rep")).unionByName(self.links.select(F.col("b").alias("rep"))).groupBy("rep").agg(F.count("*").alias("n_links"))
        joined = self.members.join(components(self.links).withColumnRenamed("id", "rep"), "rep", "left").join(ends, "rep", "left")
        return joined.select("id", "grp", F.coalesce("group_id", "rep").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def near(records: DataFrame, id: str = "file_id", text: str = "content", group: str = "workspace_id", **options) -> Near:
    return Near(records, id, text, group, **options)


def member_means(groups: DataFrame, scores: DataFrame, value: Column) -> DataFrame:
    """Adds the mean of a value over the rows of ``scores`` (id, ...) for each class; null and NaN values count nowhere."""
    clean = scores.withColumn("v", value).where("v IS NOT NULL AND NOT isnan(v)")
    by_id = clean.groupBy("id").agg(F.sum("v").alias("s"), F.count("*").alias("c"))
    means = groups.join(by_id, "id").groupBy("class_id").agg((F.sum("s") / F.sum("c")).alias("mean_score"))
    return groups.join(means, "class_id", "left")
