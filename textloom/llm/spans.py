"""Long spans of lines that stand verbatim in more than one record, by paragraph MinHash banding.

Every run of ``length`` consecutive lines is a paragraph with a MinHash signature over its lines, which makes its band. Paragraphs of
different records that collide in the band are candidates, and are verified: a pair counts if its edit distance over lines is 0,
which the equality of a hash of the lines in order tells. A band of r rows finds a paragraph pair of Jaccard similarity s with
probability s^r. What is looked for has similarity 1, so that one band loses none of it whatever its rows; these are tuned for
few candidates. Neighbouring paragraphs mostly have the same minima: what stands in a row in one band is one row of the join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.components import components
from textloom.llm.hashing import mix, ordered, signed, sliding_min, stream
from textloom.session import Stash

#: Paragraphs that a task gathers before it compares them among themselves.
BLOCK = 1_000_000
#: Minima in the band. More rows mean fewer candidates and more, shorter stretches; see the README for figures.
ROWS = 2

SCHEMA = "band long, words array<long>, low long, high long, id long, start int, stop int, kind int"


def split_lines(text: str) -> list[str]:
    """Lines end at LF or CRLF, which are no part of them; a final line end starts no new line."""
    lines = text.replace("\r\n", "\n").split("\n")
    if not lines[-1]:
        lines.pop()
    return lines


def paragraphs(text: str, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Band and ordered hash of each run of ``length`` lines."""
    lines = split_lines(text)
    if len(lines) < length:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(x.encode("utf-8", "surrogatepass")) for x in lines), np.uint64, len(lines))
    band = np.zeros(len(lines) - length + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(ROWS):
            band = mix(band * np.uint64(31) + sliding_min(stream(h, k), length))
    return band, ordered(h, length)


def _runs(ids: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unions of the spans [start, start + length) of each id, as (id, first, last); ids and starts in order."""
    if not len(ids):
        return ids, starts, starts
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (starts[1:] > starts[:-1] + length)
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(ids)] - 1
    return ids[first], starts[first], starts[last] + length - 1


def _stretches(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before in any of the columns."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _compare(length: int, with_links: bool, band, words, ids, starts) -> pa.RecordBatch:
    """What a block knows. Paragraphs in two of its records are verified already: they leave as whole runs of lines, and once, with
    the least and greatest id, for the records of other blocks. Of the others, neighbours in one band leave as one row. With links,
    each of a block's records leaves once more with the least record it shares each paragraph with. The kind of a row is 0: to be
    joined with those of other blocks, 1: known to be shared, 2: a link."""
    order = np.lexsort((starts, ids, words, band))
    band, words, ids, starts = band[order], words[order], ids[order], starts[order]
    first = _stretches(band, words)
    count = np.diff(np.r_[first, len(ids)])
    low, high = ids[first], ids[first + count - 1]
    shared = np.repeat(low != high, count)
    two = low != high
    # alone in the block: in the order of their records again, neighbours of one band together
    a_ids, a_starts, a_band, a_words = ids[~shared], starts[~shared], band[~shared], words[~shared]
    order = np.lexsort((a_starts, a_ids))
    a_ids, a_starts, a_band, a_words = a_ids[order], a_starts[order], a_band[order], a_words[order]
    at = _stretches(a_band, a_ids, a_starts - np.arange(len(a_starts)))
    # in two records: those of one band and the same least and greatest record together
    t_band, t_words, t_low, t_high = band[first][two], words[first][two], low[two], high[two]
    order = np.lexsort((t_high, t_low, t_band))
    t_band, t_words, t_low, t_high = t_band[order], t_words[order], t_low[order], t_high[order]
    t_at = _stretches(t_band, t_low, t_high)
    s_ids, s_starts = ids[shared], starts[shared]
    order = np.lexsort((s_starts, s_ids))
    r_ids, r_first, r_last = _runs(s_ids[order], s_starts[order], length)
    if with_links:
        l_ids, l_low = np.unique(np.stack([ids[shared], np.repeat(low, count)[shared]]), axis=1)
        l_ids, l_low = l_ids[l_ids != l_low], l_low[l_ids != l_low]
    else:
        l_ids = l_low = np.empty(0, np.int64)
    n_runs, n_links = len(r_ids), len(l_ids)
    zero, none = np.zeros(len(t_at), np.int64), np.zeros(n_links, np.int64)
    offsets = np.r_[at, len(a_words) + np.r_[t_at, np.full(n_runs + n_links + 1, len(t_words))]].astype(np.int32)
    cols = [
        np.r_[signed(a_band[at]), signed(t_band[t_at]), np.zeros(n_runs + n_links, np.int64)],
        np.r_[a_ids[at], t_low[t_at], r_ids, l_low],
        np.r_[a_ids[at], t_high[t_at], r_ids, l_ids],
        np.r_[a_ids[at], t_low[t_at], r_ids, l_ids],
        np.r_[a_starts[at], zero, r_first, none].astype(np.int32),
        np.r_[np.zeros(len(at), np.int64), zero, r_last, none].astype(np.int32),
        np.repeat(np.array([0, 1, 2], np.int32), [len(at) + len(t_at), n_runs, n_links]),
    ]
    values = pa.array(np.r_[signed(a_words), signed(t_words)])
    arrays = [pa.array(np.ascontiguousarray(c)) for c in cols]
    return pa.RecordBatch.from_arrays([arrays[0], pa.ListArray.from_arrays(pa.array(offsets), values), *arrays[1:]], names=["band", "words", "low", "high", "id", "start", "stop", "kind"])


def _rows(records: DataFrame, length: int, with_links: bool) -> DataFrame:
    """The rows of SCHEMA, block by block."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        for b in batches:
            for i, t in zip(b.column(0).to_numpy(zero_copy_only=False).tolist(), b.column(1)):
                band, words = paragraphs(t.as_py(), length)
                if len(band):
                    held.append((band, words, np.full(len(band), i, np.int64), np.arange(1, len(band) + 1, dtype=np.int64)))
                    size += len(band)
                if size >= BLOCK:
                    yield _compare(length, with_links, *(np.concatenate(x) for x in zip(*held)))
                    held, size = [], 0
        if size:
            yield _compare(length, with_links, *(np.concatenate(x) for x in zip(*held)))

    return records.mapInArrow(cut, SCHEMA)


def collisions(rows: DataFrame) -> DataFrame:
    """(band, words, low, high, id, start): the paragraphs whose band stands in rows of two records, one row each; start is 0 of what
    stands for records of a block that are verified among themselves."""
    rows = rows.where("kind = 0")
    hit = rows.groupBy("band").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low <> high").select("band")
    out = rows.join(hit, "band", "left_semi").select("band", "low", "high", "id", "start", F.posexplode("words").alias("at", "words"))
    return out.select("band", "words", "low", "high", "id", F.when(F.col("start") > 0, F.col("start") + F.col("at")).otherwise(0).cast("int").alias("start"))


def _shared(stash: Stash, records: DataFrame, id: str, text: str, length: int, with_links: bool = False) -> DataFrame:
    """Rows (id, low, start, stop, kind), where start isn't 0 of runs of lines in shared paragraphs; low is, of kinds 0 and 2, the
    least id that shares one."""
    if length < 1:
        raise ValueError("length has to be 1 or more")
    records = records.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    rows = stash.keep(_rows(records, length, with_links))
    candidates = stash.keep(collisions(rows))
    same = candidates.groupBy("band", "words").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low <> high").drop("high")
    verified = candidates.drop("low", "high").join(same, ["band", "words"])
    verified = verified.select("id", "low", "start", F.when(F.col("start") > 0, F.col("start") + (length - 1)).otherwise(0).alias("stop"), F.lit(0).alias("kind"))
    return rows.where("kind > 0").select("id", "low", "start", "stop", "kind").unionByName(verified)


def shared_spans(records: DataFrame, id: str = "file_id", text: str = "content", length: int = 8) -> DataFrame:
    """(id, start_line, end_line): each longest run of lines of a record all of which lie in spans of ``length`` lines that also
    stand, character for character, in a record with another id. Lines count from 1.

    Null ids and texts count nowhere; rows that repeat an id with the same text count once; texts with fewer lines, and empty
    ones, have no spans; an empty table gives an empty result.
    """
    return _union(_shared(Stash(records.sparkSession), records, id, text, length)).withColumnRenamed("id", id)


def _union(rows: DataFrame) -> DataFrame:
    line = Window.partitionBy("id").orderBy("start", "stop")
    reach = F.max("stop").over(line.rowsBetween(Window.unboundedPreceding, -1))
    runs = rows.where("start > 0").select("id", "start", "stop").withColumn("new", F.when(F.col("start") <= reach + 1, 0).otherwise(1))
    runs = runs.withColumn("run", F.sum("new").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("id", "run").agg(F.min("start").alias("start_line"), F.max("stop").alias("end_line")).select("id", "start_line", "end_line")


def shared_parts(records: DataFrame, id: str = "file_id", text: str = "content", length: int = 8) -> DataFrame:
    """For each record with a text: n_lines, shared_lines, share and cluster_id.

    ``cluster_id`` is the smallest id among the records linked by shared paragraphs directly or over others, or the record's own:
    keeping only the record that bears its cluster's id removes all that is shared within it. The share of a record without
    lines is 0. Nulls and repeated ids as in ``shared_spans``.
    """
    clean = records.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    ends = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))
    open_end = F.when((F.col("text") == "") | F.col("text").endswith("\n"), 0).otherwise(1)
    lines = clean.groupBy("id").agg(F.max(ends + open_end).cast("int").alias("n_lines"))
    stash = Stash(records.sparkSession)
    shared = stash.keep(_shared(stash, records, id, text, length, with_links=True))
    spans = _union(shared).groupBy("id").agg(F.sum(F.col("end_line") - F.col("start_line") + 1).cast("int").alias("shared_lines"))
    links = shared.where("low <> id AND kind <> 1").select(F.col("id").alias("a"), F.col("low").alias("b")).distinct()
    out = lines.join(spans, "id", "left").join(components(links), "id", "left")
    part = F.coalesce("shared_lines", F.lit(0))
    return out.select(F.col("id").alias(id), "n_lines", part.alias("shared_lines"), F.when(F.col("n_lines") > 0, part / F.col("n_lines")).otherwise(0.0).alias("share"), F.coalesce("group_id", "id").alias("cluster_id"))
