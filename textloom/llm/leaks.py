"""Passages of held-out items in a corpus, by spaced-seed hashing."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.hashing import WORD, TokenHash, hashed, mix
from textloom.session import Stash

#: Masks over 12 words: 1 marks a word that has to agree, 0 one that is ignored. All begin and end with 1.
MASKS = ("111010010111", "110110101011", "101111001101")
#: With MASKS, hits every passage of 16 words with two substitutions.
FOURTH = "11001101100111"
#: Placements of substitutions that are tried one by one; where there are more, a run of intact words is relied on.
MOST_PLACEMENTS = 200_000
#: The filter that the corpus is held against before anything is shuffled has about so many bits for each seed of the items, and
#: as a power of 2 at least and at most so many: half a megabyte to 16. Beyond, it lets more pass, which the join sorts out.
BITS_A_SEED, LEAST_BITS, MOST_BITS = 64, 22, 27


def missed(masks: tuple[str, ...], least: int, errors: int) -> list[tuple[int, ...]]:
    """The placements of ``errors`` substitutions in a passage of ``least`` words of which no mask has a hit at any offset."""
    hits = [sum(1 << o + j for j, bit in enumerate(m) if bit == "1") for m in masks for o in range(least - len(m) + 1)]
    out = []
    for places in combinations(range(least), errors):
        changed = sum(1 << i for i in places)
        if all(h & changed for h in hits):
            out.append(places)
    return out


@lru_cache
def complete(masks: tuple[str, ...], least: int, errors: int) -> tuple[str, ...]:
    """The masks, and one more if they miss any placement of ``errors`` substitutions in ``least`` words: FOURTH if it hits all,
    else the run of words that stays intact wherever the substitutions are."""
    few = math.comb(least, errors) <= MOST_PLACEMENTS
    if few and not missed(masks, least, errors):
        return masks
    if few and len(FOURTH) <= least and not missed((*masks, FOURTH), least, errors):
        return (*masks, FOURTH)
    return (*masks, "1" * math.ceil((least - errors) / (errors + 1)))


@lru_cache
def sufficient(masks: tuple[str, ...], least: int, errors: int) -> tuple[str, ...]:
    """The first of the complete masks that miss nothing by themselves; without errors, one."""
    masks = complete(masks, least, errors)
    if math.comb(least, errors) > MOST_PLACEMENTS:
        return masks
    return next(masks[:k] for k in range(1, len(masks) + 1) if not missed(masks[:k], least, errors))


def _seeds(h: np.ndarray, masks: tuple[str, ...]) -> list[np.ndarray]:
    """For each mask the hashes of the words it minds, at every position at which it fits."""
    out = []
    for k, mask in enumerate(masks):
        n = len(h) - len(mask) + 1
        if n < 1:
            out.append(np.empty(0, np.uint64))
            continue
        x = np.full(n, k + 1, np.uint64)
        with np.errstate(over="ignore"):
            for j, bit in enumerate(mask):
                if bit == "1":
                    x = x * np.uint64(0xD6E8FEB86659FD93) + h[j : j + n]
            out.append(mix(x))
    return out


def _rows(rows: DataFrame, masks: tuple[str, ...], allowed: np.ndarray | None) -> DataFrame:
    """(id, mask, pos, seed) of each seed; with ``allowed`` only of those whose bit is set in it."""
    shared = rows.sparkSession.sparkContext.broadcast(allowed) if allowed is not None else None

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = TokenHash()
        table = shared.value if shared else None
        shift = np.uint64(64 - (len(table) * 64).bit_length() + 1) if shared else None
        for batch in batches:
            cols: list[list[np.ndarray]] = [[], [], [], []]
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                h = hashed(WORD.findall(t.as_py().lower()), memory)
                for k, s in enumerate(_seeds(h, masks)):
                    pos = np.arange(len(s), dtype=np.int64)
                    if table is not None:
                        cell = (s >> shift).astype(np.int64)
                        pos = pos[(table[cell >> 6] >> (cell & 63).astype(np.uint64)) & np.uint64(1) == 1]
                    if len(pos):
                        for c, v in zip(cols, (np.full(len(pos), i, np.int64), np.full(len(pos), k, np.int64), pos, s[pos].view(np.int64))):
                            c.append(v)
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], names=["id", "mask", "pos", "seed"])

    return rows.mapInArrow(make, "id long, mask long, pos long, seed long")


def _filter(seeds: DataFrame) -> np.ndarray:
    """A bit for the first bits of each seed. What comes to the driver is at most 2^MOST_BITS / 64 words."""
    bits = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(max(seeds.count(), 1) * BITS_A_SEED))))
    cell = F.shiftrightunsigned("seed", 64 - bits)
    words = seeds.select(F.shiftright(cell, 6).alias("w"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(seed, {64 - bits}) & 63 AS INT))").alias("bit")).groupBy("w").agg(F.bit_or("bit").alias("bits"))
    out = np.zeros(2 ** (bits - 6), np.uint64)
    for w, found in words.toPandas().itertuples(index=False):
        out[w] = np.uint64(found & 0xFFFFFFFFFFFFFFFF)
    return out


def overlaps(a: list[str], b: list[str], shift: int, least: int, errors: int) -> list[tuple[int, int, int]]:
    """Longest stretches (start in a, words, differing words) of ``least`` words or more in which a[i] and b[i - shift] differ in at most ``errors``."""
    lo, hi = max(0, shift), min(len(a), len(b) + shift)
    bad = [i for i in range(lo, hi) if a[i] != b[i - shift]]
    edges = [lo - 1, *bad, hi]
    out: list[tuple[int, int, int]] = []
    for k in range(len(edges) - 1):
        j = min(k + errors + 1, len(edges) - 1)
        start, stop = edges[k] + 1, edges[j]
        if stop - start >= least and not (out and out[-1][0] + out[-1][1] >= stop):
            out.append((start, stop - start, j - k - 1))
    return out


def leaks(docs: DataFrame, items: DataFrame, doc: str = "doc_id", item: str = "item_id", text: str = "text", least: int = 12, errors: int = 0, masks: tuple[str, ...] = MASKS) -> DataFrame:
    """(doc, item, doc_word, words, differing): for each document and item the longest common passage of ``least`` words or more
    of which at most ``errors`` differ; of equally long ones, the one with fewer differing words, then the first.

    Words are the runs of a-z and 0-9 after lower-casing. Null ids and texts count nowhere; an item or document of fewer words
    has no passage; repeated ids count once for each of their texts; empty tables give an empty result. Every
    passage is found: the masks are completed so that one of them has a hit wherever the differing words are.

    Seeds of the documents are first held against a bit filter over the seeds of the items, whose size has a bound; what passes is joined
    to the items' seeds by hash, in whatever way Spark's size check picks, so that neither side has to be small. Every hit is
    verified on the words of both texts around it.
    """
    if max(map(len, masks)) > least or not 0 <= errors < least:
        raise ValueError("masks can't be longer than a passage, nor errors less than 0 or as many as its words")
    masks = sufficient(tuple(masks), least, errors)
    docs = docs.select(F.col(doc).cast("long").alias("id"), F.col(text).alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    items = items.select(F.col(item).cast("long").alias("id"), F.col(text).alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    wanted = Stash(items.sparkSession).keep(_rows(items, masks, None))
    hits = _rows(docs, masks, _filter(wanted))
    wanted = wanted.select(F.col("id").alias("item"), "mask", F.col("pos").alias("at"), "seed")
    # One hit for each alignment of a document with an item is enough: the alignment is verified as a whole.
    aligned = hits.join(wanted, ["mask", "seed"]).select(F.col("id").alias("doc"), "item", (F.col("pos") - F.col("at")).alias("shift")).distinct()
    aligned = aligned.join(docs.select(F.col("id").alias("doc"), F.col("text").alias("t")), "doc").join(items.select(F.col("id").alias("item"), F.col("text").alias("u")), "item")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            last, words = None, []
            known: dict[str, list[str]] = {}
            for d, i, shift, t, u in zip(*(batch.column(c).to_pylist() for c in ("doc", "item", "shift", "t", "u"))):
                if t != last:
                    last, words = t, WORD.findall(t.lower())
                if u not in known:
                    known[u] = WORD.findall(u.lower())
                for start, n, bad in overlaps(words, known[u], shift, least, errors):
                    out.append((d, i, start + 1, n, bad))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in (zip(*out) if out else [[]] * 5)], names=["doc", "item", "doc_word", "words", "differing"])

    found = aligned.select("doc", "item", "shift", "t", "u").mapInArrow(verify, "doc long, item long, doc_word long, words long, differing long")
    best = found.groupBy("doc", "item").agg(F.min(F.struct((-F.col("words")).alias("n"), "differing", "doc_word")).alias("x"))
    return best.select(F.col("doc").alias(doc), F.col("item").alias(item), F.col("x.doc_word").alias("doc_word"), (-F.col("x.n")).alias("words"), F.col("x.differing").alias("differing"))
