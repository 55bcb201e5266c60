"""A corpus mixed from sources by target shares of its tokens."""

from __future__ import annotations

import base64
import math
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.hashing import mix
from textloom.operators.hierarchy import grouped_prefix_sum
from textloom.session import Stash, tasks

#: Where the public tokenizers' files are; a parameter of every function that needs one. On a cluster every executor needs the file
#: at this path.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how the byte-level vocabulary splits a text before it merges bytes.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(2)
def encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def source_name(column: str) -> F.Column:
    """Sources are the same whatever their case and the blanks around them; an empty name is none."""
    return F.nullif(F.lower(F.trim(F.col(column))), F.lit(""))


def permuted(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1 at the given places: four Feistel rounds, repeated on what falls outside."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask, h = np.uint64((1 << half) - 1), np.uint64(half)
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    with np.errstate(over="ignore"):
        while len(todo):
            x = out[todo]
            left, right = x >> h, x & mask
            for r in range(4):
                left, right = right, left ^ (mix(right + np.uint64((key * 4 + r) & 0xFFFFFFFFFFFFFFFF) * np.uint64(0x9E3779B97F4A7C15)) & mask)
            out[todo] = (left << h) | right
            todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def shard_counts(shares: np.ndarray, size: int, seed: int, shard: int) -> np.ndarray:
    """How many of a shard's slots each source gets: the whole part of its share, and a multinomial draw of what remains.

    This residual form of the multinomial draw has the same means, but a variance below 1 for each source and shard, so that over
    n shards a source is off its share by less than sqrt(n) slots in the mean, instead of by the square root of its slots."""
    whole = np.floor(shares * size + 1e-9).astype(np.int64)
    rest = size - int(whole.sum())
    left = np.maximum(shares * size - whole, 0)
    if rest <= 0 or left.sum() <= 0:
        return whole
    return whole + np.random.Generator(np.random.Philox(key=[seed, shard])).multinomial(rest, left / left.sum())


class Mix:
    """Blocks of ``block`` tokens from each source, and the slots of the corpus they go to.

    The documents of a source stand in a pseudorandom order as one run of tokens, cut into blocks; the last one may be shorter.
    The corpus has shards of ``shard`` slots, the last one what is left. Every shard draws how many of its slots go to which source;
    a source's slots, counted over all shards, go through its blocks in a pseudorandom order, another one each time round, with the
    shorter block at the end, and end after ``max_repeats`` rounds. So no block, and no document, is used more often than that; a
    slot that falls to a source after its end stays empty.

    By default the corpus is as large as it can be with every source at its target; ``total_tokens`` sets another size, at which
    sources that run out give way to the others, and of which the corpus stays below by less than a block, as far as there are
    tokens. Shares are relative to the sources that have documents: a source with a target but no documents can't have a share,
    and documents without a target aren't used. Of targets that repeat a source, shares add up and the lowest cap counts; null
    shares count as 0, null caps as 1. Null texts, ids and sources are no case; rows that repeat an id with the same text count
    once; texts without tokens take no place; empty tables give an empty corpus.
    """

    def __init__(self, docs: DataFrame, targets: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", share: str = "target_share", repeats: str = "max_repeats", block: int = 64, shard: int = 500, seed: int = 1, total_tokens: int | None = None, tokenizer: str = TOKENIZER):
        self.stash = stash = Stash(docs.sparkSession)
        self.block, self.shard, self.seed = block, shard, seed
        targets = targets.select(source_name(source).alias("source"), F.greatest(F.coalesce(F.col(share), F.lit(0.0)), F.lit(0.0)).alias("share"), F.coalesce(F.col(repeats), F.lit(1)).alias("cap"))
        self.targets = targets.where("source IS NOT NULL").groupBy("source").agg(F.sum("share").alias("share"), F.min("cap").alias("cap"))
        docs = docs.select(F.col(id).cast("long").alias("id"), source_name(source).alias("source"), F.col(text).alias("text")).where("id IS NOT NULL AND source IS NOT NULL AND text IS NOT NULL")
        docs = docs.join(self.targets.select("source"), "source", "left_semi").select("id", "source", "text")

        def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            encode = encoder(tokenizer).encode_ordinary
            for b in batches:
                tokens = [encode(t.as_py()) for t in b.column(2)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(tokens, pa.list_(pa.int32()))], names=["id", "source", "tokens"])

        self.tokens = stash.keep(docs.mapInArrow(tokenize, "id long, source string, tokens array<int>").where("size(tokens) > 0"))
        sizes = self.tokens.groupBy("id").agg(F.min("source").alias("source"), F.max(F.size("tokens")).cast("long").alias("n")).withColumn("rank", F.xxhash64("id", F.lit(seed)))
        self.placed = stash.keep(grouped_prefix_sum(stash, sizes, "source", [F.col("rank"), F.col("id")], "n", "start"))
        self.plan = self._plan(total_tokens)

    def _plan(self, total_tokens: int | None) -> list[dict]:
        """Of each source: tokens, blocks, slots and its part of all slots. One row for each source with a target comes to the driver."""
        have = self.placed.groupBy("source").agg(F.sum("n").alias("tokens"))
        rows = [r.asDict() for r in self.targets.join(have, "source", "left").orderBy("source").collect()]
        for r in rows:
            r["tokens"] = r["tokens"] or 0
            r["blocks"] = -(-r["tokens"] // self.block)
            r["most"] = r["blocks"] * max(r["cap"], 0)
            r["aim"] = 0.0
        live = [r for r in rows if r["most"] and r["share"] > 0]
        self.full, self.last = 0, 0
        if not live:
            return rows
        room = lambda r: r["tokens"] * r["cap"]
        whole = sum(r["share"] for r in live)
        total = min(room(r) * whole / r["share"] for r in live) if total_tokens is None else min(total_tokens, sum(map(room, live)))
        left, open_ = total, list(live)
        while open_:
            part = sum(r["share"] for r in open_)
            full = [r for r in open_ if room(r) < left * r["share"] / part]
            for r in full or open_:
                # a source with a short last block needs more slots for the same tokens
                r["aim"] = (room(r) if full else left * r["share"] / part) * r["blocks"] / r["tokens"]
            if not full:
                break
            left -= sum(map(room, full))
            open_ = [r for r in open_ if r not in full]
        slots = sum(r["aim"] for r in live)
        for r in live:
            r["aim"] /= slots
        self.full, self.last = divmod(math.floor(slots + 1e-9), self.shard)
        self.plan = rows
        if total_tokens is not None:
            self.last = self._last_shard(total)
        return rows

    def _last_shard(self, total: float) -> int:
        """The size of the last shard at which the corpus comes nearest to ``total`` tokens from below. If the shards before it have
        more than that already, they are one less. One row for each source comes to the driver."""
        names, aims = self._aims()
        at = {r["source"]: r for r in self.plan}
        while True:
            drawn = {r["source"]: r["n"] for r in self._drawn(self.full, 0).groupBy("source").agg(F.sum("count").alias("n")).collect()}
            best = None
            for size in range(2 * self.shard + 1):
                counts = shard_counts(aims, size, self.seed, self.full)
                tokens = sum(self._tokens(at[s], drawn.get(s, 0) + int(c)) for s, c in zip(names, counts))
                if tokens <= total and (best is None or tokens > best[0]):
                    best = (tokens, size)
            if best or not self.full:
                return best[1] if best else 0
            self.full -= 1

    def _tokens(self, r: dict, slots: int) -> int:
        """Tokens in so many slots of a source: the last block comes last in every round."""
        slots = min(slots, r["most"])
        return slots * self.block - slots // r["blocks"] * (r["blocks"] * self.block - r["tokens"])

    def _aims(self) -> tuple[list[str], np.ndarray]:
        live = [r for r in self.plan if r["aim"] > 0]
        return [r["source"] for r in live], np.array([r["aim"] for r in live])

    def _drawn(self, full: int, last: int) -> DataFrame:
        """(shard, source, count) of ``full`` whole shards and one of ``last`` slots."""
        names, aims = self._aims()
        whole, seed = self.shard, self.seed

        def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for s in b.column(0).to_pylist():
                    counts = shard_counts(aims, whole if s < full else last, seed, s)
                    yield pa.RecordBatch.from_arrays([pa.array([s] * len(names), pa.int64()), pa.array(names, pa.string()), pa.array(counts)], names=["shard", "source", "count"])

        return self.targets.sparkSession.range(full + (last > 0)).mapInArrow(draw, "shard long, source string, count long")

    def slots(self) -> DataFrame:
        """(shard, source, count, first): slots of a source in a shard, and how many it has in the shards before."""
        return grouped_prefix_sum(self.stash, self._drawn(self.full, self.last), "source", [F.col("shard")], "count", "first")

    def uses(self) -> DataFrame:
        """(shard, place, source, block, round): which block each slot holds."""
        plan = {r["source"]: (k, r["blocks"], r["most"]) for k, r in enumerate(self.plan)}
        seed = self.seed

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for shard, source, count, first in zip(*(c.to_pylist() for c in b.columns)):
                    k, blocks, most = plan[source]
                    j = np.arange(first, min(first + count, most))
                    if not len(j):
                        continue
                    rounds, at = j // blocks, j % blocks
                    block = at.copy()
                    for r in np.unique(rounds):
                        sel = (rounds == r) & (at < blocks - 1)
                        block[sel] = permuted(at[sel], blocks - 1, (seed * 1_000_003 + k) * 1_000_003 + int(r))
                    n = len(j)
                    yield pa.RecordBatch.from_arrays([pa.array([shard] * n, pa.int64()), pa.array([source] * n, pa.string()), pa.array(block), pa.array(rounds), pa.array(j)], names=["shard", "source", "block", "round", "slot"])

        # few rows that become many: a number of tasks that Spark doesn't merge by size
        rows = self.slots().select("shard", "source", "count", "first").repartition(tasks(self.targets.sparkSession), "shard")
        return rows.mapInArrow(place, "shard long, source string, block long, round long, slot long")

    def blocks(self) -> DataFrame:
        """(source, block, tokens): at most ``block`` tokens each; a task holds one block at a time."""
        size = self.block

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                cols: list[list] = [[], [], [], []]
                for source, start, tokens in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                    tokens = tokens.values
                    p = 0
                    while p < len(tokens):
                        at = start + p
                        n = min(size - at % size, len(tokens) - p)
                        for c, v in zip(cols, (source, at // size, at % size, tokens.slice(p, n))):
                            c.append(v)
                        p += n
                if cols[0]:
                    lengths = np.cumsum([0, *map(len, cols[3])]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.ListArray.from_arrays(pa.array(lengths), pa.concat_arrays(cols[3]))], names=["source", "block", "at", "part"])

        whole = self.tokens.select("id", "tokens").join(self.placed.select("id", "source", "start"), "id").select("source", "start", "tokens")
        parts = whole.mapInArrow(cut, "source string, block long, at long, part array<int>")
        return parts.groupBy("source", "block").agg(F.array_sort(F.collect_set(F.struct("at", "part"))).alias("x")).select("source", "block", F.flatten("x.part").alias("tokens"))

    def corpus(self) -> DataFrame:
        """(shard, slot, source, block, round, tokens). ``slot`` counts a source's slots over all shards."""
        # written first, so that the size check of the join sees the rows there are and not those they are made from
        return self.stash.keep(self.uses()).join(self.blocks(), ["source", "block"]).select("shard", "slot", "source", "block", "round", "tokens")

    def shares(self) -> DataFrame:
        """For each source with a target: its target share, the share reached, tokens, blocks, tokens there are, and the most
        often that a block is used."""
        spark = self.targets.sparkSession
        plan = spark.createDataFrame([(r["source"], float(r["share"]), int(r["cap"]), int(r["tokens"]), int(r["blocks"])) for r in self.plan], "source string, target_share double, max_repeats int, tokens_there long, n_blocks long")
        last = F.when(F.col("block") == F.col("n_blocks") - 1, F.col("tokens_there") - F.col("block") * self.block).otherwise(self.block)
        used = self.uses().join(plan.select("source", "n_blocks", "tokens_there"), "source")
        # A block is used once each round: the rounds begun are the most uses of any.
        used = used.groupBy("source").agg(F.sum(last).alias("tokens"), F.count("*").alias("slots"), (F.max("round") + 1).alias("most_uses"))
        # one row for each source
        used = used.withColumn("all", F.sum("tokens").over(Window.partitionBy(F.lit(0))))
        return plan.join(used, "source", "left").select(
            "source", "target_share", F.coalesce(F.col("tokens") / F.col("all"), F.lit(0.0)).alias("reached_share"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("slots", F.lit(0)).alias("slots"),
            "tokens_there", F.coalesce("most_uses", F.lit(0)).alias("most_uses"), "max_repeats",
        )
