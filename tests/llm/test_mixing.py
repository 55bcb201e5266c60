from collections import Counter

import numpy as np
import pytest

from textloom.llm import mixing


def test_permutations():
    for n in (1, 2, 3, 7, 64, 1000):
        p = mixing.permuted(np.arange(n), n, 5)
        assert sorted(p.tolist()) == list(range(n))
    assert mixing.permuted(np.arange(100), 100, 1).tolist() != mixing.permuted(np.arange(100), 100, 2).tolist()


def test_shard_counts():
    shares = np.array([0.5, 0.3, 0.155, 0.045])
    counts = np.array([mixing.shard_counts(shares, 101, 1, s) for s in range(300)])
    assert (counts.sum(axis=1) == 101).all() and (np.abs(counts.mean(axis=0) / 101 - shares) < 0.003).all()


def docs(spark, sizes, extra=()):
    rows = [(i, s, " ".join(f"word{(i * 31 + k) % 97}" for k in range(n)), "x") for i, (s, n) in enumerate(sizes)] + list(extra)
    return spark.createDataFrame(rows, "doc_id long, source string, text string, tokens string")


def targets(spark, rows):
    return spark.createDataFrame(rows, "source string, target_share double, max_repeats int")


@pytest.fixture(scope="module")
def mixed(spark):
    sizes = [("Big", 300)] * 40 + [("big ", 200)] * 10 + [("small", 150)] * 8 + [("mid", 100)] * 30 + [("untold", 50)] * 5
    extra = [(900, "small", None, "x"), (901, None, "some text", "x"), (902, "small", "", "x"), (None, "small", "text", "x"), (0, "Big", " ".join(f"word{k % 97}" for k in range(300)), "x")]
    return mixing.Mix(docs(spark, sizes, extra), targets(spark, [("big", 0.5, 2), ("small", 0.3, 3), (" MID", 0.2, 1), ("none", 0.2, 4), (None, 0.1, 1)]), block=16, shard=50)


def test_shares_and_caps(mixed):
    got = {r["source"]: r for r in mixed.shares().collect()}
    assert set(got) == {"big", "small", "mid", "none"} and got["none"]["tokens"] == 0
    for s, share in (("big", 0.5), ("small", 0.3), ("mid", 0.2)):
        assert abs(got[s]["reached_share"] - share) < 0.02
        assert got[s]["most_uses"] <= got[s]["max_repeats"]


def test_corpus_is_made_of_the_documents(mixed, spark):
    rows = mixed.corpus().collect()
    uses = Counter((r["source"], r["block"]) for r in rows)
    caps = {"big": 2, "small": 3, "mid": 1}
    assert rows and all(n <= caps[s] for (s, _), n in uses.items())
    assert all(len(r["tokens"]) <= 16 for r in rows)
    tokens = {r["source"]: r["tokens"] for r in mixed.shares().collect()}
    got = Counter()
    for r in rows:
        got[r["source"]] += len(r["tokens"])
    assert all(got[s] == n for s, n in tokens.items())


def test_blocks_round_trip(mixed):
    """All blocks of a source, one after the other, are its documents in their order."""
    placed = {(r["source"], r["start"]): r["id"] for r in mixed.placed.collect()}
    tokens = {r["id"]: r["tokens"] for r in mixed.tokens.collect()}
    blocks = mixed.blocks().collect()
    for source in ("big", "small", "mid"):
        run = [t for r in sorted((r for r in blocks if r["source"] == source), key=lambda r: r["block"]) for t in r["tokens"]]
        assert run == [t for (s, _), i in sorted(placed.items()) if s == source for t in tokens[i]]


def test_a_fixed_total_caps_small_sources(spark):
    m = mixing.Mix(docs(spark, [("a", 400)] * 20 + [("b", 100)] * 2), targets(spark, [("a", 0.5, 5), ("b", 0.5, 2)]), block=16, shard=40, total_tokens=8000)
    got = {r["source"]: r for r in m.shares().collect()}
    assert got["b"]["most_uses"] <= 2 and got["a"]["reached_share"] > 0.7


@pytest.mark.parametrize("total", [90, 1000, 3333, 7001])
def test_a_fixed_total_is_met(spark, total):
    """Below the total by less than a block, whatever the size of the shards."""
    d, t = docs(spark, [("a", 403)] * 20 + [("b", 101)] * 9), targets(spark, [("a", 0.7, 5), ("b", 0.3, 4)])
    for shard in (7, 50, 100_000):
        m = mixing.Mix(d, t, block=16, shard=shard, total_tokens=total)
        got = sum(len(r["tokens"]) for r in m.corpus().collect())
        assert total - 16 < got <= total, (total, shard, got)


def test_all_there_is(spark):
    """More than there is: every block as often as it may be used, but for the slots by which a source's draws fall short."""
    m = mixing.Mix(docs(spark, [("a", 100)] * 20), targets(spark, [("a", 1.0, 3)]), block=16, shard=40, total_tokens=10**9)
    assert set(Counter((r["source"], r["block"]) for r in m.uses().collect()).values()) == {3}


def test_no_part_of_a_shard_is_lost(spark):
    """By default the source that runs out first bounds the size, and all of it is used."""
    m = mixing.Mix(docs(spark, [("a", 100)] * 20), targets(spark, [("a", 1.0, 1)]), block=16, shard=1000)
    assert Counter(r["block"] for r in m.uses().collect()) == {k: 1 for k in range(m.plan[0]["blocks"])}


def test_variance_of_the_draws():
    shares = np.array([0.503, 0.2985, 0.1535, 0.045])
    counts = np.array([mixing.shard_counts(shares, 101, 1, s) for s in range(2000)])
    assert (counts.var(axis=0) < 1).all()


def test_empty(spark):
    none = mixing.Mix(docs(spark, []), targets(spark, [("a", 1.0, 1)]))
    assert none.corpus().count() == 0 and [tuple(r)[:4] for r in none.shares().collect()] == [("a", 1.0, 0.0, 0)]
    assert mixing.Mix(docs(spark, [("a", 10)]), targets(spark, [])).corpus().count() == 0


def test_same_seed_same_corpus(spark):
    make = lambda seed: sorted(tuple(r) for r in mixing.Mix(docs(spark, [("a", 200)] * 5 + [("b", 90)] * 5), targets(spark, [("a", 0.6, 1), ("b", 0.4, 1)]), block=8, shard=10, seed=seed).uses().collect())
    assert make(1) == make(1) != make(2)
