import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from textloom.llm import topn

SCHEMA = "file_id long, other long, score float, rank int, g string, bound double"


def brute(data, n):
    best = {}
    for g, i, s in data:
        if g is not None and i is not None and s is not None and s == s:
            best[g, i] = max(best.get((g, i), s), s)
    out = []
    for g in {g for g, _ in best}:
        ranked = sorted(((-s, i) for (h, i), s in best.items() if h == g))[:n]
        out += [(g, i, -s, k + 1) for k, (s, i) in enumerate(ranked)]
    return sorted(out)


def run(spark, data, n, parts=3):
    df = spark.createDataFrame([(*r, 1, "x", 0.5) for r in data], SCHEMA).repartition(parts)
    return sorted(tuple(r) for r in topn.top_n(df, "file_id", "other", "score", n).collect())


def test_against_brute_force_with_a_hot_group_and_ties(spark, monkeypatch):
    random.seed(1)
    data = [(1 if random.random() < 0.6 else random.randrange(2, 40), random.randrange(60), random.choice([0.25, 0.5, 0.75, 1.0])) for _ in range(3000)]
    monkeypatch.setattr(topn, "BLOCK_ROWS", 100)
    assert run(spark, data, 5) == brute(data, 5)
    assert run(spark, data, 1) == brute(data, 1)


def test_nulls_nans_repeats_and_small_groups(spark):
    nan = float("nan")
    data = [(1, 2, 0.5), (1, 2, 0.5), (1, 2, 0.75), (1, 3, None), (1, 4, nan), (None, 1, 1.0), (2, None, 1.0), (3, 1, 0.0), (3, 2, -1.0)]
    assert run(spark, data, 5) == brute(data, 5) == [(1, 2, 0.75, 1), (3, 1, 0.0, 1), (3, 2, -1.0, 2)]


def test_empty(spark):
    assert run(spark, [], 5) == []


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 6), st.sampled_from([0.0, 0.5, 1.0])), max_size=40), st.integers(1, 4))
def test_any(spark, data, n):
    assert run(spark, data, n) == brute(data, n)
