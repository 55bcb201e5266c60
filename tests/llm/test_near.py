import random

import numpy as np
import pytest

from textloom.llm import near
from textloom.llm.hashing import CODE_TOKEN, TokenHash

SCHEMA = "file_id long, workspace_id long, content string, id string, grp string, text string"


def sets(text, weighted=False):
    return near.weigher(weighted)(near.shingles(CODE_TOKEN.findall(text), 5, TokenHash()))


def texts(seed, n):
    r = random.Random(seed)
    out = []
    for k in range(n):
        words = [f"w{r.randrange(400)}" for _ in range(r.randrange(60, 200))]
        out.append((3 * k, r.randrange(2), " ".join(words)))
        for j in (1, 2):
            if r.random() < 0.7:
                edited = list(words)
                for _ in range(r.randrange(0, 12)):
                    edited[r.randrange(len(edited))] = f"x{r.randrange(50)}"
                out.append((3 * k + j, out[-1][1], " ".join(edited)))
    return out


def brute(data, threshold, weighted=False):
    s = {f: sets(t, weighted) for f, _, t in data if t is not None}
    group = {f: g for f, g, _ in data}
    return sorted((a, b) for a in s for b in s if a < b and group[a] is not None and group[a] == group[b] and near.similarity(s[a], s[b], weighted) >= threshold)


def frame(spark, data):
    return spark.createDataFrame([(*r, "i", "g", "t") for r in data], SCHEMA)


@pytest.mark.parametrize("weighted", [False, True])
def test_against_brute_force(spark, weighted):
    data = texts(5, 30)
    found = near.near(frame(spark, data), weighted=weighted)
    assert sorted(tuple(r) for r in found.pairs().collect()) == brute(data, 0.5, weighted)


def test_salted_buckets_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(near, "BUCKET", 1)
    monkeypatch.setattr(near, "SAMPLE", 1)
    data = texts(6, 12)
    found = near.near(frame(spark, data))
    assert not found._bucket_parts(found.reps.selectExpr("id", "explode(keys) AS key")).isEmpty()
    assert sorted(tuple(r) for r in found.pairs().collect()) == brute(data, 0.5)


def test_recall_by_similarity(spark):
    """Of pairs just above the threshold 0.99 are found, of more similar ones all; none below."""
    r = random.Random(11)
    words = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    data, alike = [], {}
    for k in range(1200):
        common, own = words(100), [r.randrange(10, 56)] * 2
        one, two = (" ".join(common + words(n)) for n in own)
        alike[2 * k] = near.similarity(sets(one), sets(two), False)
        data += [(2 * k, k, one), (2 * k + 1, k, two)]
    found = {r["a"] for r in near.near(frame(spark, data)).pairs().collect()}
    assert all(alike[a] >= 0.5 for a in found)
    for low, high, least in ((0.5, 0.55, 0.98), (0.55, 0.6, 0.99), (0.6, 1.0, 1.0)):
        true = [a for a, s in alike.items() if low <= s < high]
        recall = sum(a in found for a in true) / len(true)
        print(f"recall of {len(true)} pairs of similarity {low} to {high}: {recall:.4f}")
        assert len(true) > 100 and recall >= least


def test_copies_nulls_short_and_repeated_rows(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    data = [(1, 1, a), (2, 1, a), (3, 1, a), (3, 1, a), (4, 2, a), (5, None, a), (None, 1, a), (6, 1, None), (7, 1, ""), (8, 1, "x y z"), (9, 1, "x y z"), (10, 1, b)]
    found = near.near(frame(spark, data))
    assert sorted(tuple(r) for r in found.pairs().collect()) == [(1, 2), (1, 3), (2, 3)]
    assert sorted(tuple(r) for r in found.groups().collect()) == [(1, 1, 1, 0), (2, 1, 1, 0), (3, 1, 1, 0), (4, 2, 4, 0), (10, 1, 10, 0)]


def test_long_text_and_empty_table(spark):
    r = random.Random(1)
    long = " ".join(f"w{r.randrange(10**6)}" for _ in range(60_000))
    found = near.near(frame(spark, [(1, 1, long), (2, 1, long + " more words at the end of it")]))
    assert [tuple(r) for r in found.pairs().collect()] == [(1, 2)]
    assert near.near(frame(spark, [])).pairs().count() == 0


def test_signatures_estimate_similarity():
    r = np.random.default_rng(3)
    for share in (0.2, 0.5, 0.8):
        n = 600
        common = r.integers(0, 2**63, int(n * share), dtype=np.uint64)
        a = np.unique(np.r_[common, r.integers(0, 2**63, n - len(common), dtype=np.uint64)])
        b = np.unique(np.r_[common, r.integers(0, 2**63, n - len(common), dtype=np.uint64)])
        z = near.prob_min_hash([(a, None), (b, None)], 1500)
        true = near.similarity((a, np.ones(len(a))), (b, np.ones(len(b))), False)
        assert abs((z[0] == z[1]).mean() - true) < 0.06
    w = np.where(np.arange(len(a)) % 2 == 0, 3.0, 1.0)
    x = np.where(np.isin(b, a), 2.0, 1.0)
    z = near.prob_min_hash([(a, w), (b, x)], 1500)
    assert abs((z[0] == z[1]).mean() - near.similarity((a, w), (b, x), True)) < 0.06


def test_scaling_all_weights_changes_nothing():
    a = np.arange(1, 50, dtype=np.uint64)
    z = near.prob_min_hash([(a, np.full(49, 1.0)), (a, np.full(49, 7.0)), (a[:0], None)], 64)
    assert (z[0] == z[1]).all() and not z[2].any()


def test_member_means(spark):
    groups = spark.createDataFrame([(1, 1, 1, 0), (2, 1, 1, 0), (3, 1, 3, 0)], "id long, grp long, class_id long, n_links long")
    scores = spark.createDataFrame([(1, 0.5), (2, 1.0), (2, None), (3, float("nan"))], "id long, score double")
    got = {r["id"]: r["mean_score"] for r in near.member_means(groups, scores, scores.score).collect()}
    assert got == {1: 0.75, 2: 0.75, 3: None}
