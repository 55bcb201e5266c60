import random

import pytest
from pyspark.sql import functions as F

from textloom.operators import hierarchy
from textloom.session import Stash

SCHEMA = "dir_id long, parent_id long, name string, node int, parent string, path int, size int"


def frame(spark, data):
    return spark.createDataFrame([(*r, 1, "x", 2, 3) for r in data], SCHEMA)


def brute(data):
    first = {}
    for n, p, name in sorted((r for r in data if r[0] is not None), key=lambda r: (r[1] is None, r[1] or 0, r[2] or "")):
        first.setdefault(n, (p, name))
    up = {n: p if p in first else None for n, (p, _) in first.items()}
    out = {}
    for n in up:
        seen, x = [n], n
        while up[x] is not None and up[x] not in seen:
            x = up[x]
            seen.append(x)
        out[n] = (-1, -1, None) if up[x] is not None else (x, len(seen) - 1, [first[y][1] or f"#{y}" for y in reversed(seen)])
    return out, up


def check(spark, data):
    want, up = brute(data)
    got = {r["dir_id"]: r for r in hierarchy.nested_sets(frame(spark, data)).collect()}
    assert {n: (r["root_id"], r["depth"], r["path"]) for n, r in got.items()} == want
    ancestors = {n: set() for n in want}
    for n in want:
        x = up[n]
        while want[n][0] != -1 and x is not None:
            ancestors[n].add(x)
            x = up[x]
    for n, r in got.items():
        below = {m for m in want if n in ancestors[m]}
        assert r["is_cycle"] == (want[n][0] == -1)
        if not r["is_cycle"]:
            assert r["n_below"] == len(below)
            assert below == {m for m, s in got.items() if s["root_id"] == r["root_id"] and r["pre"] < s["pre"] <= r["last"]}
    pairs = {(r["ancestor"], r["descendant"], r["distance"]) for r in hierarchy.descendants(hierarchy.nested_sets(frame(spark, data))).collect()}
    assert pairs == {(a, n, want[n][1] - want[a][1]) for n in want for a in ancestors[n]}


def test_random_forest_with_circles_and_a_hot_parent(spark):
    r = random.Random(3)
    data = [(i, r.choice([None, r.randrange(90), 3, 3]), r.choice(["a", "b", None])) for i in range(80)]
    data += [(200, 201, "x"), (201, 202, "y"), (202, 200, "z"), (203, 200, "below a circle"), (204, 204, "itself")]
    r.shuffle(data)
    check(spark, data)


def test_a_long_chain(spark):
    check(spark, [(i, i - 1 if i else None, f"n{i}") for i in range(70)])


def test_repeated_rows_null_ids_and_empty(spark):
    check(spark, [(1, None, "a"), (1, None, "a"), (2, 1, None), (2, 1, None), (None, 1, "x"), (3, 99, "orphan")])
    assert hierarchy.nested_sets(frame(spark, [])).count() == 0
    assert hierarchy.descendants(hierarchy.nested_sets(frame(spark, []))).count() == 0


def test_only_circles(spark):
    check(spark, [(1, 2, "a"), (2, 1, "b")])


def test_without_paths(spark):
    data = [(i, i // 3 if i else None, f"n{i}") for i in range(40)] + [(100, 100, "z")]
    with_paths, without = (hierarchy.nested_sets(frame(spark, data), paths=p) for p in (True, False))
    assert "path" not in without.columns and sorted(map(tuple, without.collect())) == sorted(map(tuple, with_paths.drop("path").collect()))


def test_weights(spark):
    data = [(1, None, "a"), (2, 1, "b"), (3, 2, "c")]
    weights = spark.createDataFrame([(1, 5), (3, 7), (3, 1), (None, 9), (42, 9)], "node long, weight long")
    got = {r["dir_id"]: r["weight_below"] for r in hierarchy.nested_sets(frame(spark, data), weights=weights).collect()}
    assert got == {1: 13, 2: 8, 3: 8}


@pytest.mark.parametrize("n", [1, 57])
def test_prefix_sums(spark, n):
    df = spark.range(300).select((F.col("id") % 3).alias("g"), "id", (F.col("id") * 7 % 11).alias("v")).repartition(n)
    got = {(r["g"], r["id"]): r["s"] for r in hierarchy.grouped_prefix_sum(Stash(spark), df, "g", [F.col("id")], "v", "s").collect()}
    assert got == {(g, i): sum(k * 7 % 11 for k in range(g, i, 3)) for g in range(3) for i in range(g, 300, 3)}
