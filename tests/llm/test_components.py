import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from textloom.llm.components import components


def brute(links):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return sorted((x, find(x)) for x in parent)


def run(spark, links):
    df = spark.createDataFrame([(a, b, 0, 1) for a, b in links], "a long, b long, group_id int, v int")
    return sorted(tuple(r) for r in components(df).collect())


def test_chain_star_and_random(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(7, i) for i in range(1000, 1300)]
    random.seed(2)
    loose = [(random.randrange(2000, 2200), random.randrange(2000, 2200)) for _ in range(120)]
    links = chain + star + loose
    random.shuffle(links)
    assert run(spark, links) == brute(links)


def test_nulls_loops_repeats_and_directions(spark):
    links = [(1, 1), (None, 2), (3, None), (5, 4), (4, 5), (5, 4), (-9, 4)]
    assert run(spark, links) == [(-9, -9), (4, -9), (5, -9)]


def test_empty(spark):
    assert run(spark, []) == [] == run(spark, [(1, 1)])


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), max_size=25))
def test_any(spark, links):
    assert run(spark, links) == brute(links)
