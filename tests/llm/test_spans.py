import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from textloom.llm import spans

SCHEMA = "file_id long, content string, id string, start int, low long"


def frame(spark, data):
    return spark.createDataFrame([(*r, "x", 1, 2) for r in data], SCHEMA).repartition(3)


def brute(data, length):
    lines = {i: spans.split_lines(t) for i, t in data if i is not None and t is not None}
    where = {}
    for i, l in lines.items():
        for k in range(len(l) - length + 1):
            where.setdefault(tuple(l[k : k + length]), set()).add(i)
    out = []
    for i, l in lines.items():
        shared = {k + j for k in range(len(l) - length + 1) if len(where[tuple(l[k : k + length])]) > 1 for j in range(length)}
        for k in sorted(shared):
            if k - 1 not in shared:
                e = k
                while e + 1 in shared:
                    e += 1
                out.append((i, k + 1, e + 1))
    return sorted(out)


def run(spark, data, length):
    return sorted(tuple(r) for r in spans.shared_spans(frame(spark, data), length=length).collect())


def make(seed, n=25):
    r = random.Random(seed)
    pool = [[f"line {a} {b}" if r.random() > 0.2 else "" for b in range(12)] for a in range(6)]
    data = []
    for i in range(n):
        text = []
        for _ in range(r.randrange(0, 5)):
            text += r.choice(pool) if r.random() < 0.5 else [f"own {r.random()}" for _ in range(r.randrange(1, 6))]
        data.append((i, r.choice(["\n", "\r\n"]).join(text) + r.choice(["", "\n"])))
    return data


def test_against_brute_force(spark, monkeypatch):
    data = make(1)
    assert run(spark, data, 4) == brute(data, 4)
    monkeypatch.setattr(spans, "BLOCK", 20)
    assert run(spark, data, 4) == brute(data, 4)
    assert run(spark, data, 8) == brute(data, 8)


def test_edges(spark):
    text = "\n".join("abcdefgh")
    data = [(1, text), (1, text), (2, None), (None, text), (3, ""), (4, "a\nb"), (5, "\n" * 40), (6, "\n" * 9)]
    assert run(spark, data, 8) == [(5, 1, 40), (6, 1, 9)]
    assert run(spark, [], 8) == []
    assert run(spark, [(1, text + "\r\nx"), (2, text.replace("\n", "\r\n") + "\ny")], 8) == [(1, 1, 8), (2, 1, 8)]
    assert run(spark, [(1, text), (2, text + "\r")], 8) == []


def test_long_texts_and_a_hot_paragraph(spark, monkeypatch):
    monkeypatch.setattr(spans, "BLOCK", 50)
    hot = "\n".join(f"h{k}" for k in range(8))
    data = [(i, hot + f"\nown {i}") for i in range(120)] + [(500, "\n".join(f"z{k}" for k in range(50_000)))]
    assert run(spark, data, 8) == [(i, 1, 8) for i in range(120)]


def test_parts_and_clusters(spark):
    a, b = "\n".join(f"a{k}" for k in range(8)), "\n".join(f"b{k}" for k in range(8))
    data = [(1, a), (2, a + "\n" + b), (3, "x\n" + b + "\ny"), (4, "alone"), (5, "")]
    got = {r["file_id"]: (r["n_lines"], r["shared_lines"], round(r["share"], 3), r["cluster_id"]) for r in spans.shared_parts(frame(spark, data)).collect()}
    assert got == {1: (8, 8, 1.0, 1), 2: (16, 16, 1.0, 1), 3: (10, 8, 0.8, 1), 4: (1, 0, 0.0, 4), 5: (0, 0, 0.0, 5)}


def test_collisions_are_verified(spark, monkeypatch):
    """The same lines in another order collide in the band and have similarity 1, but their edit distance isn't 0."""
    monkeypatch.setattr(spans, "BLOCK", 8)
    lines = [f"l{k}" for k in range(8)]
    data = [(1, "\n".join(lines)), (2, "\n".join(reversed(lines))), (3, "\n".join(f"o{k}" for k in range(8)))]
    rows = frame(spark, data).select("file_id", "content").toDF("id", "text")
    candidates = {r["id"] for r in spans.collisions(spans._rows(rows.repartition(3, "id"), 8, False)).collect()}
    assert candidates == {1, 2} and run(spark, data, 8) == []


def test_the_band_loses_no_equal_paragraph():
    r = random.Random(5)
    for _ in range(50):
        same = [f"{r.random()}" for _ in range(8)]
        one, two = ([f"{r.random()}" for _ in range(r.randrange(20))] for _ in range(2))
        a, b = spans.paragraphs("\n".join(one + same), 8)[0], spans.paragraphs("\n".join(two + same + two), 8)[0]
        assert a[-1] == b[len(two)]


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text("ab\n\r", max_size=30), max_size=6))
def test_any(spark, texts):
    data = list(enumerate(texts))
    assert run(spark, data, 3) == brute(data, 3)
