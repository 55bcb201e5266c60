import itertools
import random

import pytest

from textloom.llm import leaks as lk
from textloom.llm.hashing import WORD


def frames(spark, docs, items):
    return spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, id string, item long"), spark.createDataFrame([(*i, 0) for i in items], "item_id long, text string, doc long")


def run(spark, docs, items, **options):
    return sorted(tuple(r) for r in lk.leaks(*frames(spark, docs, items), **options).collect())


def brute(docs, items, least):
    out = set()
    for d, t in docs:
        for i, u in items:
            if None in (d, t, i, u):
                continue
            a, b = WORD.findall(t.lower()), WORD.findall(u.lower())
            grams = {tuple(b[k : k + least]) for k in range(len(b) - least + 1)}
            if any(tuple(a[k : k + least]) in grams for k in range(len(a) - least + 1)):
                out.add((d, i))
    return sorted(out)


def test_against_brute_force(spark):
    r = random.Random(4)
    word = lambda: f"w{r.randrange(300)}"
    items = [(i, " ".join(word() for _ in range(r.randrange(3, 60)))) for i in range(30)]
    docs = []
    for d in range(80):
        words = [word() for _ in range(r.randrange(0, 120))]
        if r.random() < 0.5:
            source = items[r.randrange(30)][1].split()
            k = r.randrange(len(source))
            at = r.randrange(len(words) + 1)
            words[at:at] = source[k : k + r.randrange(8, 30)]
        docs.append((d, r.choice([" ", ", ", "\n"]).join(w.upper() if r.random() < 0.3 else w for w in words)))
    assert [x[:2] for x in run(spark, docs, items)] == brute(docs, items, 12)


WORDS = [f"k{i}" for i in range(40)]


def test_substitutions(spark):
    item = " ".join(WORDS)
    changed = list(WORDS)
    changed[15] = "other"
    docs = [(1, "before " + " ".join(changed[2:30]) + " after"), (2, " ".join(WORDS[:11])), (3, " ".join(WORDS[5:17]))]
    assert run(spark, docs, [(9, item)], errors=0) == [(1, 9, 16, 14, 0), (3, 9, 1, 12, 0)]
    assert run(spark, docs, [(9, item)], errors=1) == [(1, 9, 2, 28, 1), (3, 9, 1, 12, 0)]


@pytest.mark.parametrize("least, errors", [(12, 1), (12, 2), (14, 2)])
def test_every_placement_is_found(spark, least, errors):
    """A passage of the least length with the most errors is found wherever these are, whether a mask skips them or not."""
    places = list(itertools.combinations(range(least), errors))
    docs = [(n, " ".join("other" if k in p else w for k, w in enumerate(WORDS[:least]))) for n, p in enumerate(places)]
    assert [r[:2] for r in run(spark, docs, [(9, " ".join(WORDS[:least]))], least=least, errors=errors)] == [(n, 9) for n in range(len(places))]


def test_sufficient_masks():
    assert lk.sufficient(lk.MASKS, 12, 0) == lk.MASKS[:1]
    for least, errors in [(12, 0), (12, 1), (12, 2), (13, 1), (16, 1), (16, 2), (20, 3)]:
        assert not lk.missed(lk.sufficient(lk.MASKS, least, errors), least, errors)


def test_the_filter_follows_the_seeds(spark, monkeypatch):
    item = [(9, " ".join(WORDS))]
    docs = [(1, " ".join(WORDS[3:20])), (2, " ".join(reversed(WORDS)))]
    for least_bits, most_bits in ((6, 6), (6, 27), (22, 27)):
        monkeypatch.setattr(lk, "LEAST_BITS", least_bits)
        monkeypatch.setattr(lk, "MOST_BITS", most_bits)
        assert run(spark, docs, item) == [(1, 9, 1, 17, 0)]


def test_masks_hit_every_placement():
    assert lk.missed(lk.MASKS, 16, 2) == [(3, 4), (4, 5), (4, 8), (4, 12), (11, 12)]
    assert lk.complete(lk.MASKS, 12, 0) == lk.MASKS and lk.complete(lk.MASKS, 16, 2) == (*lk.MASKS, lk.FOURTH)
    for least, errors in [(12, 0), (12, 1), (12, 2), (13, 1), (14, 3), (16, 1), (16, 2), (16, 4), (20, 3), (12, 11)]:
        masks = lk.complete(lk.MASKS, least, errors)
        assert max(map(len, masks)) <= least and not lk.missed(masks, least, errors)
    assert lk.complete(lk.MASKS, 100, 9)[3:] == ("1" * 10,)


def test_every_two_substitutions_in_16_words_are_found(spark):
    places = [(i, j) for i in range(16) for j in range(i + 1, 16)]
    docs = [(n, " ".join("other" if k in p else w for k, w in enumerate(WORDS[:16]))) for n, p in enumerate(places)]
    assert run(spark, docs, [(9, " ".join(WORDS[:16]))], least=16, errors=2) == [(n, 9, 1, 16, 2) for n in range(120)]


def test_edges(spark):
    item = " ".join(WORDS[:12])
    docs = [(1, None), (None, item), (2, ""), (3, "  . "), (4, item), (4, item), (5, " ".join(["a"] * 30_000) + " " + item)]
    assert run(spark, docs, [(9, item), (9, item), (8, None), (None, item), (7, "short one"), (6, "")]) == [(4, 9, 1, 12, 0), (5, 9, 30_001, 12, 0)]
    assert run(spark, [], [(9, item)]) == [] == run(spark, docs, [])
    with pytest.raises(ValueError):
        lk.leaks(*frames(spark, docs, []), least=5)


def test_words_that_repeat(spark):
    text = " ".join(["a b"] * 40)
    assert [r[:2] for r in run(spark, [(1, text)], [(2, text)])] == [(1, 2)]
