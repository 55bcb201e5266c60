import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textloom.operators import ngram, pairs, preprocess, structure
from textloom.session import Stash
from textloom.functions import java_tree, trees


def jaccard(a, b):
    grams = set(a) | set(b)
    low = sum(min(a.count(g), b.count(g)) for g in grams)
    high = sum(max(a.count(g), b.count(g)) for g in grams)
    return np.float32(low) / np.float32(high) if high else np.float32(0)


def oracle(one, two, n, window, threshold):
    """The plain sequential search, with every similarity computed anew."""
    g1, l1 = ngram.grams_of(one, n)
    g2, l2 = ngram.grams_of(two, n)
    used, out, i = set(), [], 0
    while i < len(g2):
        best = (0, np.float32(0), -1)
        for j in range(len(g1)):
            if g1[j] != g2[i] or j in used:
                continue
            length, sim = 1, np.float32(0)
            while j + length < len(g1) and i + length < len(g2):
                length += 1
                if length >= window:
                    s = jaccard(g1[j : j + length], g2[i : i + length])
                    if s < np.float32(threshold):
                        length -= 1
                        break
                    sim = s
            if length >= window and length > best[0]:
                best = (length, sim, j)
        length, sim, j = best
        if length >= window:
            out.append((l1[j], l1[j + length - 1], l2[i], l2[i + length - 1], float(sim)))
            used |= set(range(j, j + length))
            last = l2[i + length - 1]
            while i < len(g2) and l2[i] <= last:
                i += 1
        else:
            i += 1
    return out


def texts(seed, n):
    r = random.Random(seed)
    pool = ["".join(r.choice("ab ") for _ in range(r.randrange(0, 14))) for _ in range(6)]
    return [[(k + 1, r.choice(pool) if r.random() < 0.7 else "".join(r.choice("abc") for _ in range(8))) for k in range(r.randrange(0, 8))] for _ in range(n)]


SETTINGS = [(3, 4, 0.8), (2, 2, 0.5), (4, 6, 0.7), (3, 5, 1.0), (3, 1, 0.8), (2, 1, 0.5), (3, 4, 0.0)]


@pytest.mark.parametrize("n, window, threshold", SETTINGS)
def test_extension_against_the_plain_search(n, window, threshold):
    for seed in range(12):
        a, b = texts(seed, 2)
        numbers = {}
        got = ngram.extend(ngram.Sequence(a, n, numbers, window, threshold), ngram.Sequence(b, n, numbers, window, threshold), window, threshold)
        assert got == oracle(a, b, n, window, threshold)


@pytest.mark.parametrize("n, window, threshold", SETTINGS)
def test_no_match_is_lost_by_keys(spark, n, window, threshold):
    t = texts(99, 14)
    df = spark.createDataFrame([(i, i % 2, f"s{i % 5}", x) for i, x in enumerate(t)], f"id long, grp long, sub string, lines {ngram.LINES}").where("size(lines) > 0")
    got = sorted(tuple(r)[1:3] + tuple(r)[4:] for r in ngram.detect(df, n, window, threshold).collect())
    want = []
    for a, b in itertools.combinations(range(len(t)), 2):
        if a % 2 == b % 2 and a % 5 != b % 5:
            want += [(a, b, *m) for m in oracle(t[a], t[b], n, window, threshold)]
    assert got == sorted(want)


def test_salted_keys_and_small_blocks(spark, monkeypatch):
    """How keys are parted and pairs are dealt to blocks changes no result."""
    t = texts(7, 20)
    df = spark.createDataFrame([(i, i % 2, f"s{i % 5}", x) for i, x in enumerate(t)], f"id long, grp long, sub string, lines {ngram.LINES}").where("size(lines) > 0")
    plain = sorted(map(tuple, ngram.detect(df, 3, 3, 0.7).collect()))
    for name, value in (("PART", 1), ("SAMPLE", 1), ("SIDE", 2)):
        monkeypatch.setattr(pairs, name, value)
    rows = spark.createDataFrame([(i % 3, i, f"s{i % 4}") for i in range(30)], "k long, id long, sub string")
    got = sorted((r["k"], r["id_a"], r["id_b"], r["sub_a"], r["sub_b"]) for r in pairs.keyed_pairs(rows, ["k"], Stash(spark)).collect())
    assert got == sorted((a % 3, a, b, f"s{a % 4}", f"s{b % 4}") for a in range(30) for b in range(a + 1, 30) if a % 3 == b % 3)
    assert sorted(map(tuple, ngram.detect(df, 3, 3, 0.7).collect())) == plain and plain


def test_threshold_at_the_float_boundary():
    assert ngram.needed(10, 0.8) == 9 and np.float32(4) / np.float32(5) >= np.float32(0.8)
    assert ngram.needed(9, 0.8) == 8


def test_small_windows(spark):
    """A window of 1 makes a lone common n-gram a match of similarity 0; one of 0 is the same."""
    schema = f"id long, grp long, sub string, lines {ngram.LINES}"
    assert ngram.detect(spark.createDataFrame([], schema)).count() == 0
    df = spark.createDataFrame([(1, 1, "s", [(1, "abcde")]), (2, 1, "t", [(4, "xabcdy")])], schema)
    assert [tuple(r)[4:] for r in ngram.detect(df, 4, 1).collect()] == [(1, 1, 4, 4, 0.0)] == [tuple(r)[4:] for r in ngram.detect(df, 4, 0).collect()]
    assert ngram.detect(df, 4, 2).count() == 0
    with pytest.raises(ValueError):
        ngram.detect(df, threshold=1.5)


def test_multiset_jaccard(spark):
    df = spark.createDataFrame([(1, ["abcd"], ["abce"]), (2, [], []), (3, ["aaaa"], ["aaa"]), (4, None, ["abc"])], "k long, a array<string>, b array<string>")
    got = {r["k"]: r["similarity"] for r in ngram.multiset_jaccard(df, "a", "b", ["k"], 3).collect()}
    assert got == {1: pytest.approx(1 / 3), 2: 0.0, 3: 0.5, 4: 0.0}


def test_multiset_jaccard_of_files(spark, monkeypatch):
    """The same figures as of rows of n-grams, which are not made: each file's are counted where its pairs are."""
    monkeypatch.setattr(pairs, "SIDE", 3)
    r = random.Random(5)
    lines = [["".join(r.choice("ab \u3000\x1c\t") for _ in range(r.randrange(0, 9))) for _ in range(r.randrange(0, 6))] for _ in range(12)]
    t = spark.createDataFrame(list(enumerate(lines)), "id long, values array<string>")
    p = spark.createDataFrame([(a % 2, a, b) for a, b in itertools.combinations(range(14), 2)], "grp long, a long, b long")
    both = p.join(t.selectExpr("id AS a", "values AS x"), "a").join(t.selectExpr("id AS b", "values AS y"), "b")
    found = ngram.multiset_jaccard_of_files(p, t, 3)
    want = ngram.multiset_jaccard(both, "x", "y", ["a", "b"], 3)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect())) and found.count() == 66
    assert "substring" not in found._jdf.queryExecution().optimizedPlan().toString()


def tree(text):
    names = [f for f, _ in structure._FIELDS]
    return structure.Tree(structure.pack([dict(zip(names, r)) for r in trees.rows(java_tree.tree(text)[0], "java")], True)[0])


METHOD = "int f(int a) {\n for (int i = 0; i < a; i++) {\n  if (a > i) {\n   g(a + i);\n  }\n }\n return a;\n}\n"


def test_equal_trees_are_one_anchor():
    t = tree("class A {\n" + METHOD + "}")
    assert structure.match_trees(t, tree("class B {\n" + METHOD.replace("a", "q") + "}"), 5, 0.8) == [(1, 10, 1, 10, 1.0, t.weight[0], t.weight[0])]


def test_containers_count_only_what_is_their_own():
    one = tree("class A {\n" + METHOD + "int x;\n}")
    two = tree("class A {\n" + METHOD + "int x = 5;\n}")
    found = structure.match_trees(one, two, 5, 0.8)
    anchors, containers = [m for m in found if m[4] == 1.0], [m for m in found if m[4] < 1.0]
    assert len(anchors) == 1 and anchors[0][:4] == (2, 9, 2, 9)
    assert containers and all(m[5] < one.weight[0] and m[4] >= 0.8 for m in containers)
    assert sum(m[5] for m in found[:2]) <= one.weight[0]


def test_different_trees_have_no_match():
    assert structure.match_trees(tree("class A { int x; }"), tree("interface B { void f(); }"), 5, 0.8) == []


def files(spark, data):
    return spark.createDataFrame([(i, 1, s, c, "java") for i, s, c in data], "file_id long, workspace_id long, submission string, content string, lang string")


def test_tree_matches_of_pairs(spark):
    a = "class A {\n" + METHOD + "}"
    f = files(spark, [(1, "s", a), (2, "s", a), (3, "t", a), (4, None, a), (5, "u", "class Z { }")])
    found = structure.tree_matches(structure.parse(f), f)
    assert sorted((r["file1_id"], r["file2_id"]) for r in found.collect()) == [(1, 3), (1, 4), (2, 3), (2, 4), (3, 4)]


def test_variable_matches(spark):
    f = files(spark, [(1, "s", "class A { int x; int x; }"), (2, "s", "class B { int x; }"), (3, "t", "class C { int x; long x; }")])
    d = structure.variables(structure.parse(f), f)
    assert sorted((r["file1_id"], r["file2_id"], r["string"]) for r in structure.variable_matches(d).collect()) == [(1, 3, "intx;")] * 2 + [(2, 3, "intx;")]


@pytest.mark.parametrize("wide, dense", [(1024, 64), (3, 64), (3, 2), (7, 4)])
def test_candidates_are_the_files_that_share_a_key(spark, monkeypatch, wide, dense):
    """However files are dealt to blocks, and also where one key stands in all of them; the keys are never written."""
    monkeypatch.setattr(pairs, "WIDE", wide)
    monkeypatch.setattr(pairs, "DENSE", dense)
    t = texts(3, 24)
    df = spark.createDataFrame([(i, i % 2, f"s{i % 5}", [(0, "abcabcab"), *x] if i % 3 else x) for i, x in enumerate(t)], f"id long, grp long, sub string, lines {ngram.LINES}")
    keys = []
    for i, x in enumerate(t):
        h = ngram.hashed(ngram.grams_of([(0, "abcabcab"), *x] if i % 3 else x, 3)[0], {})
        keys.append({k for part in ngram.part_keys(h, 4, 0.8) for k in part.tolist()})
    want = [(i % 2, i, j) for i, j in itertools.combinations(range(len(t)), 2) if i % 2 == j % 2 and i % 5 != j % 5 and keys[i] & keys[j]]
    monkeypatch.setattr(Stash, "keep", lambda *_: pytest.fail("keys are written"))
    assert sorted(map(tuple, ngram.candidates(df, 3, 4, 0.8).collect())) == sorted(want) and want


def test_lines_of_files_are_those_of_the_token_rows(spark):
    data = [(1, "java", "class A {  int x;\t// one \r\n/* two \r\n\n  three\u2028 */ int y;\r}\n"), (2, "java", ""), (3, "haskell", "module M where\n{- a\n b -}\nf x  =  x -- c\n"), (4, "cobol", "x"), (5, "java", "  // \u0001 a \u2028\n\"open\n'"), (6, None, "x"), (7, "java", None)]
    f = spark.createDataFrame(data, "file_id long, lang string, content string").selectExpr("*", "1L AS workspace_id", "'s' AS submission")
    got = preprocess.file_lines(f, {"id": F.col("file_id")}, "id long")
    want = ngram.by_file(preprocess.lines(f), f)
    assert sorted((r["id"], r["lines"]) for r in got.collect()) == sorted((r["id"], r["lines"]) for r in want.collect()) and got.count() == 3


def test_a_name_that_many_files_declare_is_dealt_to_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(pairs, "PART", 2)
    monkeypatch.setattr(pairs, "SAMPLE", 1)
    rows = [(1, f"s{i % 4}", i, i, "int x;") for i in range(16)] + [(1, "s1", 20, 3, "int y;"), (2, "s1", 21, 3, "int x;")]
    found = structure.variable_matches(spark.createDataFrame(rows, "grp long, sub string, id long, line int, value string"))
    assert sorted((r["file1_id"], r["file2_id"], r["s1"], r["e2"]) for r in found.collect()) == [(a, b, a, b) for a in range(16) for b in range(a + 1, 16) if a % 4 != b % 4]
    assert "_part" in found._jdf.queryExecution().optimizedPlan().toString()


def test_matches_of_all_pairs_are_found_in_blocks(spark, monkeypatch):
    """No row is made of a pair or of a key, and places without a shared key are not looked at; blocks of any size give the same."""
    t = [*texts(21, 22), [(1, "-" * 30), (2, "abcabcab")], [(1, "-" * 40), (3, "abcabcab")]]
    schema = f"id long, grp long, sub string, lines {ngram.LINES}"
    df = spark.createDataFrame([(i, i % 2 if i < 22 else 0, f"s{i % 5}", x) for i, x in enumerate(t)], schema).where("size(lines) > 0")
    held = [(i, i % 2 if i < 22 else 0, x) for i, x in enumerate(t) if x]
    want = [(g, a, b, k, *m) for a, g, x in held for b, h, y in held if a < b and g == h and a % 5 != b % 5 for k, m in enumerate(oracle(x, y, 3, 4, 0.7))]
    for name in ("candidates", "in_blocks", "sharing_pairs"):
        monkeypatch.setattr(ngram, name, lambda *_, name=name: pytest.fail(name))
    for size, batch in ((128, 1 << 16), (3, 2), (1, 1)):
        monkeypatch.setattr(pairs, "BLOCK", size)
        monkeypatch.setattr(pairs, "BATCH", batch)
        found = [(r["grp"], *tuple(r)[1:]) for r in ngram.detect(df, 3, 4, 0.7).collect()]
        assert sorted(found) == sorted(want) and any(m[1:3] == (22, 23) for m in want)


def test_only_places_of_shared_keys_are_starts():
    numbers = {}
    one, two = (ngram.Sequence([(1, x), (2, "the same line here")], 3, numbers, 4, 0.8) for x in ("aaaaaaaaaaaaaaaaaaaa", "bcdefghijklmnopqrstuv"))
    at, keys = ngram.starts(one, two)
    assert at and at == sorted(at) and min(at) >= 19 - 3 and len(at) == len(keys)
    (i, k, at2, _), = ngram.shared_starts([one, two], lambda k: np.ones(k, bool))
    assert (i, k, at2) == (0, 1, at)


def plain_match(one, two, least_height, least_dice):
    """Anchors and containers by looking at every node of both trees."""
    n1, n2 = len(one.kind), len(two.kind)
    partner, taken1, taken2, out = [-1] * n1, [False] * n1, [False] * n2, []
    for i in sorted((i for i in range(n1) if one.height[i] >= least_height), key=lambda i: (-one.height[i], one.rank[i])):
        same = [j for j in sorted(range(n2), key=two.rank.__getitem__) if not taken2[j] and (two.height[j], two.print[j]) == (one.height[i], one.print[i])]
        if taken1[i] or not same:
            continue
        j, w = same[0], one.weight[i]
        out.append((one.start[i], one.end[i], two.start[j], two.end[j], 1.0, w, two.weight[j]))
        for k in range(w):
            partner[i + k], taken1[i + k], taken2[j + k] = j + k, True, True
    above = lambda t, i: [] if t.parent[i] < 0 else [t.parent[i], *above(t, t.parent[i])]
    mass1 = [sum(taken1[i : i + one.weight[i]]) for i in range(n1)]
    mass2 = [sum(taken2[j : j + two.weight[j]]) for j in range(n2)]
    for i in sorted(range(n1), key=one.post.__getitem__):
        if taken1[i] or one.weight[i] == 1 or mass1[i] <= 0:
            continue
        below = [partner[k] for k in range(i, i + one.weight[i]) if partner[k] >= 0]
        best, best_dice = -1, np.float32(0)
        for j in sorted((j for j in range(n2) if not taken2[j] and two.kind[j] == one.kind[i]), key=two.rank.__getitem__):
            dice = np.float32(2 * sum(j <= p < j + two.weight[j] for p in below)) / np.float32(one.weight[i] + two.weight[j])
            if dice > best_dice:
                best, best_dice = j, dice
        if best < 0 or best_dice < np.float32(least_dice):
            continue
        hidden1, hidden2 = mass1[i], mass2[best]
        if one.weight[i] <= hidden1 or two.weight[best] <= hidden2:
            continue
        out.append((one.start[i], one.end[i], two.start[best], two.end[best], float(best_dice), one.weight[i] - hidden1, two.weight[best] - hidden2))
        for p in above(one, i):
            mass1[p] = max(0, mass1[p] - hidden1)
        for p in above(two, best):
            mass2[p] = max(0, mass2[p] - hidden2)
        partner[i : i + one.weight[i]] = [-1] * one.weight[i]
    return out


def random_class(r):
    def body(depth):
        if depth == 0 or r.random() < 0.2:
            return r.choice(["x = x + 1;", "f(x);", "return;", "int y = x * 2;"])
        inner = " ".join(body(depth - 1) for _ in range(r.randrange(1, 4)))
        return r.choice(["if (x > 1) {{ {} }}", "while (f(x)) {{ {} }}", "for (;;) {{ {} }}", "{{ {} }}"]).format(inner)

    return "class A {" + "".join(f"void m{k}(int x) {{ {body(r.randrange(1, 4))} }} " for k in range(r.randrange(1, 5))) + "}"


@pytest.mark.parametrize("height, dice", [(5, 0.8), (3, 0.5), (2, 0.2), (1, 0.0)])
def test_trees_against_the_plain_match(height, dice):
    r = random.Random(height)
    all_ = [tree(random_class(r)) for _ in range(12)]
    found = [structure.match_trees(a, b, height, dice) for a, b in itertools.permutations(all_, 2)]
    assert found == [plain_match(a, b, height, dice) for a, b in itertools.permutations(all_, 2)]
    assert any(m[4] == 1.0 for f in found for m in f) and (height > 3 or any(m[4] < 1.0 for f in found for m in f))


def test_tree_matches_make_no_rows_of_pairs(spark, monkeypatch):
    r = random.Random(2)
    source = [random_class(r) for _ in range(14)]
    f = files(spark, [(i, f"s{i % 4}", c) for i, c in enumerate(source)])
    built = [tree(c) for c in source]
    want = [(i, j, *m) for i, j in itertools.combinations(range(14), 2) if i % 4 != j % 4 for m in structure.match_trees(built[i], built[j], 3, 0.5)]
    monkeypatch.setattr(structure, "keyed_pairs", lambda *_: pytest.fail("pairs are rows"))
    for size in (128, 3):
        monkeypatch.setattr(pairs, "BLOCK", size)
        found = structure.tree_matches(structure.parse(f), f, 3, 0.5)
        assert sorted((*tuple(x)[1:3], *tuple(x)[4:]) for x in found.collect()) == sorted(want) and want


@pytest.mark.parametrize("abstract", [True, False])
def test_trees_packed_by_column_are_those_packed_by_node(abstract):
    r, names = random.Random(8), [f for f, _ in structure._FIELDS]
    built = [[dict(zip(names, x)) for x in trees.rows(java_tree.tree(text)[0], "java")] for text in (*(random_class(r) for _ in range(4)), "", "class {", "class B { String s = \"é\"; }")]
    want = [structure.pack(x, abstract)[0] for x in built]
    assert structure.pack_all(pa.array([*built, None, []], structure._NODES), abstract) == [*want, None, b""]
    assert structure.pack_all(pa.array(built, structure._NODES)[2:5], abstract) == want[2:5]
    assert structure.pack_all(pa.array([], structure._NODES), abstract) == []


def test_a_task_holds_the_nodes_of_few_files(spark, monkeypatch):
    monkeypatch.setattr(structure, "HELD", 3)
    r = random.Random(4)
    f = files(spark, [(i, f"s{i % 3}", random_class(r)) for i in range(10)])
    batch = pa.RecordBatch.from_pydict({"id": list(range(10)), "lang": ["java"] * 10, "text": [random_class(r) for _ in range(10)]})
    assert [len(b) for b in structure._builder(True, True)(iter([batch]))] == [3, 3, 3, 1] == [len(b) for b in structure._builder(True, None)(iter([batch]))]
    two = (structure.tree_matches(x, f, 3, 0.5).collect() for x in (structure.parse(f), structure.parse_packed(f)))
    assert sorted(map(tuple, next(two))) == sorted(map(tuple, next(two)))


@pytest.mark.parametrize("height, dice", [(5, 0.8), (3, 0.5), (1, 0.0)])
def test_trees_are_sent_without_what_no_match_needs(height, dice):
    r = random.Random(height + 20)
    texts = [*(random_class(r) for _ in range(12)), "", "class {"]
    rows = [trees.rows(java_tree.tree(x)[0], "java") for x in texts]
    whole, made = [tree(x) for x in texts], [structure.slim(x, True, height) for x in rows]
    few = [structure.Tree.read(x) for x in made]
    for a, b in zip(whole, few):
        kept = [i for i, h in enumerate(a.height) if h >= height]
        assert [[getattr(a, c)[i] for i in kept] for c in ("kind", "start", "end", "weight", "height", "print")] == [getattr(b, c) for c in ("kind", "start", "end", "weight", "height", "print")]
        for order in ("rank", "post"):
            assert sorted(range(len(kept)), key=[getattr(a, order)[i] for i in kept].__getitem__) == sorted(range(len(kept)), key=getattr(b, order).__getitem__)
    assert [structure.match_trees(*x, height, dice) for x in itertools.permutations(few, 2)] == [structure.match_trees(*x, height, dice) for x in itertools.permutations(whole, 2)]
    assert sum(map(len, made)) * 4 < sum(9 * 8 * len(x) for x in rows)


def test_large_groups_of_trees_are_sent_to_few_blocks(spark, monkeypatch):
    monkeypatch.setattr(pairs, "BLOCK", 2)
    seen = spark.createDataFrame([(i, 1, str(i), b"") for i in range(40)], "id long, grp long, sub string, tree binary")
    blocks = lambda *most: pairs.within_groups(seen, "tree", lambda x, _: x, lambda held, partners: [(0, 0, [(len(held),)])], "grp long, a long, b long, n int", [pa.int64()] * 3 + [pa.int32()], *most).collect()
    assert sum(x["n"] for x in blocks(100)) == 40 * 4 < sum(x["n"] for x in blocks(5)) < sum(x["n"] for x in blocks())
