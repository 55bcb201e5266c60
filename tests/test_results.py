import json

import pytest
from pyspark.sql import functions as F

from textloom.operators import grouping, pairs, scoring, skeleton
from textloom.plans import job, report
from textloom.plans.registry import ParamSpec, Registry, Template

A, B = (10, 15, 13, 20), (16, 20, 21, 25)
# Matches, given code (file 1; file 2), what remains, and the given code within it.
SCENARIOS = [
    ([((1, 1), (1, 1))], [A, B], []),
    ([((1, 30), (1, 30))], [], []),
    ([((10, 15), (13, 20))], [B], []),
    ([((10, 15), (1, 1))], [B], []),
    ([((10, 15), (21, 25))], [], []),
    ([((8, 12), (1, 1))], [(13, 15, 13, 20), B], []),
    ([((8, 12), (11, 15))], [(13, 15, 16, 20), B], []),
    ([((18, 21), (1, 1))], [A, (16, 17, 21, 25)], []),
    ([((18, 21), (23, 26))], [A, (16, 17, 21, 22)], []),
    ([((11, 12), (1, 1))], [A, B], [(A, 1, (11, 12))]),
    ([((11, 12), (15, 17))], [A, B], [(A, 1, (11, 12)), (A, 2, (15, 17))]),
    ([((11, 12), (1, 1)), ((14, 15), (1, 1))], [(10, 13, 13, 20), B], [((10, 13, 13, 20), 1, (11, 12))]),
    ([((11, 12), (1, 1)), ((10, 10), (1, 1))], [(13, 15, 13, 20), B], []),
    ([((11, 12), (1, 1)), ((12, 14), (11, 11))], [A, B], [(A, 1, (11, 14))]),
    ([((11, 12), (1, 1)), ((12, 14), (11, 11)), ((10, 10), (1, 1))], [(15, 15, 13, 20), B], []),
    ([((12, 14), (1, 1)), ((11, 12), (11, 11)), ((10, 10), (1, 1))], [(15, 15, 13, 20), B], []),
]


def matches(spark, rows):
    return spark.createDataFrame(rows, "file1_id long, file2_id long, s1 int, e1 int, s2 int, e2 int, similarity float")


@pytest.mark.parametrize("removals, remain, inside", SCENARIOS)
def test_skeleton_scenarios(spark, removals, remain, inside):
    rows = [(1, 2, *m, 0.5) for m in (A, B)]
    given = [(f, 9, *r, 1, 1, 1.0) for one, two in removals for f, r in ((1, one), (2, two))]
    out = skeleton.without_skeleton(matches(spark, rows + given), spark.createDataFrame([(9,)], "file long")).collect()
    assert sorted((r["s1"], r["e1"], r["s2"], r["e2"]) for r in out) == sorted(remain)
    found = [((r["s1"], r["e1"], r["s2"], r["e2"]), k, tuple(x)) for r in out for k in (1, 2) for x in r[f"inside{k}"]]
    assert sorted(found) == sorted(inside)


def test_skeleton_keys_and_no_skeleton(spark):
    m = matches(spark, [(1, 2, *A, 0.5), (9, 1, 1, 1, 10, 12, 1.0)]).withColumn("detector", F.lit("x")).unionByName(matches(spark, [(1, 2, *A, 0.5)]).withColumn("detector", F.lit("y")))
    out = skeleton.without_skeleton(m, spark.createDataFrame([(9,)], "file long"), ["detector"])
    assert sorted((r["detector"], r["s1"]) for r in out.collect()) == [("x", 13), ("y", 10)]
    assert skeleton.without_skeleton(m, spark.createDataFrame([], "file long")).count() == 3


def test_linked_matches(spark):
    rows = [(1, 2, 1, 5, 1, 5, 0.5), (2, 3, 1, 5, 7, 9, 1.0), (4, 5, 1, 2, 1, 2, 0.25), (4, 5, 3, 4, 3, 4, float("nan")), (4, 5, 3, 4, 3, 4, None)]
    m = matches(spark, rows).withColumn("grp", F.lit(1).cast("long"))
    got = sorted((r["file_id"], r["score"], tuple(r["ranges"][0])) for r in grouping.linked_matches(m).collect())
    assert got == [(1, 0.5, (1, 5)), (2, 0.75, (1, 5)), (3, 1.0, (7, 9)), (4, 0.25, (1, 2)), (5, 0.25, (1, 2))]
    n = spark.createDataFrame([(1, 5)], "grp long, n_files long")
    assert {r["file_id"] for r in grouping.linked_matches(m, n, 0.5).collect()} == {4, 5}
    assert grouping.linked_matches(m.limit(0)).count() == 0


def linked_by_hand(rows):
    """Connected sets of matches, of which the first file that two have decides whether they are linked: [(file, range)...] of each."""
    rows = [r if r[0] < r[1] else (r[1], r[0], r[4], r[5], r[2], r[3], r[6]) for r in rows]

    def linked(x, y):
        for i in (0, 1):
            for j in (0, 1):
                if x[i] == y[j]:
                    return x[2 + 2 * i : 4 + 2 * i] == y[2 + 2 * j : 4 + 2 * j]
        return False

    sets = []
    for r in rows:
        hit = [s for s in sets if any(linked(r, x) for x in s)]
        sets = [s for s in sets if s not in hit] + [[r] + [x for s in hit for x in s]]
    return sorted(sorted({f: min((x[2 + 2 * i], x[3 + 2 * i]) for x in s for i in (0, 1) if x[i] == f) for f in {x[i] for x in s for i in (0, 1)}}.items()) for s in sets)


def groups_of(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["group_id"], []).append((r["file_id"], tuple(r["ranges"][0])))
    return sorted(map(sorted, out.values()))


def test_the_first_shared_file_decides(spark):
    """Matches of the same two files that only have a range of the second in common are no group, unless a third file links them."""
    rows = [(1, 2, 1, 5, 1, 5, 0.5), (1, 2, 20, 25, 1, 5, 0.5)]
    link = lambda x: groups_of(grouping.linked_matches(matches(spark, x).withColumn("grp", F.lit(1).cast("long"))))
    assert link(rows) == [[(1, (1, 5)), (2, (1, 5))], [(1, (20, 25)), (2, (1, 5))]] == linked_by_hand(rows)
    same_first = [(1, 2, 1, 5, 1, 5, 0.5), (1, 2, 1, 5, 30, 35, 0.5)]
    assert link(same_first) == [[(1, (1, 5)), (2, (1, 5))]] == linked_by_hand(same_first)
    third = rows + [(2, 3, 1, 5, 7, 9, 0.5)]
    assert link(third) == [[(1, (1, 5)), (2, (1, 5)), (3, (7, 9))]] == linked_by_hand(third)


def test_linked_matches_against_the_predicate(spark):
    import random

    r = random.Random(8)
    for _ in range(3):
        rows = []
        for _ in range(60):
            a, b = r.sample(range(9), 2)
            s, t = r.randrange(3), r.randrange(3)
            rows.append((a, b, s, s + 1, t, t + 1, 0.5))
        rows = list(dict.fromkeys(rows))
        assert groups_of(grouping.linked_matches(matches(spark, rows).withColumn("grp", F.lit(1).cast("long")))) == linked_by_hand(rows)


def test_variable_groups(spark):
    d = spark.createDataFrame([(1, "s", 1, 3, "intx"), (1, "s", 1, 3, "intx"), (1, "s", 2, 4, "intx"), (1, "t", 3, 5, "intx"), (1, "s", 1, 9, "own"), (1, "s", 2, 9, "own")], "grp long, sub string, id long, line int, value string")
    b = grouping.variable_groups(d)
    assert sorted((r["file_id"], len(r["ranges"]), r["comment"]) for r in b.collect()) == [(1, 1, "Variable: intx"), (2, 1, "Variable: intx"), (3, 1, "Variable: intx")]
    assert {(r["file_id"], r["total"]) for r in grouping.variable_totals(d).collect()} == {(1, 3), (2, 2), (3, 1)}


def blocks(spark, rows):
    return spark.createDataFrame([(g, d, 1, f, s, r, w) for g, d, f, s, r, w in rows], "group_id long, detector string, grp long, file_id long, score float, ranges array<struct<start_line:int,end_line:int>>, weight int")


def test_scores(spark):
    b = blocks(
        spark,
        [(1, "n", 1, 1.0, [(1, 10)], None), (1, "n", 2, 1.0, [(1, 10)], None), (2, "n", 1, 1.0, [(1, 10), (11, 15)], None), (2, "n", 3, 0.5, [(1, 5)], None), (3, "t", 1, 0.8, [(1, 2)], 30), (3, "t", 2, 0.8, [(1, 2)], 10), (4, "t", 1, 1.0, [(1, 1)], 50), (4, "t", 2, float("nan"), [(1, 1)], 5)],
    )
    files = spark.createDataFrame([(1, 20), (2, 40), (3, 10), (4, 0)], "file_id long, line_count int")
    totals = spark.createDataFrame([("t", 1, 60), ("t", 2, 20)], "detector string, file_id long, total int")
    s = {(r["group_id"], r["file_id"]): round(r["score"], 6) for r in scoring.group_scores(b, files, totals).collect()}
    # file 1 has 25 lines in blocks and 20 altogether
    assert s == {(1, 1): 0.4, (1, 2): 0.25, (2, 1): 0.6, (2, 3): 0.25, (3, 1): 0.4, (3, 2): 0.4, (4, 1): 0.833333, (4, 2): 0.0}
    p = {(r["detector"], r["file_id"], r["other_file_id"]): round(r["score"], 5) for r in scoring.pair_scores(scoring.group_scores(b, files, totals)).collect()}
    assert p["t", 1, 2] == 1.0 and p[None, 1, 2] == 1.0 and p["n", 1, 2] == 0.4 and p[None, 2, 1] == 0.65 and p["n", 3, 1] == 0.25
    o = {(r["detector"], r["file_id"]): round(r["score"], 5) for r in scoring.file_overall(scoring.pair_scores(scoring.group_scores(b, files, totals)), files).collect()}
    assert o[None, 4] == 0.0 and o[None, 1] == 1.0


def test_groups(spark):
    b = blocks(spark, [(1, "n", 1, 1.0, [(1, 2)], None), (1, "n", 2, 0.5, [(3, 4)], None), (2, "n", 1, 1.0, [(1, 2)], None), (1, "n", 1, 0.0, [(1, 2)], None)])
    assert {r["group_id"] for r in grouping.populated(b).collect()} == {1}
    assert [r["group_id"] for r in grouping.groups_of_file(b, 1, 2).collect()] == [1]
    one = {(r["group_id"], r["file_id"]): (r["score"], len(r["ranges"])) for r in grouping.append_block(b, ["group_id", "file_id"]).collect()}
    assert one[1, 1] == (0.5, 1)


def test_pairs(spark):
    f = spark.createDataFrame([(1, 1, "s", "A", "java"), (1, 1, "s", "A", "java"), (2, 1, "s", "A", "java"), (3, 1, "t", "A", "java"), (4, 1, None, "B", None), (5, 2, "t", "A", "java"), (6, None, "t", "A", "java"), (None, 1, "t", "A", "java")], "file_id long, workspace_id long, submission string, filename string, extension string")
    assert sorted((r["file1_id"], r["file2_id"]) for r in pairs.file_pairs(f).collect()) == [(1, 3), (1, 4), (2, 3), (2, 4), (3, 4)]
    assert sorted((r["file1_id"], r["file2_id"]) for r in pairs.file_pairs(f, same_name=True).collect()) == [(1, 3), (2, 3)]
    assert sorted(tuple(r) for r in pairs.pair_counts(f).collect()) == [(1, 4, 5), (2, 1, 0)]


def test_coverage(spark):
    s = spark.createDataFrame([(1, 1, 1, 5), (1, 2, 3, 6), (1, 3, 3, 4), (1, 4, 9, 8)], "file_id long, match long, start int, end int")
    got = [(r["line"], r["visible"], r["active"]) for r in report.line_coverage(s, ["file_id"]).orderBy("line").collect()]
    assert got == [(1, 1, 1), (2, 1, 1), (3, 3, 3), (4, 3, 3), (5, 2, 2), (6, 2, 1)]
    cut = spark.createDataFrame([(1, 1, 10, [(3, 4), (8, 8)]), (2, 1, 3, None)], "match long, start int, end int, inside array<struct<start:int,end:int>>")
    assert sorted(tuple(r) for r in report.without_inside(cut, "inside").collect()) == [(1, 1, 2), (1, 5, 7), (1, 9, 10), (2, 1, 3)]


def test_line_json_has_all_matches(spark):
    s = spark.createDataFrame([(1, 1, 1, 3), (1, 2, 2, 4), (1, 3, 2, 3), (1, 4, 9, 8), (2, 5, 1, 1)], "file_id long, match long, start int, end int")
    got = {r["file_id"]: json.loads(r["json"]) for r in report.line_json(report.line_coverage(s, ["file_id"]), ["file_id"]).collect()}
    assert got[1] == {"visible": {"1": 1, "2": 3, "3": 3, "4": 2}, "all": {"1": [1], "2": [1, 3, 2], "3": [1, 3, 2], "4": [2]}}
    assert got[2] == {"visible": {"1": 5}, "all": {"1": [5]}}


def test_report_details(spark):
    assert report.html_report([{"file_id": "<x>", "start_line": 3, "end_line": 3, "first_line": 2, "lines": ["a", "b & c"]}]).count("&amp;") == 1
    df = spark.createDataFrame([(0.799,), (0.8,)], "s double").select(report.at_least(F.col("s"), 80).alias("y"))
    assert [r["y"] for r in df.collect()] == [False, True]
    m = report.numbered(spark.createDataFrame([(1, i) for i in range(50)], "w long, x long"), ["w"], ["x"]).orderBy("x").collect()
    assert m[46]["match_id"] == 46 and m[46]["hue"] == 8


def test_parameters_and_templates():
    p = ParamSpec("t", "T", 0.8, 0, 1, 0.05)
    assert p.valid(0.85) and not p.valid(0.86) and not p.valid(2) and p.rounded(0.86) == 0.85 and p.rounded(9) == 1 and p.pick(None) == 0.8 and p.pick(7) == 0.8
    n = ParamSpec("n", "N-Gram Size", 8, 1, 10, 1, True)
    assert n.pick(3.5) == 8 and n.pick(3) == 3
    assert job.NGRAM.params[0].display == "N-Gram Size"
    assert job.REGISTRY.languages() == {"java", "haskell"} and job.REGISTRY.for_language("Java") == ["NGramDetector", "VariableNameDetector", "ASTDetector"]
    assert job.REGISTRY.maker("tree", "JAVA") is not None and Registry().languages() == set()
    with pytest.raises(ValueError):
        job.REGISTRY.detector(job.NGRAM)
    t = Template("a", "java", "me")
    t.set(job.REGISTRY, "NGramDetector", "threshold", 0.70049)
    assert t.detectors == {"NGramDetector": {"threshold": 0.7}} and t.visible_to("me") and not t.visible_to("you")
    with pytest.raises(ValueError):
        t.set(job.REGISTRY, "NGramDetector", "threshold", 0.5, has_run=True)
    c = t.copy("b", "you")
    c.set(job.REGISTRY, "NGramDetector", "common_threshold", 0.5, has_run=True)
    assert "common_threshold" not in t.detectors["NGramDetector"]


SHARED = "  int total(int a) {\n    int sum = 0;\n    for (int i = 0; i < a; i++) {\n      if (i % 2 == 0) {\n        sum += i * a;\n      }\n    }\n    return sum;\n  }\n"


def job_files(spark):
    given = "  void given(String text) {\n    while (text.length() > 3) {\n      System.out.println(text.substring(1, 2));\n    }\n  }\n"
    return spark.createDataFrame(
        [
            (1, 1, skeleton.SKELETON, "Given", "java", "class Given {\n" + given + "}\n"),
            (2, 1, "s1", "A", "java", "class A {\n" + given + SHARED + "}\n"),
            (3, 1, "s2", "B", "java", "class B {\n" + SHARED + given + "}\n"),
            (4, 1, "s3", "C", "java", "interface C {\n  long other(double q);\n}\n"),
            (5, 1, "s1", "A2", "java", "class A {\n" + SHARED + "}\n"),
            (6, 2, "s1", "A", "java", "class A {\n" + SHARED + "}\n"),
            (7, 3, "s1", "A", "java", "class A {\n" + SHARED + "}\n"),
        ],
        "file_id long, workspace_id long, submission string, filename string, extension string, content string",
    )


def test_job(spark):
    spaces = spark.createDataFrame([(1, "Java "), (2, "java"), (3, None)], "workspace_id long, lang string")
    r = job.run_job(job_files(spark), spaces)
    m = r.matches.collect()
    assert {(x["file1_id"], x["file2_id"]) for x in m} >= {(2, 3), (3, 5)} and all(x["file1_id"] != 1 and x["grp"] == 1 for x in m)
    assert {(2, 5), (6, 7)}.isdisjoint({(x["file1_id"], x["file2_id"]) for x in m})
    s = {(x["file_id"], x["other_file_id"]): x["score"] for x in r.file_scores.where("detector IS NULL").collect()}
    assert s[5, 3] > 0.9 and 0.3 < s[2, 3] <= 1.0 and (4, 2) not in s
    o = {x["file_id"]: x["score"] for x in r.file_overall.where("detector IS NULL").collect()}
    assert o[4] == 0.0 and 1 not in o
    with pytest.raises(ValueError):
        job.run_job(job_files(spark), spaces, job.JobConfig({}))
    with pytest.raises(KeyError):
        job.run_job(job_files(spark), spaces, job.JobConfig({"x": {}}))


def test_job_by_file_name_and_without_files(spark):
    spaces = spark.createDataFrame([(1, "java")], "workspace_id long, lang string")
    config = job.JobConfig({"ASTDetector": {"matchByFilename": 1}})
    assert job.run_job(job_files(spark), spaces, config).matches.count() == 0
    assert job.run_job(job_files(spark).limit(0), spaces).file_scores.count() == 0
