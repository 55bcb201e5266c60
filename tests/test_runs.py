"""Stored runs, plug-ins, and names as keys of detection."""

import os

import pytest
from pyspark.sql import functions as F

from textloom.operators import grouping, pairs, scoring, skeleton, structure
from textloom.plans import job, runs
from textloom.plans.registry import DetectorSpec, Registry
from textloom.session import Stash
from tests.test_results import job_files


def spaces(spark):
    return spark.createDataFrame([(1, "java")], "workspace_id long, lang string")


TREES = job.JobConfig({"ASTDetector": {}})


def test_submit_store_and_rerun(spark, tmp_path):
    r = runs.Runs(spark, str(tmp_path))
    assert r.states().count() == 0
    key = r.submit("a", job_files(spark), spaces(spark), TREES)
    assert r.submit("a", job_files(spark), spaces(spark), TREES) == key != runs.key_of("b", TREES)
    assert r.wait(key) == runs.COMPLETE and r.progress(key)[0] > 0
    stored = r.result(key)
    fresh = job.run_job(job_files(spark), spaces(spark), TREES)
    assert sorted(map(tuple, stored.file_overall.collect()), key=str) == sorted(map(tuple, fresh.file_overall.collect()), key=str)
    assert r.result(key) is stored
    # stored results do for a new driver, and a rerun replaces them
    other = runs.Runs(spark, str(tmp_path))
    assert other.submit("a", job_files(spark), spaces(spark), TREES) == key and key not in other.waiting
    assert other.rerun("a", job_files(spark).where("file_id <> 2"), spaces(spark), TREES) == key and other.wait(key) == runs.COMPLETE
    assert other.result(key).files.where("file_id = 2").count() == 0


def test_recovery(spark, tmp_path):
    r = runs.Runs(spark, str(tmp_path))
    r._note("left", runs.ACTIVE)
    key = r.submit("a", job_files(spark), spaces(spark), TREES)
    r.wait(key)
    r.recover(job_files(spark))
    assert {x["key"]: x["state"] for x in r.states().collect()} == {"left": runs.INTERRUPTED, key: runs.COMPLETE}
    r.recover(job_files(spark).where("file_id <> 3"))
    assert r.state(key) == runs.MISSING_FILES
    with pytest.raises(KeyError):
        runs.Runs(spark, str(tmp_path)).result(key)


def test_failures_cancelling_and_too_few_submissions(spark, tmp_path):
    registry = Registry()

    def slow(ctx, params):
        def wait(batches):
            import time

            for b in batches:
                time.sleep(60)
                yield b

        df = ctx.files.select(F.col("file_id").alias("file1_id")).repartition(2).mapInPandas(wait, "file1_id long")
        return ctx.stash.keep(df)

    registry.detector(DetectorSpec("slow", "Slow", (), ("java",), slow, lambda ctx, m, p: m))
    registry.detector(DetectorSpec("broken", "Broken", (), ("java",), lambda ctx, p: 1 / 0, lambda ctx, m, p: m))
    r = runs.Runs(spark, str(tmp_path), registry)
    active = r.submit("a", job_files(spark), spaces(spark), job.JobConfig({"slow": {}}))
    queued = r.submit("b", job_files(spark), spaces(spark), job.JobConfig({"broken": {}}))
    later = r.submit("c", job_files(spark), spaces(spark), job.JobConfig({"broken": {}}))
    r.cancel(later)
    while r.progress(active)[1] == 0 or r.state(active) != runs.ACTIVE:
        pass
    import time

    time.sleep(3)
    r.cancel(active)
    assert r.wait(active, 50) == runs.CANCELLED and r.wait(queued, 50) == runs.FAILED and r.state(later) == runs.CANCELLED
    with pytest.raises(ValueError):
        r.submit("d", job_files(spark).where("submission = 's2'"), spaces(spark), TREES)


def test_artifacts_and_own_detectors(spark):
    """A maker and a detector of a user's own, which a job calls: files that declare the same classes."""
    import re

    registry = Registry()
    registry.artifact("classes", "Java", lambda text: re.findall(r"\bclass (\w+)", text))

    def run(ctx, params):
        made = ctx.artifact("classes").join(ctx.files.select("file_id", F.col("workspace_id").alias("grp"), "submission"), "file_id")
        a, b = (made.select("grp", "value", F.col("file_id").alias(f"file{k}_id"), F.col("submission").alias(f"sub{k}")) for k in (1, 2))
        m = a.join(b, ["grp", "value"]).where("file1_id < file2_id AND sub1 <> sub2")
        return m.select("grp", "file1_id", "file2_id", F.col("value").alias("string"), *[F.lit(1).alias(c) for c in ("s1", "e1", "s2", "e2", "match_ix", "weight1", "weight2")], F.lit(1.0).alias("similarity"))

    registry.detector(DetectorSpec("classes", "Classes", (), ("java",), run, lambda ctx, m, p: grouping.tree_groups(m)))
    files = job_files(spark).withColumn("content", F.when(F.col("file_id") == 3, F.lit("class A { }")).otherwise(F.col("content")))
    r = job.run_job(files, spaces(spark), job.JobConfig({"classes": {}}), registry)
    assert {(m["file1_id"], m["file2_id"], m["string"]) for m in r.matches.collect()} == {(2, 3, "A"), (3, 5, "A")}
    assert structure.artifacts(files.withColumn("lang", F.lit("java")), {"java": lambda t: 1 / 0}).count() == 0


def declared_by_pairs(ctx):
    """The groups of variables by way of all pairs and the subtraction of given code from them."""
    own = skeleton.without_skeleton(structure.variable_matches(ctx.declared), ctx.skeleton_files)
    sides = own.selectExpr("grp", "file1_id AS id", "s1 AS line", "string AS value").unionByName(own.selectExpr("grp", "file2_id AS id", "s2 AS line", "string AS value")).distinct()
    return grouping.variable_groups(sides.join(ctx.declared.select("id", "sub").distinct(), "id"))


def test_variables_without_pairs(spark):
    rows = sorted
    files = job_files(spark).unionByName(job_files(spark).where("file_id IN (2, 3)").withColumn("file_id", F.col("file_id") + 20).withColumn("submission", F.lit(None).cast("string")))
    ctx = job.Context(files, spaces(spark))
    plain = {"matchByFilename": 0}
    got, want = job._variable_blocks(ctx, plain), declared_by_pairs(ctx)
    assert rows(map(str, got.collect())) == rows(map(str, want.select(*got.columns).collect())) and got.count() > 0
    named = {"matchByFilename": 1}
    assert {r["file_id"] for r in job._variable_blocks(ctx, named).collect()} == {2, 3, 22, 23}


def test_names_are_keys_of_detection(spark):
    files = job_files(spark).withColumn("filename", F.when(F.col("file_id").isin(3, 5), F.lit("same")).otherwise(F.col("filename")))
    for detector in ("ASTDetector", "NGramDetector"):
        r = job.run_job(files, spaces(spark), job.JobConfig({detector: {"matchByFilename": 1}}))
        assert {(m["grp"], m["file1_id"], m["file2_id"]) for m in r.matches.collect()} == {(1, 3, 5)}


def test_a_job_makes_each_table_once(spark):
    """Matches of which given code is taken out aren't kept beside those before, and what is read twice is stored."""
    r = job.run_job(job_files(spark), spaces(spark))
    at = os.path.dirname(r.matches._stash_path)
    kept = [spark.read.parquet(f"{at}/{x}").columns for x in os.listdir(at.removeprefix("file:"))]
    assert sum("match_ix" in c for c in kept) == 1 and sum("weight" in c for c in kept) == 1
    stash = Stash(spark)
    m = spark.createDataFrame([(1, 1, 2, 1, 2, 3, 4, 0.5), (1, 1, 3, 1, 2, 5, 6, 1.0), (1, 4, 5, 1, 1, 1, 1, 1.0)], "grp long, file1_id long, file2_id long, s1 int, e1 int, s2 int, e2 int, similarity float")
    once, twice = grouping.linked_matches(m, stash=stash), grouping.linked_matches(m)
    assert sorted(map(tuple, once.collect()), key=str) == sorted(map(tuple, twice.collect()), key=str) and once.count() == 5
    assert "avg(" not in once._jdf.queryExecution().optimizedPlan().toString()


def test_scores_of_pairs_are_paired_once(spark):
    s = spark.createDataFrame([("a", 1, 1, 0.5), ("a", 1, 2, 0.25), ("b", 2, 1, 0.75), ("b", 2, 3, 0.5)], "detector string, group_id long, file_id long, score double")
    once = scoring.pair_scores(s, Stash(spark))
    assert sorted(map(tuple, once.collect()), key=str) == sorted(map(tuple, scoring.pair_scores(s).collect()), key=str) and once.count() == 8
    assert "Join" not in once._jdf.queryExecution().optimizedPlan().toString()


def test_scores_without_stored_matches_are_those_of_matches(spark, monkeypatch):
    """With given code, files of the same name and submission, and groups that are dealt to many blocks."""
    files = job_files(spark).unionByName(job_files(spark).where("file_id > 1").withColumn("file_id", F.col("file_id") + 20).withColumn("submission", F.when(F.col("file_id") % 2 == 0, F.lit("s9"))))
    files = files.withColumn("filename", F.when(F.col("file_id").isin(3, 5, 22, 23), F.lit("same")).otherwise(F.col("filename")))
    rows = lambda df: sorted(((*r[:-1], round(r[-1], 5)) for r in df.select("detector", *[c for c in ("file_id", "other_file_id") if c in df.columns], "score").collect()), key=str)
    low = {"ngram_size": 4, "minimum_window": 4, "threshold": 0.5}
    for size, config in ((128, job.JobConfig()), (2, job.JobConfig({"ASTDetector": {"MIN_HEIGHT": 2, "MIN_DICE": 0.3}, "NGramDetector": low})), (2, job.JobConfig({"ASTDetector": {"matchByFilename": 1, "MIN_HEIGHT": 3}, "VariableNameDetector": {}}))):
        monkeypatch.setattr(pairs, "BLOCK", size)
        by_blocks, of_matches = job.run_job(files, spaces(spark), config), job.run_job(files, spaces(spark), config)
        assert of_matches.matches.count() > 0
        overall, scores = rows(by_blocks.file_overall), rows(by_blocks.file_scores)
        assert scores == rows(of_matches.file_scores) and overall == rows(of_matches.file_overall) and scores
        at = by_blocks.ctx.stash.root.removeprefix("file:")
        kept = [spark.read.parquet(f"{by_blocks.ctx.stash.root}/{x}").columns for x in os.listdir(at)]
        assert not any("nodes" in c or "match_ix" in c for c in kept) and sum("content" in c for c in kept) == 1
