import gzip
import io
import tarfile
import zipfile

import pytest

from textloom.operators import hierarchy
from textloom.sources import archives, store
from textloom.streaming import ingest


def zipped(entries):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in entries.items():
            z.writestr(name, text)
    return out.getvalue()


def tarred(entries):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as t:
        for name, text in entries.items():
            info = tarfile.TarInfo(name)
            info.size = len(text)
            t.addfile(info, io.BytesIO(text.encode()))
    return out.getvalue()


ENTRIES = {"one/src/A.java": "class A {\n}\n", "two/B.hs": "b = 1", "C.java": ""}


def unpacked(spark, uploads, mode="archive"):
    df = spark.createDataFrame(uploads, "path string, content binary")
    return sorted((r["submission"], "/".join(r["dirs"]), r["filename"], r["extension"]) for r in archives.unpack(df, mode).where("problem IS NULL").collect())


def test_archives(spark):
    want = [("work", "", "C", "java"), ("work", "one/src", "A", "java"), ("work", "two", "B", "hs")]
    assert unpacked(spark, [("file:/x/work.zip", zipped(ENTRIES))]) == want
    assert unpacked(spark, [("file:/x/work.tar", tarred(ENTRIES))]) == want
    assert unpacked(spark, [("file:/x/work.tar.gz", gzip.compress(tarred(ENTRIES)))]) == want
    assert unpacked(spark, [("file:/x/work.tgz", gzip.compress(tarred(ENTRIES)))]) == want
    assert unpacked(spark, [("file:/x/A.java.gz", gzip.compress(b"class A {}"))]) == [("A.java", "", "A", "java")]
    assert unpacked(spark, [("file:/x/A.java", b"class A {}")]) == [("A", "", "A", "java")]


def test_modes(spark):
    z = [("file:/x/work.zip", zipped(ENTRIES))]
    assert unpacked(spark, z, "many") == [("one", "src", "A", "java"), ("two", "", "B", "hs")]
    assert unpacked(spark, z, "folder") == [("C", "", "C", "java"), ("one", "src", "A", "java"), ("two", "", "B", "hs")]
    assert {x[0] for x in unpacked(spark, z, "skeleton")} == {"SKELETON CODE"}
    packed = [("file:/x/all.zip", zipped({f"top/{k}": v for k, v in ENTRIES.items()}))]
    assert unpacked(spark, packed, "folder") == [("C", "", "C", "java"), ("one", "src", "A", "java"), ("two", "", "B", "hs")]
    with pytest.raises(ValueError):
        unpacked(spark, z, "x")


def test_damage_and_paths_that_leave(spark):
    df = spark.createDataFrame([("file:/x/bad.zip", b"no zip"), ("file:/x/out.zip", zipped({"../../etc/A.java": "x"}))], "path string, content binary")
    got = {r["filename"]: (r["problem"] is None, r["dirs"]) for r in archives.unpack(df).collect()}
    assert got == {"bad.zip": (False, None), "A": (True, ["etc"])}


def test_folders_and_lines(spark, tmp_path):
    (tmp_path / "s1" / "deep").mkdir(parents=True)
    (tmp_path / "s1" / "deep" / "A.java").write_bytes(b"a\n\n b\n")
    (tmp_path / "B.java").write_bytes(b"\xff")
    got = {r["filename"]: r for r in archives.read_uploads(spark, str(tmp_path), "folder").collect()}
    assert (got["A"]["submission"], got["A"]["dirs"], got["A"]["line_count"], got["A"]["nonempty_line_count"], got["A"]["size"]) == ("s1", ["deep"], 3, 2, 6)
    assert got["B"]["submission"] == "B" and got["B"]["content"] == "�"


def files(spark, data):
    return spark.createDataFrame(data, "file_id long, workspace_id long, submission string, content string, dir_id long")


def test_store_round_trip(spark, tmp_path):
    f = files(spark, [(1, 1, "s", "text", None), (2, 2, "s", "", None), (3, 1, "s", None, None)])
    store.write_files(f, str(tmp_path / "f"))
    back = spark.read.parquet(str(tmp_path / "f"))
    assert store.intact(back).count() == 3 and store.damaged(back).count() == 0
    from pyspark.sql import functions as F

    assert store.damaged(back.withColumn("content", F.concat("content", F.lit("x")))).count() == 2
    m = spark.createDataFrame([(1, "n"), (2, "t")], "file_id long, detector string")
    for _ in range(2):
        store.write_matches(m, str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m")).count() == 2


@pytest.mark.parametrize("mode, want", [(store.REPLACE, [2, 3, 4]), (store.KEEP, [1, 2, 4]), (store.MERGE, [1, 2, 3, 4])])
def test_added_submissions(spark, mode, want):
    old, new = files(spark, [(1, 1, "s", "x", None), (2, 1, None, "x", None)]), files(spark, [(3, 1, "s", "x", None), (4, 1, "t", "x", None)])
    assert sorted(r["file_id"] for r in store.add_submissions(old, new, ["workspace_id", "submission"], mode).collect()) == want
    with pytest.raises(ValueError):
        store.add_submissions(old, new, ["submission"], 7)


def test_merged_directories(spark):
    rows = [
        (1, None, "s"), (2, 1, "a"), (3, 2, "b"), (4, 1, None),
        (10, None, "s"), (11, 10, "a"), (12, 11, "b"), (13, 11, "c"), (14, 13, "b"), (15, 10, None), (16, 12, "d"),
        (20, None, "s"), (21, 20, "a"), (22, 21, "c"), (23, 22, "e"), (30, None, "t"), (31, 30, "a"), (40, 41, "x"), (41, 40, "y"),
    ]
    dirs = spark.createDataFrame(rows, "dir_id long, parent_id long, name string")
    f = files(spark, [(i, 1, "s", "x", d) for i, d in enumerate([1, 3, 10, 11, 12, 13, 14, 15, 16, 22, 23, 31, 40, None])])
    merged = spark.createDataFrame([(1, 10), (1, 20)], "existing long, pending long")
    after, moved = store.merge_directories(dirs, f, hierarchy.nested_sets(dirs), merged)
    assert sorted((r["dir_id"], r["parent_id"]) for r in after.where("dir_id <> 1 AND dir_id <> 30").collect()) == [(2, 1), (3, 2), (4, 1), (13, 2), (14, 13), (15, 1), (16, 3), (23, 13), (31, 30), (40, 41), (41, 40)]
    assert sorted((r["file_id"], r["dir_id"]) for r in moved.where("dir_id IS NOT NULL").collect()) == list(enumerate([1, 3, 1, 2, 3, 13, 14, 15, 16, 13, 23, 31, 40]))
    assert moved.count() == 14 and after.count() == 13 and set(after.columns) == {"dir_id", "parent_id", "name"}
    paths = [r["p"] for r in hierarchy.nested_sets(after).where("NOT is_cycle").selectExpr("array_join(path, '/') AS p").collect()]
    assert len(paths) == len(set(paths)) == 11


def test_removal(spark):
    dirs = hierarchy.nested_sets(spark.createDataFrame([(1, None, "a"), (2, 1, "b"), (3, 1, "c"), (4, None, "d"), (5, 4, "e")], "dir_id long, parent_id long, name string"))
    f = files(spark, [(1, 1, "s", "x", 2), (2, 1, "t", "x", 3), (3, 1, "s", "x", 1), (4, 1, "s", "x", 4), (5, 1, "s", "x", 5), (6, 2, "s", "x", None)])
    jobs = spark.createDataFrame([(1, "COMPLETE"), (2, "COMPLETE")], "workspace_id long, status string")
    gone = spark.createDataFrame([(1, "s")], "workspace_id long, submission string")
    left, kept, after = store.remove_submissions(f, dirs, jobs, gone, ["workspace_id", "submission"])
    assert sorted(r["file_id"] for r in left.collect()) == [2, 6]
    assert sorted(r["dir_id"] for r in kept.collect()) == [1, 3]
    assert sorted(tuple(r) for r in after.collect()) == [(1, "MISSING_FILES"), (2, "COMPLETE")]


def test_lists(spark):
    j = spark.createDataFrame([(1, 1, None), (2, 3, 5), (3, 3, None), (4, 3, 9)], "job_id long, step int, started long")
    assert [r["job_id"] for r in store.ordered_jobs(j).collect()] == [4, 2, 3, 1]
    t = spark.createDataFrame([("a", "me", False), ("b", "you", False), ("c", "you", True)], "name string, owner string, is_public boolean")
    assert sorted(r["name"] for r in store.visible(t, "me").collect()) == ["a", "c"]
    b = spark.createDataFrame([(1, 3), (2, -5), (3, None)], "group_id long, weight int")
    assert [r["group_id"] for r in store.remove_groups(b, spark.createDataFrame([(1,)], "group_id long"), -5).collect()] == [3]


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "work.zip").write_bytes(zipped(ENTRIES))
    run = lambda: store_once(spark, tmp_path)
    run()
    (tmp_path / "in" / "D.java").write_bytes(b"class D {}")
    run()
    assert sorted(r["filename"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["A", "B", "C", "D"]


def store_once(spark, tmp_path):
    ingest.store_stream(ingest.stream_uploads(spark, str(tmp_path / "in")), 1, str(tmp_path / "out"), str(tmp_path / "check"), once=True).awaitTermination(120)
