"""Stored files: writing and checking them, and what happens to submissions that are uploaded again or removed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.columns import content_hash

REPLACE, KEEP, MERGE = 0, 1, 2


def write_files(files: DataFrame, path: str, mode: str = "append", bits: int = 512):
    """Files with the hash of their content, in one directory for each workspace. Encryption is the storage layer's."""
    files.withColumn("content_hash", content_hash("content", bits)).write.mode(mode).partitionBy("workspace_id").parquet(path)


def intact(stored: DataFrame, bits: int = 512) -> DataFrame:
    """Rows whose content still has its hash; such without content are kept if they have no hash either."""
    return stored.where(F.col("content_hash").eqNullSafe(content_hash("content", bits)))


def damaged(stored: DataFrame, bits: int = 512) -> DataFrame:
    return stored.where(~F.col("content_hash").eqNullSafe(content_hash("content", bits)))


def write_matches(matches: DataFrame, path: str):
    """Raw results; a job that runs again replaces its own."""
    matches.write.mode("overwrite").partitionBy("detector").parquet(path)


def orphans(rows: DataFrame, files: DataFrame, key: str = "file_id") -> DataFrame:
    """(kind, key): keys of rows without a file, and of files without a row. Null keys count nowhere."""
    r, f = rows.select(key).where(F.col(key).isNotNull()).distinct(), files.select(key).where(F.col(key).isNotNull()).distinct()
    return r.join(f, key, "left_anti").select(F.lit("no file").alias("kind"), key).unionByName(f.join(r, key, "left_anti").select(F.lit("no row").alias("kind"), key))


def collisions(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Submissions that are there already."""
    return new.select(*keys).distinct().join(old.select(*keys).distinct(), keys, "left_semi")


def add_submissions(old: DataFrame, new: DataFrame, keys: list[str], mode: int = MERGE) -> DataFrame:
    """All files after an upload. Of submissions that are there already, REPLACE drops the old files, KEEP the new ones, and MERGE keeps
    both (``merge_directories`` then merges their directories). Files whose keys are null collide with nothing."""
    if mode == REPLACE:
        old = old.join(new.select(*keys).distinct(), keys, "left_anti")
    elif mode == KEEP:
        new = new.join(old.select(*keys).distinct(), keys, "left_anti")
    elif mode != MERGE:
        raise ValueError("mode has to be REPLACE, KEEP or MERGE")
    return old.unionByName(new, allowMissingColumns=True)


def merge_directories(dirs: DataFrame, files: DataFrame, tree: DataFrame, merged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Directories (dir_id, parent_id, ...) and files (dir_id, ...) after pending submissions are merged into existing ones.

    ``tree`` is the nested sets of ``dirs``, ``merged`` has pairs (existing, pending) of roots; an existing one is pending in no pair.
    A pending directory whose path below its root the existing submission has, or a pending one of a smaller id before it, goes:
    its files and the directories in it move to that one, of several to the smallest dir_id. All others stay with what is in them.
    A null name is like no other, as its path has the directory's id.
    """
    merged = merged.select(F.col("existing").cast("long").alias("existing"), F.col("pending").cast("long").alias("pending")).where("existing <> pending").groupBy("pending").agg(F.min("existing").alias("existing"))
    sources = merged.select("existing", F.col("pending").alias("root_id"), F.lit(1).alias("late")).unionByName(merged.select("existing", F.col("existing").alias("root_id"), F.lit(0).alias("late")).distinct())
    below = tree.where("NOT is_cycle").select("dir_id", "root_id", F.expr("slice(path, 2, size(path))").alias("below"))
    placed = below.join(sources, "root_id").select("existing", "below", "late", "root_id", "dir_id")
    first = placed.groupBy("existing", "below").agg(F.min(F.struct("late", "root_id", "dir_id")).alias("x")).select(F.col("existing").alias("_e"), F.col("below").alias("_b"), "x")
    moved = placed.join(first, (F.col("existing") == F.col("_e")) & (F.col("below") == F.col("_b"))).where("root_id <> x.root_id").select(F.col("dir_id").alias("_dir"), F.col("x.dir_id").alias("_to"))

    def to(rows: DataFrame, key: str) -> DataFrame:
        return rows.join(moved, F.col(key) == F.col("_dir"), "left").withColumn(key, F.coalesce("_to", key)).drop("_dir", "_to")

    return to(dirs.join(moved.select(F.col("_dir").alias("dir_id")), "dir_id", "left_anti"), "parent_id"), to(files, "dir_id")


def latest(files: DataFrame, key: str = "file_id", at: str = "loaded_at") -> DataFrame:
    """Of rows that repeat a key the one that was loaded last."""
    return files.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc_nulls_last(at)))).where("_n = 1").drop("_n")


def remove_groups(blocks: DataFrame, marked: DataFrame, size_mark: int | None = None) -> DataFrame:
    """Blocks whose group isn't marked (group_id) for deletion and, with a mark, whose weight isn't it."""
    out = blocks.join(marked.select("group_id").distinct(), "group_id", "left_anti")
    return out if size_mark is None else out.where(~F.col("weight").eqNullSafe(F.lit(size_mark)))


def remove_submissions(files: DataFrame, dirs: DataFrame, jobs: DataFrame, gone: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Files, directories and jobs after the removal of submissions (keys): their files go, directories that had files and have none
    any more, nor directories below that have, go as well, and jobs over the workspace miss files.

    ``dirs`` is a table of nested sets (dir_id, root_id, pre, last): a directory stays if any file of its range does.
    """
    left = files.join(gone.select(*keys).distinct(), keys, "left_anti")
    had = files.where(F.col("dir_id").isNotNull()).select("dir_id").distinct()
    have = left.where(F.col("dir_id").isNotNull()).select("dir_id").distinct()
    emptied = had.join(have, "dir_id", "left_anti").join(dirs.select("dir_id", "root_id", "pre", "last"), "dir_id")
    still = have.join(dirs.select("dir_id", "root_id", "pre"), "dir_id").select(F.col("root_id").alias("_root"), F.col("pre").alias("_pre"))
    # the first place with files at or after the directory's own says whether its range has any
    marks = emptied.select("root_id", "pre", "last", "dir_id").unionByName(still.select(F.col("_root").alias("root_id"), F.col("_pre").alias("pre")), allowMissingColumns=True)
    following = Window.partitionBy("root_id").orderBy(F.col("pre")).rangeBetween(0, Window.unboundedFollowing)
    nearest = F.min(F.when(F.col("dir_id").isNull(), F.col("pre"))).over(following)
    dead = marks.withColumn("_next", nearest).where("dir_id IS NOT NULL AND (_next IS NULL OR _next > last)").select("dir_id")
    touched = files.join(gone.select(*keys).distinct(), keys, "left_semi").select("workspace_id").distinct().withColumn("_missing", F.lit(True))
    status = F.when(F.col("_missing"), F.lit("MISSING_FILES")).otherwise(F.col("status"))
    return left, dirs.join(dead, "dir_id", "left_anti"), jobs.join(touched, "workspace_id", "left").withColumn("status", status).drop("_missing")


def visible(templates: DataFrame, user: str) -> DataFrame:
    """Templates of a user's own, and public ones."""
    return templates.where((F.col("owner") == user) | F.col("is_public"))


def ordered_jobs(jobs: DataFrame) -> DataFrame:
    """By step and start, both falling, jobs that haven't started last."""
    return jobs.orderBy(F.desc("step"), F.desc_nulls_last("started"), "job_id")
