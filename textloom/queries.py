"""Queries of the core over the test tables, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom import java_sql
from textloom.functions import columns
from textloom.operators import grouping, hierarchy, ngram, pairs, preprocess, scoring, skeleton, structure
from textloom.plans import job, report
from textloom.session import Stash, spread, table
from textloom.sources import store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


# Hierarchies

DIRS = """
WITH RECURSIVE d AS (SELECT dir_id, min(parent_id) AS parent_id, min(name) AS name FROM submission_dirs GROUP BY dir_id),
p AS (SELECT d.dir_id, u.dir_id AS parent_id, d.name FROM d LEFT JOIN d u ON u.dir_id = d.parent_id),
walk AS (
  SELECT dir_id, dir_id AS root_id, 0 AS depth, coalesce(name, '#' || dir_id) AS path FROM p WHERE parent_id IS NULL
  UNION ALL
  SELECT p.dir_id, w.root_id, w.depth + 1, w.path || '/' || coalesce(p.name, '#' || p.dir_id) FROM walk w JOIN p ON p.parent_id = w.dir_id
)
"""


def _files_by_dir(spark: SparkSession, folder: str) -> DataFrame:
    files = table(spark, folder, "files").select("file_id", "dir_id").where("file_id IS NOT NULL").distinct()
    return files.groupBy(F.col("dir_id").alias("node")).agg(F.count("*").alias("weight"))


@query("p5_found", DIRS + "SELECT dir_id, root_id, depth FROM walk UNION ALL SELECT dir_id, -1, -1 FROM d WHERE dir_id NOT IN (SELECT dir_id FROM walk)")
def p5_found(spark, folder):
    return hierarchy.nested_sets(table(spark, folder, "submission_dirs"), paths=False).select("dir_id", "root_id", "depth")


@query(
    "p5_tree",
    DIRS
    + """, up AS (SELECT dir_id AS a, dir_id AS n FROM walk UNION ALL SELECT p.parent_id, up.n FROM up JOIN p ON p.dir_id = up.a WHERE p.parent_id IS NOT NULL),
f AS (SELECT dir_id, count(DISTINCT file_id) AS c FROM files WHERE dir_id IS NOT NULL GROUP BY dir_id),
t AS (SELECT a AS dir_id, count(*) - 1 AS n_dirs_below, coalesce(sum(f.c), 0)::BIGINT AS n_files_below FROM up LEFT JOIN f ON f.dir_id = up.n GROUP BY a)
SELECT dir_id, root_id, depth, path, n_dirs_below, n_files_below, false AS is_cycle FROM walk JOIN t USING (dir_id)
UNION ALL SELECT dir_id, -1, -1, NULL, NULL, NULL, true FROM d WHERE dir_id NOT IN (SELECT dir_id FROM walk)""",
)
def p5_tree(spark, folder):
    tree = hierarchy.nested_sets(table(spark, folder, "submission_dirs"), weights=_files_by_dir(spark, folder))
    return tree.select("dir_id", "root_id", "depth", F.array_join("path", "/").alias("path"), F.col("n_below").alias("n_dirs_below"), F.col("weight_below").alias("n_files_below"), "is_cycle")


@query(
    "p5_descendants",
    DIRS
    + """, up AS (SELECT dir_id AS a, dir_id AS n, 0 AS distance FROM walk UNION ALL SELECT p.parent_id, up.n, distance + 1 FROM up JOIN p ON p.dir_id = up.a WHERE p.parent_id IS NOT NULL)
SELECT a AS ancestor, n AS descendant, distance FROM up WHERE a <> n""",
)
def p5_descendants(spark, folder):
    return hierarchy.descendants(hierarchy.nested_sets(table(spark, folder, "submission_dirs"), paths=False))


# Files

FILES = "f AS (SELECT file_id, any_value(submission) AS submission, any_value(filename) AS filename, any_value(extension) AS extension, any_value(size) AS size, any_value(content) AS content, any_value(workspace_id) AS workspace_id, any_value(dir_id) AS dir_id FROM files WHERE file_id IS NOT NULL GROUP BY file_id)"
LINES = r"(CASE WHEN content = '' THEN [] ELSE string_split_regex(regexp_replace(content, '(\r\n|\n|\r)$', ''), '\r\n|\n|\r') END)"


def _files(spark, folder):
    return pairs.one_row_per_file(table(spark, folder, "files").drop("loaded_at"))


@query("file_lines", f"WITH {FILES} SELECT file_id, len(l) AS line_count, len(list_filter(l, lambda x: x <> '')) AS nonempty_line_count FROM (SELECT file_id, {LINES} AS l FROM f WHERE content IS NOT NULL)")
def file_lines(spark, folder):
    f = _files(spark, folder).where("content IS NOT NULL")
    return f.select("file_id", columns.line_count("content").alias("line_count"), columns.nonempty_line_count("content").alias("nonempty_line_count"))


@query(
    "file_names",
    f"""WITH {FILES} SELECT file_id, filename || '.' || extension AS name, CASE WHEN size >= 1000000 THEN ((size + 50000) // 100000 // 10) || '.' || ((size + 50000) // 100000 % 10) || ' MB' WHEN size >= 1000 THEN ((size + 50) // 100 // 10) || '.' || ((size + 50) // 100 % 10) || ' kB' ELSE size || ' B' END AS size FROM f""",
)
def file_names(spark, folder):
    return _files(spark, folder).select("file_id", columns.display_name("filename", "extension").alias("name"), columns.display_size("size").alias("size"))


@query("file_hashes", f"WITH {FILES}, x AS (SELECT file_id, sha256(content) AS hash, sha256(rpad(file_id::VARCHAR, 1024, ' ')) AS h FROM f) SELECT file_id, hash, substring(h, 1, 2) || '/' || substring(h, 3, 2) || '/' || h AS locator FROM x")
def file_hashes(spark, folder):
    return _files(spark, folder).select("file_id", columns.content_hash("content", 256).alias("hash"), columns.locator(F.col("file_id").cast("string"), 256).alias("locator"))


@query(
    "file_paths",
    DIRS + f", {FILES} SELECT f.file_id, walk.path || '/' || f.filename AS path FROM f JOIN walk USING (dir_id) WHERE f.filename IS NOT NULL",
)
def file_paths(spark, folder):
    tree = hierarchy.nested_sets(table(spark, folder, "submission_dirs")).where("NOT is_cycle").select("dir_id", "path")
    f = _files(spark, folder).select("file_id", "dir_id", "filename").where("filename IS NOT NULL")
    return f.join(tree, "dir_id").select("file_id", F.array_join(F.concat("path", F.array("filename")), "/").alias("path"))


@query("submissions", f"WITH {FILES} SELECT workspace_id, submission, submission = 'SKELETON CODE' AS is_skeleton, count(*) AS n_files FROM f WHERE submission IS NOT NULL GROUP BY ALL")
def submissions(spark, folder):
    f = _files(spark, folder).where("submission IS NOT NULL")
    return f.groupBy("workspace_id", "submission", (F.col("submission") == skeleton.SKELETON).alias("is_skeleton")).agg(F.count("*").alias("n_files"))


@query("statistics", "SELECT (SELECT count(DISTINCT workspace_id) FROM workspaces) AS n_workspaces, (SELECT count(DISTINCT (workspace_id, submission)) FROM files WHERE workspace_id IS NOT NULL AND submission IS NOT NULL AND file_id IS NOT NULL) AS n_submissions, (SELECT count(DISTINCT file_id) FROM files) AS n_files")
def statistics(spark, folder):
    return report.statistics(table(spark, folder, "workspaces"), table(spark, folder, "files"))


# Stored files and uploads. Rows of files that were loaded on another day than they are of stand for a later upload.

UPLOADS = "u AS (SELECT *, loaded_at - ts > INTERVAL 1 DAY AS late FROM (SELECT DISTINCT file_id, submission, workspace_id, ts, loaded_at FROM files WHERE file_id IS NOT NULL)), old AS (SELECT * FROM u WHERE late IS NOT true), new AS (SELECT * FROM u WHERE late)"


def _uploads(spark, folder):
    u = table(spark, folder, "files").where("file_id IS NOT NULL").select("file_id", "submission", "workspace_id", "ts", "loaded_at").distinct()
    late = F.coalesce(F.col("loaded_at") - F.col("ts") > F.expr("INTERVAL 1 DAY"), F.lit(False))
    return u.where(~late), u.where(late)


def _added(mode):
    def run(spark, folder):
        old, new = _uploads(spark, folder)
        return store.add_submissions(old, new, ["workspace_id", "submission"], mode).groupBy("workspace_id").agg(F.count("*").alias("n_rows"), F.countDistinct("file_id").alias("n_files"))

    return run


_COUNTS = "SELECT workspace_id, count(*) AS n_rows, count(DISTINCT file_id) AS n_files FROM ({}) GROUP BY workspace_id"
_HIT = "EXISTS (SELECT 1 FROM {0} x WHERE x.workspace_id = {1}.workspace_id AND x.submission = {1}.submission)"
query("uploads_replace", f"WITH {UPLOADS} " + _COUNTS.format("SELECT * FROM old WHERE NOT " + _HIT.format("new", "old") + " UNION ALL SELECT * FROM new"))(_added(store.REPLACE))
query("uploads_keep", f"WITH {UPLOADS} " + _COUNTS.format("SELECT * FROM new WHERE NOT " + _HIT.format("old", "new") + " UNION ALL SELECT * FROM old"))(_added(store.KEEP))
query("uploads_merge", f"WITH {UPLOADS} " + _COUNTS.format("SELECT * FROM old UNION ALL SELECT * FROM new"))(_added(store.MERGE))


@query("upload_collisions", f"WITH {UPLOADS} SELECT DISTINCT workspace_id, submission FROM new WHERE {_HIT.format('old', 'new')}")
def upload_collisions(spark, folder):
    old, new = _uploads(spark, folder)
    return store.collisions(old, new, ["workspace_id", "submission"])


@query("latest_files", "SELECT file_id, epoch_us(max(loaded_at)) AS loaded_at FROM files GROUP BY file_id")
def latest_files(spark, folder):
    return store.latest(table(spark, folder, "files").select("file_id", "loaded_at")).select("file_id", F.unix_micros("loaded_at").alias("loaded_at"))


@query(
    "block_orphans",
    "SELECT 'no file' AS kind, file_id FROM (SELECT DISTINCT file_id FROM blocks WHERE file_id NOT IN (SELECT file_id FROM files)) UNION ALL SELECT 'no row', file_id FROM (SELECT DISTINCT file_id FROM files WHERE file_id NOT IN (SELECT file_id FROM blocks WHERE file_id IS NOT NULL))",
)
def block_orphans(spark, folder):
    return store.orphans(table(spark, folder, "blocks"), table(spark, folder, "files"))


@query(
    "remove_submissions",
    DIRS
    + f""", {FILES}, gone AS (SELECT DISTINCT workspace_id, submission FROM f WHERE extension = 'hs' AND workspace_id IS NOT NULL AND submission IS NOT NULL),
l AS (SELECT f.* FROM f LEFT JOIN gone USING (workspace_id, submission) WHERE gone.submission IS NULL),
up AS (SELECT dir_id AS a, dir_id AS n FROM walk UNION ALL SELECT p.parent_id, up.n FROM up JOIN p ON p.dir_id = up.a WHERE p.parent_id IS NOT NULL),
alive AS (SELECT DISTINCT a FROM up JOIN l ON l.dir_id = up.n),
dead AS (SELECT DISTINCT f.dir_id FROM f JOIN walk USING (dir_id) WHERE f.dir_id NOT IN (SELECT dir_id FROM l WHERE dir_id IS NOT NULL) AND f.dir_id NOT IN (SELECT a FROM alive))
SELECT 'file' AS kind, file_id AS id FROM l UNION ALL SELECT 'dir', dir_id FROM d WHERE dir_id NOT IN (SELECT dir_id FROM dead)""",
)
def remove_submissions(spark, folder):
    """Removal of all submissions that have a Haskell file."""
    f = _files(spark, folder)
    gone = f.where("extension = 'hs' AND workspace_id IS NOT NULL AND submission IS NOT NULL").select("workspace_id", "submission").distinct()
    jobs = table(spark, folder, "workspaces").select("workspace_id", F.lit("COMPLETE").alias("status"))
    left, dirs, _ = store.remove_submissions(f, hierarchy.nested_sets(table(spark, folder, "submission_dirs")), jobs, gone, ["workspace_id", "submission"])
    return left.select(F.lit("file").alias("kind"), F.col("file_id").alias("id")).unionByName(dirs.select(F.lit("dir").alias("kind"), F.col("dir_id").alias("id")))


@query(
    "remove_groups",
    "SELECT m.match_id AS group_id, count(*) AS n FROM (SELECT match_id, any_value(block1_id) AS block1_id, any_value(similarity) AS similarity FROM matches GROUP BY match_id) m JOIN blocks b ON b.block_id = m.block1_id WHERE m.match_id NOT IN (SELECT match_id FROM matches WHERE similarity < 0.5 AND NOT isnan(similarity)) GROUP BY 1",
)
def remove_groups(spark, folder):
    m = table(spark, folder, "matches")
    blocks = _matches(spark, folder).select(F.col("match_id").alias("group_id"), F.col("block1_id").alias("block_id")).join(table(spark, folder, "blocks").select("block_id", "weight"), "block_id")
    marked = m.where("similarity < 0.5 AND NOT isnan(similarity)").select(F.col("match_id").alias("group_id"))
    return store.remove_groups(blocks, marked).groupBy("group_id").agg(F.count("*").alias("n"))


# Pairs

SUB = "s AS (SELECT DISTINCT workspace_id, file_id, coalesce(submission, '#' || file_id) AS sub, filename || '.' || extension AS name FROM files WHERE file_id IS NOT NULL AND workspace_id IS NOT NULL)"


@query("pair_counts", f"WITH {SUB} SELECT workspace_id, sum(n)::BIGINT AS n_files, ((sum(n) ** 2 - sum(n ** 2)) / 2)::BIGINT AS n_pairs FROM (SELECT workspace_id, sub, count(*) AS n FROM s GROUP BY ALL) GROUP BY workspace_id")
def pair_counts(spark, folder):
    return pairs.pair_counts(table(spark, folder, "files"))


@query("same_name_pairs", f"WITH {SUB} SELECT a.workspace_id, a.file_id AS file1_id, b.file_id AS file2_id FROM s a JOIN s b ON a.workspace_id = b.workspace_id AND a.name = b.name AND a.file_id < b.file_id AND a.sub <> b.sub")
def same_name_pairs(spark, folder):
    return pairs.file_pairs(table(spark, folder, "files"), same_name=True)


# N-grams

_GRAMS = "SELECT {0}, unnest(list_filter(list_transform(range(1, greatest(length(p) - 7, 1) + 1), lambda i: substring(p, i, 8)), lambda g: regexp_matches(g, '\\S'))) AS gram FROM (SELECT {0}, CASE WHEN length(l) < 8 THEN rpad(l, 8, ' ') ELSE l END AS p FROM ({1}) WHERE regexp_matches(l, '\\S'))"


@query(
    "line_grams",
    "WITH g AS (" + _GRAMS.format("doc_id", r"SELECT doc_id, unnest(string_split_regex(text, '\r?\n|\r')) AS l FROM documents WHERE text IS NOT NULL") + ") SELECT doc_id, count(*) AS n_grams, count(DISTINCT gram) AS n_distinct FROM g GROUP BY doc_id",
)
def line_grams(spark, folder):
    """How many character 8-grams each document's lines have."""
    docs = spread(table(spark, folder, "documents").where("text IS NOT NULL").select("doc_id", "text"))
    grams = ngram.exploded_grams(docs.select("doc_id", F.explode(columns.split_lines("text")).alias("l")), ["doc_id"], "l", 8)
    return grams.groupBy("doc_id", "gram").agg(F.count("*").alias("n")).groupBy("doc_id").agg(F.sum("n").alias("n_grams"), F.count("*").alias("n_distinct"))


@query(
    "multiset_jaccard",
    f"WITH {FILES}, {SUB}, q AS (SELECT a.file_id AS file1_id, b.file_id AS file2_id FROM s a JOIN s b ON a.workspace_id = b.workspace_id AND a.name = b.name AND a.file_id < b.file_id AND a.sub <> b.sub JOIN f x ON x.file_id = a.file_id JOIN f y ON y.file_id = b.file_id WHERE x.content IS NOT NULL AND y.content IS NOT NULL), "
    + f"l AS (SELECT file_id, unnest({LINES}) AS l FROM f WHERE content IS NOT NULL AND (file_id IN (SELECT file1_id FROM q) OR file_id IN (SELECT file2_id FROM q))), g AS ("
    + _GRAMS.format("file_id", "SELECT * FROM l")
    + "), c AS (SELECT file_id, gram, count(*) AS n FROM g GROUP BY ALL), k AS (SELECT q.*, c.gram, c.n AS a, 0 AS b FROM q JOIN c ON c.file_id = file1_id UNION ALL SELECT q.*, c.gram, 0, c.n FROM q JOIN c ON c.file_id = file2_id), "
    + "t AS (SELECT file1_id, file2_id, gram, sum(a) AS a, sum(b) AS b FROM k GROUP BY ALL) SELECT q.file1_id, q.file2_id, coalesce(x.similarity, 0) AS similarity FROM q LEFT JOIN (SELECT file1_id, file2_id, round((sum(least(a, b)) / sum(greatest(a, b)))::DOUBLE, 9) AS similarity FROM t GROUP BY ALL) x USING (file1_id, file2_id)",
)
def multiset_jaccard(spark, folder):
    """Similarity of files of the same name of different submissions."""
    files = table(spark, folder, "files")
    named = files.withColumn("_grp", F.xxhash64("workspace_id", columns.display_name("filename", "extension"))).where("workspace_id IS NOT NULL")
    p = pairs.file_pairs(named, "_grp", same_name=True).select(F.col("_grp").alias("grp"), F.col("file1_id").cast("long").alias("a"), F.col("file2_id").cast("long").alias("b"))
    stash = Stash(spark)
    p = stash.keep(p)
    paired = p.select(F.explode(F.array("a", "b")).alias("file_id")).distinct()
    texts = pairs.one_row_per_file(files.where("content IS NOT NULL").select("file_id", "content").join(paired, "file_id", "left_semi"))
    texts = stash.keep(texts.select(F.col("file_id").cast("long").alias("id"), columns.text_lines("content").alias("values")))
    return ngram.multiset_jaccard_of_files(p, texts).withColumn("similarity", F.round("similarity", 9))


def _context(spark, folder, trees=True):
    return job.Context(table(spark, folder, "files").drop("loaded_at"), table(spark, folder, "workspaces"), trees)


@query("window_candidates")
def window_candidates(spark, folder):
    return ngram.candidates(_context(spark, folder).texts).select(F.col("grp").alias("workspace_id"), F.col("a").alias("file1_id"), F.col("b").alias("file2_id"))


@query("ngram_matches")
def ngram_matches(spark, folder):
    return ngram.detect(_context(spark, folder).texts)


# Tokens, trees and declarations


JAVA = java_sql.tokens(FILES)


def _of(spark, folder, lang):
    return _context(spark, folder).files.where(F.col("lang") == lang)


def _channels(spark, folder, lang):
    t = preprocess.tokenise(_of(spark, folder, lang)).select("file_id", F.explode("tokens").alias("t"))
    return t.groupBy(F.col("t.channel").alias("channel"), F.col("t.type").alias("type")).agg(F.count("*").alias("n"), F.countDistinct("file_id").alias("n_files"), F.countDistinct("t.text").alias("n_texts"))


@query("token_channels", JAVA + "SELECT channel, kind AS type, count(*) AS n, count(DISTINCT file_id) AS n_files, count(DISTINCT x) AS n_texts FROM jt GROUP BY ALL")
def token_channels(spark, folder):
    """How often each kind of Java token stands in all files, in how many of them, and with how many texts."""
    return _channels(spark, folder, "java")


@query("haskell_token_channels")
def haskell_token_channels(spark, folder):
    return _channels(spark, folder, "haskell")


COMMENTS, CODE, NAMES = preprocess.Strategy("comments", ("comments_only",)), preprocess.Strategy("code", ("without_comments",)), preprocess.Strategy("names", (), names=True)


@query("comment_lines", JAVA + java_sql.lines("x", "4"))
def comment_lines(spark, folder):
    return preprocess.lines(_of(spark, folder, "java"), COMMENTS)


@query("uncommented_lines", JAVA + java_sql.lines("x", "0, 2, 3"))
def uncommented_lines(spark, folder):
    return preprocess.lines(_of(spark, folder, "java"), CODE)


@query("java_trimmed_lines", JAVA + java_sql.lines("CASE WHEN channel = 3 THEN ' ' ELSE x END", "0, 2, 3, 4"))
def java_trimmed_lines(spark, folder):
    return preprocess.lines(_of(spark, folder, "java"))


@query("token_lines", JAVA + java_sql.NAMED)
def token_lines(spark, folder):
    return preprocess.lines(_of(spark, folder, "java"), NAMES)


@query("haskell_lines")
def haskell_lines(spark, folder):
    """The lines of Haskell files by all strategies."""
    files = _of(spark, folder, "haskell")
    parts = [preprocess.lines(files, x).withColumn("strategy", F.lit(x.name)) for x in (COMMENTS, CODE, NAMES, preprocess.NO_WHITESPACE)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("trimmed_lines")
def trimmed_lines(spark, folder):
    return preprocess.lines(_context(spark, folder).files)


@query("tree_nodes")
def tree_nodes(spark, folder):
    return structure.nodes(structure.parse(_context(spark, folder).files))


@query("tree_kinds")
def tree_kinds(spark, folder):
    n = structure.nodes(structure.parse(_context(spark, folder).files))
    return n.groupBy("lang", "kind").agg(F.count("*").alias("n"), F.max("height").alias("highest"), F.max("weight").alias("heaviest"))


@query("tree_matches")
def tree_matches(spark, folder):
    files = _context(spark, folder).files
    return structure.tree_matches(structure.parse_packed(files, least_height=5), files)


@query("declarations")
def declarations(spark, folder):
    return _context(spark, folder, trees=False).declared


@query("variable_matches")
def variable_matches(spark, folder):
    return structure.variable_matches(_context(spark, folder, trees=False).declared)


@query("variable_groups")
def variable_groups(spark, folder):
    return grouping.variable_groups(_context(spark, folder, trees=False).declared)


# Matches and blocks of the test tables


def _matches(spark, folder):
    m = table(spark, folder, "matches").drop("loaded_at")
    rest = [c for c in m.columns if c != "match_id"]
    return m.where("match_id IS NOT NULL").groupBy("match_id").agg(F.min(F.struct(*rest)).alias("x")).select("match_id", "x.*")


def _blocks(spark, folder):
    b = table(spark, folder, "blocks")
    rest = [c for c in b.columns if c != "block_id"]
    return b.where("block_id IS NOT NULL").groupBy("block_id").agg(F.min(F.struct(*rest)).alias("x")).select("block_id", "x.*")


def _file_matches(spark, folder):
    """Matches of two blocks of different files of one workspace, with the files."""
    b = _blocks(spark, folder).select("block_id", "file_id")
    w = _files(spark, folder).select("file_id", F.col("workspace_id").alias("grp"))
    m = _matches(spark, folder).join(b.withColumnsRenamed({"block_id": "block1_id", "file_id": "file1_id"}), "block1_id").join(b.withColumnsRenamed({"block_id": "block2_id", "file_id": "file2_id"}), "block2_id")
    return m.where("file1_id <> file2_id").join(w.withColumnRenamed("file_id", "file1_id"), "file1_id")


MATCHED = f"""{FILES}, mm AS (SELECT match_id, any_value(detector) AS detector, any_value(block1_id) AS block1_id, any_value(block2_id) AS block2_id, any_value(s1) AS s1, any_value(e1) AS e1, any_value(s2) AS s2, any_value(e2) AS e2, any_value(similarity) AS similarity FROM matches WHERE match_id IS NOT NULL GROUP BY match_id),
bb AS (SELECT block_id, any_value(file_id) AS file_id, any_value(detector) AS detector, any_value(score) AS score, any_value(ranges) AS ranges, any_value(weight) AS weight FROM blocks WHERE block_id IS NOT NULL GROUP BY block_id),
m AS (SELECT mm.*, x.file_id AS file1_id, y.file_id AS file2_id, f.workspace_id AS grp FROM mm JOIN bb x ON x.block_id = block1_id JOIN bb y ON y.block_id = block2_id JOIN f ON f.file_id = x.file_id WHERE x.file_id <> y.file_id)"""


@query(
    "skeleton_subtract",
    f"""WITH {MATCHED}, sk AS (SELECT file_id FROM f WHERE submission = 'SKELETON CODE'),
mask AS (SELECT DISTINCT file, unnest(range(s, e + 1)) AS line FROM (SELECT file2_id AS file, s2 AS s, e2 AS e FROM m WHERE file1_id IN (FROM sk) UNION ALL SELECT file1_id, s1, e1 FROM m WHERE file2_id IN (FROM sk))),
own AS (SELECT * FROM m WHERE file1_id NOT IN (FROM sk) AND file2_id NOT IN (FROM sk) AND s1 <= e1 AND s2 <= e2),
l1 AS (SELECT match_id, file1_id AS file, unnest(range(s1, e1 + 1)) AS line FROM own), l2 AS (SELECT match_id, file2_id AS file, unnest(range(s2, e2 + 1)) AS line FROM own),
r1 AS (SELECT match_id, min(line) AS s1, max(line) AS e1, count(*) AS n1 FROM l1 ANTI JOIN mask USING (file, line) GROUP BY match_id), r2 AS (SELECT match_id, min(line) AS s2, max(line) AS e2, count(*) AS n2 FROM l2 ANTI JOIN mask USING (file, line) GROUP BY match_id)
SELECT match_id, s1, e1, s2, e2, e1 - s1 + 1 - n1 AS inside1, e2 - s2 + 1 - n2 AS inside2 FROM r1 JOIN r2 USING (match_id)""",
)
def skeleton_subtract(spark, folder):
    """Matches without the given code, and how many lines of it are left inside them."""
    given = _files(spark, folder).where(F.col("submission") == skeleton.SKELETON).select(F.col("file_id").alias("file"))
    out = skeleton.without_skeleton(_file_matches(spark, folder), given)
    count = lambda c: F.aggregate(c, F.lit(0), lambda a, r: a + r["end"] - r["start"] + 1)
    return out.select("match_id", "s1", "e1", "s2", "e2", count("inside1").alias("inside1"), count("inside2").alias("inside2"))


@query(
    "linked_groups",
    f"""WITH RECURSIVE {MATCHED}, k AS (SELECT match_id AS id, grp, similarity, least(file1_id, file2_id) AS f1, greatest(file1_id, file2_id) AS f2, CASE WHEN file1_id < file2_id THEN (s1, e1) ELSE (s2, e2) END AS r1, CASE WHEN file1_id < file2_id THEN (s2, e2) ELSE (s1, e1) END AS r2
  FROM m WHERE similarity IS NOT NULL AND NOT isnan(similarity) AND grp IS NOT NULL),
e AS (SELECT x.id AS a, y.id AS b FROM k x JOIN k y ON x.grp = y.grp AND CASE WHEN x.f1 = y.f1 THEN x.r1 = y.r1 WHEN x.f1 = y.f2 THEN x.r1 = y.r2 WHEN x.f2 = y.f1 THEN x.r2 = y.r1 WHEN x.f2 = y.f2 THEN x.r2 = y.r2 ELSE false END),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b), g AS (SELECT a AS id, min(b) AS label FROM r GROUP BY a),
s AS (SELECT label, grp, f1 AS file_id, r1 AS r, similarity FROM k JOIN g USING (id) UNION ALL SELECT label, grp, f2, r2, similarity FROM k JOIN g USING (id)),
b AS (SELECT label, grp, file_id, avg(similarity::DOUBLE) AS score, min(r) AS r FROM s GROUP BY ALL), z AS (SELECT *, count(*) OVER (PARTITION BY label) AS n_files FROM b),
w AS (SELECT workspace_id AS grp, count(*) AS whole FROM f GROUP BY 1)
SELECT file_id, round(score::FLOAT::DOUBLE, 5) AS score, r[1] AS start_line, r[2] AS end_line, n_files FROM z JOIN w USING (grp) WHERE (n_files / whole)::FLOAT <= 0.1::FLOAT""",
)
def linked_groups(spark, folder):
    """Groups of matches that are linked by an equal range, without those in more than a tenth of a workspace's files: the blocks of
    their files."""
    m = _file_matches(spark, folder).where("grp IS NOT NULL").withColumn("similarity", F.col("similarity").cast("double"))
    files = _files(spark, folder).groupBy(F.col("workspace_id").alias("grp")).agg(F.count("*").alias("n_files"))
    b = grouping.linked_matches(m, files, 0.1)
    n = b.groupBy("group_id").agg(F.count("*").alias("n_files"))
    return b.join(n, "group_id").select("file_id", F.round(F.col("score").cast("double"), 5).alias("score"), F.col("ranges")[0]["start_line"].alias("start_line"), F.col("ranges")[0]["end_line"].alias("end_line"), "n_files")


def _groups(spark, folder):
    """Each match as a group of its two blocks."""
    m = _file_matches(spark, folder).where("grp IS NOT NULL")
    side = m.select("match_id", "grp", F.explode(F.array("block1_id", "block2_id")).alias("block_id"))
    return side.join(_blocks(spark, folder).where("detector IS NOT NULL"), "block_id").select(F.col("match_id").alias("group_id"), "detector", "grp", "file_id", "score", "ranges", "weight")


SCORED = f"""WITH {MATCHED}, sides AS (SELECT match_id, unnest([block1_id, block2_id]) AS block_id FROM m WHERE grp IS NOT NULL), fl AS (SELECT file_id, len({LINES}) AS line_count FROM f WHERE content IS NOT NULL),
g AS (SELECT match_id AS group_id, bb.detector, bb.file_id, CASE WHEN score IS NULL OR isnan(score) THEN 0 ELSE score::DOUBLE END AS score, weight, CASE WHEN weight IS NULL THEN list_sum(list_transform(ranges, lambda x: x.end_line - x.start_line + 1)) ELSE 0 END AS lines, coalesce(line_count, 0) AS whole FROM sides JOIN bb USING (block_id) LEFT JOIN fl ON fl.file_id = bb.file_id WHERE bb.detector IS NOT NULL),
a AS (SELECT *, sum(lines) OVER (PARTITION BY detector, file_id) AS everything FROM g),
sc AS (SELECT group_id, detector, file_id, CASE WHEN whole > 0 THEN score * coalesce(weight, lines) / whole / CASE WHEN everything > whole AND weight IS NULL THEN everything / whole ELSE 1 END ELSE 0 END AS score FROM a),
raw AS (SELECT x.detector, x.file_id, y.file_id AS other_file_id, sum(x.score) AS score FROM sc x JOIN g y ON x.group_id = y.group_id AND x.file_id <> y.file_id GROUP BY ALL),
pairs AS (SELECT detector, file_id, other_file_id, least(1, score) AS score FROM raw UNION ALL SELECT NULL, file_id, other_file_id, least(1, sum(score)) FROM raw GROUP BY ALL)
"""


def _pair_scores(spark, folder):
    sizes = _files(spark, folder).where("content IS NOT NULL").select("file_id", columns.line_count("content").alias("line_count"))
    return scoring.pair_scores(scoring.group_scores(_groups(spark, folder), sizes))


@query("pair_scores", SCORED + "SELECT detector, file_id, other_file_id, round(score::FLOAT::DOUBLE, 4) AS score FROM pairs")
def pair_scores(spark, folder):
    return _pair_scores(spark, folder).withColumn("score", F.round(F.col("score").cast("double"), 4))


@query("overall_scores", SCORED + "SELECT detector, file_id, round(max(score)::FLOAT::DOUBLE, 4) AS score FROM pairs GROUP BY ALL UNION ALL SELECT NULL, file_id, 0 FROM f WHERE file_id NOT IN (SELECT file_id FROM pairs)")
def overall_scores(spark, folder):
    return scoring.file_overall(_pair_scores(spark, folder), _files(spark, folder)).withColumn("score", F.round(F.col("score").cast("double"), 4))


@query("mean_similarity", "SELECT detector, coalesce(round(avg(CASE WHEN isnan(similarity) THEN NULL ELSE similarity::DOUBLE END), 6), -1) AS mean FROM matches GROUP BY detector")
def mean_similarity(spark, folder):
    m = table(spark, folder, "matches").withColumn("similarity", F.when(~F.isnan("similarity"), F.col("similarity").cast("double")))
    return scoring.mean_or_minus_one(m, ["detector"], "similarity").withColumn("mean", F.round("mean", 6))


# Reports over the scores of the test tables

REPORTED = f"""WITH {FILES}, s AS (SELECT file_id, workspace_id, submission FROM f WHERE submission IS NOT NULL),
o AS (SELECT file_id, other_file_id, max(score) AS score FROM file_scores WHERE detector IS NULL AND other_file_id IS NOT NULL AND other_file_id <> file_id AND NOT isnan(score) AND score BETWEEN 0 AND 1 GROUP BY ALL),
both_ AS (SELECT s.workspace_id, s.submission, t.submission AS other, o.* FROM o JOIN s ON s.file_id = o.file_id JOIN s t ON t.file_id = o.other_file_id AND t.workspace_id = s.workspace_id AND t.submission <> s.submission),
ss AS (SELECT workspace_id, submission, coalesce(max(score), 0)::DOUBLE AS score FROM s LEFT JOIN o USING (file_id) GROUP BY ALL),
sp AS (SELECT workspace_id, submission, other, max(score)::DOUBLE AS score, count(*) AS n_file_pairs FROM both_ GROUP BY ALL),
sx AS (SELECT *, floor(score * 100 + 0.5)::INT AS percentage FROM ss), sb AS (SELECT *, CASE WHEN percentage <= 0 THEN 0 ELSE least(9, percentage // 10) END AS bucket FROM sx)
"""


def _overall(spark, folder):
    return report.overall(table(spark, folder, "file_scores"))


def _sub_files(spark, folder):
    return _files(spark, folder).select("file_id", "workspace_id", "submission")


@query("submission_scores", REPORTED + "SELECT *, CASE WHEN score >= 0.5 THEN 4 WHEN score >= 0.2 THEN 3 WHEN score >= 0.05 THEN 2 WHEN score >= 0.01 THEN 1 ELSE 0 END AS level FROM sb")
def submission_scores(spark, folder):
    return report.submission_scores(_overall(spark, folder), _sub_files(spark, folder))


@query("submission_pairs", REPORTED + "SELECT * FROM sp")
def submission_pairs(spark, folder):
    return report.submission_pairs(_overall(spark, folder), _sub_files(spark, folder))


@query("matching_submissions", REPORTED + "SELECT workspace_id, submission, count(DISTINCT other) AS n_others, max(score) AS highest, string_agg(other, ',' ORDER BY other) AS others FROM sp GROUP BY ALL")
def matching_submissions(spark, folder):
    p = report.submission_pairs(_overall(spark, folder), _sub_files(spark, folder))
    return p.groupBy("workspace_id", "submission").agg(F.count("*").alias("n_others"), F.max("score").alias("highest"), F.array_join(F.array_sort(F.collect_list("other")), ",").alias("others"))


@query("file_match_scores", REPORTED + "SELECT workspace_id, submission, other, file_id, other_file_id, score FROM both_ WHERE score > 0 AND score >= 0.2::FLOAT")
def file_match_scores(spark, folder):
    return report.file_matches(_overall(spark, folder), _sub_files(spark, folder), 0.2)


@query("histogram", REPORTED + "SELECT w.workspace_id, b.b::INT AS bucket, count(sb.submission) AS n FROM (SELECT DISTINCT workspace_id FROM ss) w CROSS JOIN range(10) b(b) LEFT JOIN sb ON sb.workspace_id IS NOT DISTINCT FROM w.workspace_id AND sb.bucket = b.b GROUP BY ALL")
def histogram(spark, folder):
    return report.histogram(report.submission_scores(_overall(spark, folder), _sub_files(spark, folder)))


@query("ranked_matches", REPORTED + "SELECT workspace_id, submission, other, score, row_number() OVER (PARTITION BY workspace_id, submission ORDER BY score DESC, other) AS place FROM sp")
def ranked_matches(spark, folder):
    p = report.submission_pairs(_overall(spark, folder), _sub_files(spark, folder)).select("workspace_id", "submission", "other", "score")
    return report.ranked(p, ["workspace_id", "submission"], "score", ["other"])


@query("network_edges", REPORTED + "SELECT workspace_id, least(submission, other) AS a, greatest(submission, other) AS b, max(score) AS score FROM sp GROUP BY ALL HAVING max(score) >= 0.1")
def network_edges(spark, folder):
    return report.network_edges(report.submission_pairs(_overall(spark, folder), _sub_files(spark, folder)), 0.1)


@query("named_scores", f"WITH {FILES} SELECT file_scores.file_id, other_file_id, coalesce(f.filename || '.' || f.extension, 'Deleted') AS name FROM file_scores LEFT JOIN f ON f.file_id = other_file_id")
def named_scores(spark, folder):
    names = _files(spark, folder).select(F.col("file_id").alias("id"), columns.display_name("filename", "extension").alias("name"))
    return report.with_names(table(spark, folder, "file_scores").select("file_id", "other_file_id"), "other_file_id", names)


COMPARED = f"WITH {MATCHED}, bl AS (SELECT match_id AS group_id, unnest([file1_id, file2_id]) AS file_id FROM m), sb AS (SELECT workspace_id, group_id, submission, count(*) AS n FROM bl JOIN f USING (file_id) WHERE submission IS NOT NULL GROUP BY ALL) "


def _group_files(spark, folder):
    return _file_matches(spark, folder).select(F.col("match_id").alias("group_id"), F.explode(F.array("file1_id", "file2_id")).alias("file_id"))


@query("comparisons", COMPARED + "SELECT a.workspace_id, a.submission, b.submission AS other, a.group_id, a.n + b.n AS n_blocks FROM sb a JOIN sb b ON a.workspace_id = b.workspace_id AND a.group_id = b.group_id AND a.submission < b.submission")
def comparisons(spark, folder):
    return report.comparison(_group_files(spark, folder), _sub_files(spark, folder))


@query("submission_reports", COMPARED + "SELECT a.workspace_id, a.submission, count(DISTINCT a.group_id) AS n_groups, count(DISTINCT b.submission) - 1 AS n_others FROM sb a JOIN sb b ON a.workspace_id = b.workspace_id AND a.group_id = b.group_id GROUP BY ALL")
def submission_reports(spark, folder):
    return report.submission_report(_group_files(spark, folder), _sub_files(spark, folder))


BLOCKS = "bb AS (SELECT block_id, any_value(file_id) AS file_id, any_value(ranges) AS ranges FROM blocks WHERE block_id IS NOT NULL GROUP BY block_id)"


@query(
    "line_coverage",
    f"WITH {BLOCKS}, r AS (SELECT block_id, file_id, unnest(ranges) AS r FROM bb), l AS (SELECT file_id, block_id, r.start_line AS s, r.end_line AS e, unnest(range(r.start_line, r.end_line + 1))::INT AS line FROM r), o AS (SELECT *, row_number() OVER (PARTITION BY file_id, line ORDER BY s DESC, e, block_id) AS n, count(*) OVER (PARTITION BY file_id, line) AS active FROM l) SELECT file_id, line, block_id AS visible, active FROM o WHERE n = 1",
)
def line_coverage(spark, folder):
    return _coverage(spark, folder).drop("all")


def _coverage(spark, folder):
    spans = _blocks(spark, folder).select("file_id", F.col("block_id").alias("match"), F.explode("ranges").alias("r")).select("file_id", "match", F.col("r.start_line").alias("start"), F.col("r.end_line").alias("end"))
    return report.line_coverage(spans, ["file_id"])


@query("block_lines", f"WITH {BLOCKS} SELECT block_id, file_id, list_sort(list_distinct(flatten(list_transform(ranges, lambda x: range(x.start_line, x.end_line + 1))))) AS lines FROM bb")
def block_lines(spark, folder):
    return report.block_lines(_blocks(spark, folder)).withColumn("lines", F.array_sort("lines"))


@query(
    "block_context",
    f"WITH {FILES}, {BLOCKS}, x AS (SELECT block_id, file_id, unnest(ranges) AS r FROM bb), l AS (SELECT file_id, {LINES} AS l FROM f WHERE content IS NOT NULL) SELECT block_id, x.file_id, r.start_line, r.end_line, greatest(1, r.start_line - 5) AS first_line, array_to_string(l[greatest(1, r.start_line - 5):least(len(l), r.end_line + 5)], chr(10)) AS lines FROM x JOIN l USING (file_id)",
)
def block_context(spark, folder):
    out = report.context(_blocks(spark, folder).select("block_id", "file_id", "ranges"), _files(spark, folder))
    return out.withColumn("lines", F.array_join("lines", "\n"))


@query(
    "match_json",
    f"WITH {MATCHED} SELECT match_id, to_json({{'reason': detector, 'score': floor(similarity::DOUBLE * 100 + 0.5)::INT, 'lines1': range(s1, e1 + 1), 'lines2': range(s2, e2 + 1)}})::VARCHAR AS json FROM mm WHERE detector IS NOT NULL AND similarity IS NOT NULL AND NOT isnan(similarity) AND s1 <= e1 AND s2 <= e2",
)
def match_json(spark, folder):
    m = _matches(spark, folder).where("detector IS NOT NULL AND similarity IS NOT NULL AND NOT isnan(similarity) AND s1 <= e1 AND s2 <= e2")
    return report.match_json(m, ["match_id"])


@query(
    "graph_json",
    REPORTED
    + """, n AS (SELECT workspace_id, string_agg('{"id":' || to_json(submission)::VARCHAR || ',"label":' || to_json(submission)::VARCHAR || ',"score":' || percentage || ',"group":' || bucket || '}', ',' ORDER BY encode(submission)) AS j FROM sb GROUP BY 1),
e AS (SELECT workspace_id, least(submission, other) AS a, greatest(submission, other) AS b, floor(max(score) * 100 + 0.5)::INT AS p FROM sp GROUP BY ALL HAVING max(score) >= 0),
m AS (SELECT workspace_id, string_agg('{"from":' || to_json(a)::VARCHAR || ',"to":' || to_json(b)::VARCHAR || ',"score":' || p || ',"group":' || CASE WHEN p <= 0 THEN 0 ELSE least(9, p // 10) END || '}', ',' ORDER BY encode(a), encode(b)) AS j FROM e GROUP BY 1)
SELECT n.workspace_id, '{"nodes":[' || n.j || '],"matches":[' || coalesce(m.j, '') || ']}' AS json FROM n LEFT JOIN m ON m.workspace_id IS NOT DISTINCT FROM n.workspace_id""",
)
def graph_json(spark, folder):
    scores = report.submission_scores(_overall(spark, folder), _sub_files(spark, folder))
    return report.graph_json(scores, report.network_edges(report.submission_pairs(_overall(spark, folder), _sub_files(spark, folder))))


@query(
    "line_json",
    f"""WITH {BLOCKS}, l AS (SELECT file_id, block_id, r.start_line AS s, r.end_line AS e, unnest(range(r.start_line, r.end_line + 1)) AS line FROM (SELECT block_id, file_id, unnest(ranges) AS r FROM bb)),
o AS (SELECT file_id, line::VARCHAR AS line, list(block_id ORDER BY s, e, block_id) AS a, first(block_id ORDER BY s DESC, e, block_id) AS v FROM l GROUP BY ALL)
SELECT file_id, '{{"visible":{{' || string_agg('"' || line || '":' || v, ',' ORDER BY line) || '}},"all":{{' || string_agg('"' || line || '":[' || array_to_string(a, ',') || ']', ',' ORDER BY line) || '}}}}' AS json FROM o GROUP BY file_id""",
)
def line_json(spark, folder):
    return report.line_json(_coverage(spark, folder), ["file_id"])


# The whole job


@query("job_scores")
def job_scores(spark, folder):
    """Scores of all files against all, by all detectors."""
    return job.run_job(table(spark, folder, "files").drop("loaded_at"), table(spark, folder, "workspaces")).file_scores


@query("job_overall")
def job_overall(spark, folder):
    """The highest score of every file, by all detectors."""
    return job.run_job(table(spark, folder, "files").drop("loaded_at"), table(spark, folder, "workspaces")).file_overall
