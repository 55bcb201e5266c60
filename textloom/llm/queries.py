"""Queries of the operators for training data, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import components as cc
from textloom.llm import leaks as lk
from textloom.llm import mixing, near, prose, spans, syntax, topn
from textloom.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


# 4: top N items within every group

TOP = """
WITH p AS (SELECT file_id, other_file_id, max(score::DOUBLE) AS score FROM file_scores
  WHERE score IS NOT NULL AND NOT isnan(score) AND score BETWEEN 0 AND 1 AND other_file_id IS NOT NULL AND other_file_id <> file_id GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY score DESC, other_file_id) AS rank FROM p)
"""


def _top_files(spark, folder, n=5):
    rows = table(spark, folder, "file_scores").where("score BETWEEN 0 AND 1 AND other_file_id <> file_id")
    return topn.top_n(rows, "file_id", "other_file_id", "score", n)


@query("p4_found", TOP + "SELECT file_id, other_file_id FROM r WHERE rank <= 5")
def p4_found(spark, folder):
    return _top_files(spark, folder).select("file_id", "other_file_id")


@query("p4_ranked", TOP + "SELECT file_id, other_file_id, score, rank FROM r WHERE rank <= 20")
def p4_ranked(spark, folder):
    return _top_files(spark, folder, 20)


# 6: pairwise matches to groups


def _block_groups(spark, folder):
    blocks = table(spark, folder, "blocks").select("block_id").where("block_id IS NOT NULL").distinct()
    links = table(spark, folder, "matches").select("block1_id", "block2_id").where("block1_id <> block2_id").distinct()
    links = links.join(blocks.withColumnRenamed("block_id", "block1_id"), "block1_id", "left_semi").join(blocks.withColumnRenamed("block_id", "block2_id"), "block2_id", "left_semi")
    return cc.components(links, "block1_id", "block2_id")


GROUPS = """
WITH RECURSIVE l AS (SELECT DISTINCT block1_id AS a, block2_id AS b FROM matches WHERE block1_id <> block2_id
  AND block1_id IN (SELECT block_id FROM blocks) AND block2_id IN (SELECT block_id FROM blocks)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT a AS id, a AS m FROM e UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.m),
g AS (SELECT id AS block_id, min(m) AS group_id FROM r GROUP BY id)
"""


@query("p6_found", GROUPS + "SELECT block_id, group_id FROM g")
def p6_found(spark, folder):
    return _block_groups(spark, folder).select(F.col("id").alias("block_id"), "group_id")


@query(
    "p6_files",
    GROUPS
    + """, f AS (SELECT block_id, min(file_id) AS file_id FROM blocks GROUP BY block_id),
s AS (SELECT group_id, count(*) AS n_blocks, count(DISTINCT file_id) AS n_files FROM g JOIN f USING (block_id) GROUP BY group_id)
SELECT block_id, file_id, group_id, n_blocks, n_files FROM g JOIN f USING (block_id) JOIN s USING (group_id)""",
)
def p6_files(spark, folder):
    """Each matched block's file with the block's group and the numbers of blocks and files of that group."""
    groups = _block_groups(spark, folder).withColumnRenamed("id", "block_id")
    files = table(spark, folder, "blocks").groupBy("block_id").agg(F.min("file_id").alias("file_id"))
    rows = groups.join(files, "block_id")
    sizes = rows.groupBy("group_id").agg(F.count("*").alias("n_blocks"), F.countDistinct("file_id").alias("n_files"))
    return rows.join(sizes, "group_id").select("block_id", "file_id", "group_id", "n_blocks", "n_files")


# 1: near-duplicate records with small edits


def _near_files(spark, folder, **options):
    return near.near(table(spark, folder, "files"), **options)


RESEMBLING = r"""
WITH f AS (SELECT file_id, any_value(workspace_id) AS w, regexp_extract_all(any_value(content), '[A-Za-z0-9_]+|[^\sA-Za-z0-9_]') AS t FROM files WHERE content IS NOT NULL AND workspace_id IS NOT NULL GROUP BY file_id),
s AS (SELECT DISTINCT w, file_id, unnest(list_transform(range(1, len(t) - 3), lambda i: array_to_string(t[i:i + 4], ' '))) AS s FROM f WHERE len(t) >= 5),
n AS (SELECT file_id, count(*) AS n FROM s GROUP BY file_id),
c AS (SELECT a.file_id AS a, b.file_id AS b, count(*) AS c FROM s a JOIN s b ON a.w = b.w AND a.s = b.s AND a.file_id < b.file_id GROUP BY ALL)
SELECT a AS file_id_a, b AS file_id_b FROM c JOIN n x ON x.file_id = a JOIN n y ON y.file_id = b WHERE c.c >= 0.5 * (x.n + y.n - c.c)
"""


@query("p1_found", RESEMBLING)
def p1_found(spark, folder):
    return _near_files(spark, folder).pairs().select(F.col("a").alias("file_id_a"), F.col("b").alias("file_id_b"))


_ALIKE = RESEMBLING.rsplit("SELECT a AS file_id_a", 1)[0]


@query(
    "p1_groups",
    _ALIKE.replace("WITH f AS", "WITH RECURSIVE f AS")
    + """, sig AS (SELECT w, file_id, md5(string_agg(s, chr(10) ORDER BY s)) AS sig FROM s GROUP BY ALL), cls AS (SELECT w, file_id, min(file_id) OVER (PARTITION BY w, sig) AS rep FROM sig),
e AS (SELECT DISTINCT x.rep AS a, y.rep AS b FROM (SELECT c.a, c.b FROM c JOIN n x ON x.file_id = a JOIN n y ON y.file_id = b WHERE c.c >= 0.5 * (x.n + y.n - c.c)) p JOIN cls x ON x.file_id = p.a JOIN cls y ON y.file_id = p.b WHERE x.rep <> y.rep),
e2 AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT rep AS a, rep AS b FROM cls UNION SELECT r.a, e2.b FROM r JOIN e2 ON e2.a = r.b),
k AS (SELECT a AS rep, min(b) AS class_id FROM r GROUP BY a), l AS (SELECT a AS rep, count(*) AS n_links FROM e2 GROUP BY a),
m AS (SELECT cls.file_id, cls.w AS workspace_id, class_id, coalesce(n_links, 0) AS n_links FROM cls JOIN k USING (rep) LEFT JOIN l USING (rep)),
bl AS (SELECT block_id, any_value(file_id) AS file_id, any_value(score) AS score FROM blocks GROUP BY block_id),
ms AS (SELECT class_id, round(avg(score::DOUBLE), 6) AS mean_block_score FROM m JOIN bl USING (file_id) WHERE score IS NOT NULL AND NOT isnan(score) GROUP BY class_id)
SELECT file_id, workspace_id, class_id, n_links, mean_block_score FROM m LEFT JOIN ms USING (class_id)""",
)
def p1_groups(spark, folder):
    """One row for each file with shingles: its class, its links to other classes, and the class's mean block score."""
    blocks = table(spark, folder, "blocks").groupBy("block_id").agg(F.min(F.struct("file_id", "score")).alias("x")).select(F.col("x.file_id").alias("id"), F.col("x.score").cast("double").alias("score"))
    out = near.member_means(_near_files(spark, folder).groups(), blocks, F.col("score"))
    return out.select(F.col("id").alias("file_id"), F.col("grp").alias("workspace_id"), "class_id", "n_links", F.round("mean_score", 6).alias("mean_block_score"))


@query("p1_weighted")
def p1_weighted(spark, folder):
    """Classes of files by the probability Jaccard of shingles weighted by how often they stand in a file."""
    out = _near_files(spark, folder, weighted=True).groups()
    return out.select(F.col("id").alias("file_id"), F.col("grp").alias("workspace_id"), "class_id", "n_links")


# 3: long exact spans shared between records


SPANS = r"""
WITH f AS (SELECT file_id, string_split(regexp_replace(replace(any_value(content), chr(13) || chr(10), chr(10)), '\n$', ''), chr(10)) AS l FROM files WHERE content IS NOT NULL AND content <> '' GROUP BY file_id),
w AS (SELECT file_id, unnest(range(1, len(l) - 6)) AS i, unnest(list_transform(range(1, len(l) - 6), lambda i: array_to_string(l[i:i + 7], chr(10)))) AS t FROM f WHERE len(l) >= 8),
h AS (SELECT t FROM w GROUP BY t HAVING count(DISTINCT file_id) > 1),
c AS (SELECT DISTINCT file_id, unnest(range(i, i + 8)) AS line FROM w JOIN h USING (t)),
g AS (SELECT file_id, line, line - row_number() OVER (PARTITION BY file_id ORDER BY line) AS run FROM c)
SELECT file_id, min(line)::INT AS start_line, max(line)::INT AS end_line FROM g GROUP BY file_id, run
"""


@query("p3_found", SPANS)
def p3_found(spark, folder):
    return spans.shared_spans(table(spark, folder, "files"))


@query(
    "p3_shares",
    SPANS.rsplit("SELECT file_id, min(line)", 1)[0].replace("WITH f AS", "WITH RECURSIVE f AS")
    + r"""SELECT file_id, coalesce(n_lines, 0)::INT AS n_lines, coalesce(shared, 0)::INT AS shared_lines, CASE WHEN n_lines > 0 THEN coalesce(shared, 0) / n_lines ELSE 0 END AS share, coalesce(cluster_id, file_id) AS cluster_id
FROM (SELECT DISTINCT file_id FROM files WHERE content IS NOT NULL AND file_id IS NOT NULL) LEFT JOIN (SELECT file_id, len(l) AS n_lines FROM f) USING (file_id) LEFT JOIN (SELECT file_id, count(*) AS shared FROM c GROUP BY file_id) USING (file_id)
LEFT JOIN (WITH RECURSIVE e AS (SELECT DISTINCT file_id AS a, min(file_id) OVER (PARTITION BY t) AS b FROM w JOIN h USING (t)), e2 AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT a, b FROM e2 UNION SELECT r.a, e2.b FROM r JOIN e2 ON e2.a = r.b)
  SELECT a AS file_id, min(b) AS cluster_id FROM r GROUP BY a) USING (file_id)""",
)
def p3_shares(spark, folder):
    return spans.shared_parts(table(spark, folder, "files"))


# 7: evaluation texts leaking into training text


LEAKED = """
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents WHERE text IS NOT NULL), b AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM benchmark WHERE text IS NOT NULL),
x AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i + 11], ' '))) AS g FROM d WHERE len(w) >= 12),
y AS (SELECT item_id, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i + 11], ' '))) AS g FROM b WHERE len(w) >= 12)
"""


@query("p7_found", LEAKED + "SELECT DISTINCT doc_id, item_id FROM x JOIN y USING (g)")
def p7_found(spark, folder):
    return lk.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark")).select("doc_id", "item_id")


ALIGNED = """
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents WHERE text IS NOT NULL), b AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM benchmark WHERE text IS NOT NULL),
x AS (SELECT doc_id, unnest(range(1, len(w) - 3)) AS i, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS g FROM d WHERE len(w) >= 5),
y AS (SELECT item_id, unnest(range(1, len(w) - 3)) AS j, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS g FROM b WHERE len(w) >= 5),
a AS (SELECT DISTINCT doc_id, item_id, i - j AS shift FROM x JOIN y USING (g)),
p AS (SELECT a.*, d.w AS dw, b.w AS bw, greatest(1, 1 + shift) AS lo, least(len(d.w), len(b.w) + shift) AS hi FROM a JOIN d USING (doc_id) JOIN b USING (item_id) WHERE least(len(d.w), len(b.w) + shift) - greatest(1, 1 + shift) + 1 >= {0}),
e AS (SELECT doc_id, item_id, list_concat(list_concat([lo - 1], list_filter(range(lo, hi + 1), lambda i: dw[i] <> bw[i - shift])), [hi + 1]) AS e FROM p),
k AS (SELECT doc_id, item_id, e, unnest(range(1, len(e))) AS k FROM e),
r AS (SELECT doc_id, item_id, e[k] + 1 AS doc_word, e[least(k + {1} + 1, len(e))] - e[k] - 1 AS words, least(k + {1} + 1, len(e)) - k - 1 AS differing FROM k),
best AS (SELECT doc_id, item_id, min((-words, differing, doc_word)) AS m FROM r WHERE words >= {0} GROUP BY ALL)
"""


@query("p7_tolerant", ALIGNED.format(16, 2) + "SELECT doc_id, item_id, m[3] AS doc_word, -m[1] AS words, m[2] AS differing FROM best")
def p7_tolerant(spark, folder):
    """Passages of 16 words or more of which up to two were replaced, with their place and length in the document."""
    return lk.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"), least=16, errors=2)


@query(
    "p7_items",
    ALIGNED.format(12, 0) + "SELECT item_id, coalesce(n_docs, 0) AS n_docs, coalesce(longest, 0) AS longest FROM (SELECT DISTINCT item_id FROM benchmark) LEFT JOIN (SELECT item_id, count(*) AS n_docs, max(-m[1]) AS longest FROM best GROUP BY item_id) USING (item_id)",
)
def p7_items(spark, folder):
    """For each held-out item the number of documents it leaked into and the longest passage; items that didn't leak have 0."""
    found = lk.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark")).groupBy("item_id").agg(F.count("*").alias("n_docs"), F.max("words").alias("longest"))
    items = table(spark, folder, "benchmark").select("item_id").distinct()
    return items.join(found, "item_id", "left").select("item_id", F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.coalesce("longest", F.lit(0)).alias("longest"))


# 2: source files that do not parse


def _parsed(spark, folder):
    return syntax.parse_files(table(spark, folder, "files"), table(spark, folder, "workspaces"))


@query("p2_found")
def p2_found(spark, folder):
    return _parsed(spark, folder).where("NOT valid").select("file_id")


@query("p2_rates")
def p2_rates(spark, folder):
    """The rate of invalid files of each workspace and language."""
    return syntax.rates(_parsed(spark, folder), "workspace_id", "lang")


@query("p2_causes")
def p2_causes(spark, folder):
    """How many invalid files of each language have which first cause, and how many errors they have."""
    bad = _parsed(spark, folder).where("NOT valid")
    return bad.groupBy("lang", F.col("first_want").alias("wanted")).agg(F.count("*").alias("n_files"), F.sum("n_errors").alias("n_errors"))


# 8: mixing sources to target weights


@query("p8_corpus")
def p8_corpus(spark, folder):
    return mixing.Mix(table(spark, folder, "documents"), table(spark, folder, "mix_targets")).corpus()


@query("p8_shares")
def p8_shares(spark, folder):
    return mixing.Mix(table(spark, folder, "documents"), table(spark, folder, "mix_targets")).shares()


# 9: text quality


@query("p9_found")
def p9_found(spark, folder):
    return prose.quality(table(spark, folder, "documents")).where("NOT is_prose").select("doc_id")


@query("p9_stats")
def p9_stats(spark, folder):
    return prose.quality(table(spark, folder, "documents"))
