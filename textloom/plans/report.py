"""Reports over scores, groups of blocks and files. All are lazy tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.columns import bucket, percent, range_lines, text_lines

DELETED = "Deleted"
#: Score from which a submission counts as of low, medium, high and severe similarity.
LEVELS = (0.01, 0.05, 0.2, 0.5)


def overall(scores: DataFrame) -> DataFrame:
    """(file_id, other_file_id, score): the highest overall score of each directed pair, in 0..1; null, NaN and other scores, and null
    others, count nowhere."""
    clean = scores.where("detector IS NULL AND other_file_id IS NOT NULL AND file_id IS NOT NULL AND other_file_id <> file_id AND score BETWEEN 0 AND 1")
    return clean.groupBy("file_id", "other_file_id").agg(F.max("score").alias("score"))


def submission_of(files: DataFrame) -> DataFrame:
    """(file_id, workspace_id, submission) of the files that have a submission, one row each."""
    return files.where("file_id IS NOT NULL AND submission IS NOT NULL").groupBy("file_id").agg(F.min(F.struct("workspace_id", "submission")).alias("x")).select("file_id", F.col("x.workspace_id").alias("workspace_id"), F.col("x.submission").alias("submission"))


def submission_scores(pairs: DataFrame, files: DataFrame) -> DataFrame:
    """(workspace_id, submission, score, percentage, bucket, level): the highest score of its files; files without any have 0."""
    best = pairs.groupBy("file_id").agg(F.max("score").alias("score"))
    s = submission_of(files).join(best, "file_id", "left").groupBy("workspace_id", "submission").agg(F.coalesce(F.max("score"), F.lit(0.0)).cast("double").alias("score"))
    level = F.lit(0)
    for n, least in enumerate(LEVELS, 1):
        level = F.when(F.col("score") >= least, n).otherwise(level)
    return s.select("workspace_id", "submission", "score", percent("score").alias("percentage"), bucket(percent("score")).alias("bucket"), level.alias("level"))


def submission_pairs(pairs: DataFrame, files: DataFrame) -> DataFrame:
    """(workspace_id, submission, other, score, n_file_pairs): the highest score of a file of the one against a file of the other, of the
    same workspace. Directed, as the scores are."""
    s = submission_of(files)
    one = s.select("file_id", "workspace_id", "submission")
    two = s.select(F.col("file_id").alias("other_file_id"), F.col("workspace_id").alias("_w"), F.col("submission").alias("other"))
    both = pairs.join(one, "file_id").join(two, "other_file_id").where("workspace_id = _w AND submission <> other")
    return both.groupBy("workspace_id", "submission", "other").agg(F.max("score").cast("double").alias("score"), F.count("*").alias("n_file_pairs"))


def file_matches(pairs: DataFrame, files: DataFrame, cutoff: float = 0.0) -> DataFrame:
    """File pairs of different submissions of a workspace with a score above 0 and of ``cutoff`` or more."""
    s = submission_of(files)
    two = s.select(F.col("file_id").alias("other_file_id"), F.col("workspace_id").alias("_w"), F.col("submission").alias("other"))
    both = pairs.where(F.col("score") > 0).where(F.col("score") >= cutoff).join(s, "file_id").join(two, "other_file_id").where("workspace_id = _w AND submission <> other")
    return both.select("workspace_id", "submission", "other", "file_id", "other_file_id", "score")


def histogram(scores: DataFrame) -> DataFrame:
    """(workspace_id, bucket, n): how many submissions of a workspace are in each of ten buckets; empty ones too."""
    all_ = scores.select("workspace_id").distinct().withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(9))))
    n = scores.groupBy("workspace_id", "bucket").agg(F.count("*").alias("n"))
    # null workspaces are one of their own
    return all_.join(n, (all_.workspace_id.eqNullSafe(n.workspace_id)) & (all_.bucket == n.bucket), "left").select(all_.workspace_id, all_.bucket, F.coalesce("n", F.lit(0)).alias("n"))


def ranked(df: DataFrame, by: list[str], score: str, ties: list[str], out: str = "place") -> DataFrame:
    """Adds the place by falling score, nulls last, ties by the given columns."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(F.desc_nulls_last(score), *ties)))


def network_edges(pairs: DataFrame, cutoff: float = 0.0) -> DataFrame:
    """(workspace_id, a, b, score), a < b: undirected links of submissions with the higher of both scores."""
    p = pairs.select("workspace_id", F.least("submission", "other").alias("a"), F.greatest("submission", "other").alias("b"), "score")
    return p.groupBy("workspace_id", "a", "b").agg(F.max("score").alias("score")).where(F.col("score") >= cutoff)


def with_names(df: DataFrame, id: str, names: DataFrame, out: str = "name") -> DataFrame:
    """Adds the name (names: id, name) of an id, or DELETED where it is gone."""
    return df.join(names.select(F.col("id").alias(id), F.col("name").alias(out)), id, "left").withColumn(out, F.coalesce(out, F.lit(DELETED)))


def comparison(blocks: DataFrame, files: DataFrame) -> DataFrame:
    """(workspace_id, submission, other, group_id, n_blocks), submission < other: groups that both have blocks in."""
    b = blocks.join(submission_of(files), "file_id").groupBy("workspace_id", "group_id", "submission").agg(F.count("*").alias("n"))
    o = b.select(F.col("workspace_id").alias("_w"), F.col("group_id").alias("_g"), F.col("submission").alias("other"), F.col("n").alias("_n"))
    both = b.join(o, (F.col("workspace_id") == F.col("_w")) & (F.col("group_id") == F.col("_g"))).where("submission < other")
    return both.select("workspace_id", "submission", "other", "group_id", (F.col("n") + F.col("_n")).alias("n_blocks"))


def submission_report(blocks: DataFrame, files: DataFrame) -> DataFrame:
    """(workspace_id, submission, n_groups, n_others): groups a submission has blocks in, and other submissions in them."""
    b = blocks.join(submission_of(files), "file_id").select("workspace_id", "submission", "group_id").distinct()
    o = b.select(F.col("workspace_id").alias("_w"), F.col("group_id").alias("_g"), F.col("submission").alias("other"))
    both = b.join(o, (F.col("workspace_id") == F.col("_w")) & (F.col("group_id") == F.col("_g")))
    return both.groupBy("workspace_id", "submission").agg(F.countDistinct("group_id").alias("n_groups"), (F.countDistinct("other") - 1).alias("n_others"))


def line_coverage(spans: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, line, visible, active, all): of spans (keys, match, start, end) the one on top at each line, how many there are, and
    the matches of all of them, as they begin, end and by match.

    On top is the one that began last, of those the one that ends first, then the smallest match. Empty spans count nowhere.
    """
    lines = spans.where("start <= end").select(*keys, "match", "start", "end", F.explode(F.sequence("start", "end")).alias("line"))
    top = F.min(F.struct((-F.col("start")).alias("begin"), "end", "match"))
    every = F.array_sort(F.collect_list(F.struct("start", "end", "match")))["match"]
    return lines.groupBy(*keys, "line").agg(top.alias("top"), F.count("*").alias("active"), every.alias("all")).select(*keys, "line", F.col("top.match").alias("visible"), "active", "all")


def without_inside(spans: DataFrame, inside: str) -> DataFrame:
    """Spans cut into what lies around the given code within them (``inside``: ranges in order)."""
    edges = F.concat(F.array(F.struct(F.lit(0).alias("start"), (F.col("start") - 1).alias("end"))), F.coalesce(inside, F.array().cast("array<struct<start:int,end:int>>")), F.array(F.struct((F.col("end") + 1).alias("start"), F.lit(2**31 - 1).alias("end"))))
    gaps = F.transform(F.sequence(F.lit(0), F.size("_e") - 2), lambda i: F.struct((F.get("_e", i)["end"] + 1).alias("start"), (F.get("_e", i + 1)["start"] - 1).alias("end")))
    rest = [c for c in spans.columns if c not in ("start", "end", inside)]
    return spans.withColumn("_e", edges).withColumn("_g", F.explode(gaps)).select(*rest, F.col("_g.start").alias("start"), F.col("_g.end").alias("end")).where("start <= end")


def context(blocks: DataFrame, files: DataFrame, around: int = 5) -> DataFrame:
    """Each range of a block with its lines and ``around`` lines before and after: (…, first_line, lines)."""
    texts = files.where("content IS NOT NULL").groupBy("file_id").agg(F.min("content").alias("content")).select("file_id", text_lines("content").alias("_l"))
    b = blocks.withColumn("_r", F.explode("ranges")).join(texts, "file_id")
    first = F.greatest(F.lit(1), F.col("_r.start_line") - around)
    last = F.least(F.size("_l"), F.col("_r.end_line") + around)
    return b.select(*[c for c in blocks.columns if c != "ranges"], F.col("_r.start_line").alias("start_line"), F.col("_r.end_line").alias("end_line"), first.alias("first_line"), F.slice("_l", first, F.greatest(last - first + 1, F.lit(0))).alias("lines"))


def block_lines(blocks: DataFrame) -> DataFrame:
    """(block_id, file_id, lines): the different lines of a block."""
    return blocks.select("block_id", "file_id", range_lines("ranges").alias("lines"))


def numbered(matches: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Adds ``match_id`` from 0 and one of 45 hues in turn."""
    n = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1
    return matches.withColumn("match_id", n).withColumn("hue", (F.col("match_id") % 45) * 8)


def graph_json(scores: DataFrame, edges: DataFrame, key: str = "workspace_id") -> DataFrame:
    """(key, json): nodes and links of each workspace as one text: {nodes: [{id, label, score, group}], matches: [{from, to, score, group}]}."""
    n = scores.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col("submission").alias("id"), F.col("submission").alias("label"), F.col("percentage").alias("score"), F.col("bucket").alias("group")))).alias("nodes"))
    m = edges.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col("a").alias("from"), F.col("b").alias("to"), percent("score").alias("score"), bucket(percent("score")).alias("group")))).alias("matches"))
    j = n.join(m, key, "left")
    return j.select(key, F.to_json(F.struct("nodes", F.coalesce("matches", F.array().cast("array<struct<from:string,to:string,score:int,group:int>>")).alias("matches"))).alias("json"))


def match_json(matches: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, json): each match with its reason, score and the lines on both sides."""
    line = lambda k: F.when(F.col(f"s{k}") <= F.col(f"e{k}"), F.sequence(f"s{k}", f"e{k}"))
    return matches.select(*keys, F.to_json(F.struct(F.col("detector").alias("reason"), percent("similarity").alias("score"), line(1).alias("lines1"), line(2).alias("lines2"))).alias("json"))


def line_json(coverage: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, json): {visible: {line: match}, all: {line: [match, ...]}} of each file."""
    entries = lambda c: F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("line").cast("string"), c)))).alias(c)
    return coverage.groupBy(*keys).agg(F.to_json(F.struct(entries("visible"), entries("all"))).alias("json"))


def statistics(workspaces: DataFrame, files: DataFrame) -> DataFrame:
    """One row: n_workspaces, n_submissions, n_files."""
    w = workspaces.select("workspace_id").distinct().agg(F.count("workspace_id").alias("n_workspaces"))
    f = files.where("file_id IS NOT NULL").select("file_id", "workspace_id", "submission").agg(F.countDistinct("workspace_id", "submission").alias("n_submissions"), F.countDistinct("file_id").alias("n_files"))
    # two tables of one row each
    return w.withColumn("_k", F.lit(1)).join(f.withColumn("_k", F.lit(1)), "_k").drop("_k")


def html_report(rows: list[dict], title: str = "Report") -> str:
    """A page with the blocks of a bounded report (rows as ``context`` makes them), for the driver to write."""
    from html import escape

    parts = [f"<html><head><title>{escape(title)}</title></head><body><h1>{escape(title)}</h1>"]
    for r in rows:
        body = "\n".join(f"{r['first_line'] + i:5d}  {x}" for i, x in enumerate(r["lines"]))
        parts.append(f"<h2>{escape(str(r.get('file_id')))}: {r['start_line']}–{r['end_line']}</h2><pre>{escape(body)}</pre>")
    return "\n".join([*parts, "</body></html>"])


def at_least(score: Column, percentage: int) -> Column:
    """Whether the whole part of the percentage reaches the threshold of a report."""
    return F.floor(score.cast("double") * 100) >= percentage
