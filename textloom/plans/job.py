"""From the files of workspaces to scores: one plan over all workspaces at once."""

from __future__ import annotations

from collections.abc import Callable
from copy import copy
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.columns import display_name, language_key, line_count
from textloom.operators import grouping, ngram, pairs, preprocess, scoring, skeleton, structure
from textloom.plans.registry import SAME_NAME, DetectorSpec, ParamSpec, Registry, Template
from textloom.session import Stash, tasks


class Context:
    """What the detectors of a job read; each artifact is made once. ``trees`` says whether any of them reads trees."""

    def __init__(self, files: DataFrame, workspaces: DataFrame, trees: bool = True, registry: Registry | None = None):
        self.trees = trees
        self.registry = registry or REGISTRY
        self.spark: SparkSession = files.sparkSession
        self.stash = Stash(self.spark)
        lang = workspaces.where("workspace_id IS NOT NULL AND lang IS NOT NULL").groupBy("workspace_id").agg(F.min(language_key("lang")).alias("lang"))
        # partitioned once, by the key of what follows; a number of tasks that Spark doesn't merge by size, for the parsers' sake
        parted = (files.drop("lang") if "lang" in files.columns else files).repartition(tasks(self.spark), "file_id")
        clean = pairs.one_row_per_file(parted).where("content IS NOT NULL AND workspace_id IS NOT NULL")
        self.files = clean.join(lang, "workspace_id").withColumn("n_lines", line_count("content"))
        self.tree_values = TREES.values()

    @cached_property
    def names(self) -> DataFrame:
        return self.files.select("file_id", display_name("filename", "extension").alias("name"))

    @cached_property
    def skeleton_files(self) -> DataFrame:
        return self.files.where(F.col("submission") == skeleton.SKELETON).select(F.col("file_id").alias("file"))

    @cached_property
    def texts(self) -> DataFrame:
        return self.stash.keep(self._lexed())

    @cached_property
    def parsed(self) -> DataFrame:
        return self.stash.keep(self._trees())

    @cached_property
    def packed(self) -> DataFrame:
        """Trees as the parameters of their detector (``tree_values``) need them, and declarations."""
        return self.stash.keep(self._packed())

    def _packed(self) -> DataFrame:
        return structure.parse_packed(self.files, bool(self.tree_values["ABSTRACT_MATCHING"]), int(self.tree_values["MIN_HEIGHT"]))

    def _lexed(self) -> DataFrame:
        keys = {"id": F.col("file_id").cast("long"), "grp": F.col("workspace_id").cast("long"), "sub": pairs.submission_key()}
        return preprocess.file_lines(self.files, keys, "id long, grp long, sub string")

    def _trees(self) -> DataFrame:
        return structure.parse(self.files, with_nodes=self.trees)

    @cached_property
    def declared(self) -> DataFrame:
        return self.stash.keep(structure.variables(self.packed if self.trees else self.parsed, self.files))

    @cached_property
    def file_counts(self) -> DataFrame:
        """Files of each workspace, given code too."""
        return self.files.groupBy(F.col("workspace_id").cast("long").alias("grp")).agg(F.count("*").alias("n_files"))

    @cached_property
    def by_name(self) -> "Context":
        """The same files, those of one name in a workspace as a group of their own: detectors that run over it only ever pair files of
        the same name. Files without a name are in no group."""
        named = self.files.join(self.names.where("name IS NOT NULL"), "file_id")
        named = named.withColumn("workspace_id", F.xxhash64("workspace_id", "name")).drop("name")
        groups = named.select(F.col("file_id").cast("long").alias("id"), F.col("workspace_id").alias("grp"))
        out = copy(self)
        out.files = named
        for name in ("names", "skeleton_files", "texts", "parsed", "packed", "declared", "file_counts", "by_name"):
            out.__dict__.pop(name, None)
        out._lexed = lambda: self.texts.drop("grp").join(groups, "id").select("id", "grp", "sub", "lines")
        out._trees = lambda: self.parsed.join(groups.select(F.col("id").alias("file_id")), "file_id", "left_semi")
        out._packed = lambda: self.packed.drop("grp").join(groups.withColumnRenamed("id", "file_id"), "file_id").select(*self.packed.columns)
        return out

    def artifact(self, group: str) -> DataFrame:
        """(file_id, lang, n, value): what the makers of a group that the registry has make of the files."""
        return structure.artifacts(self.files, self.registry.artifacts.get(group, {}))

    def detect(self, run: Callable[["Context", dict], DataFrame], params: dict) -> DataFrame:
        """Matches of a detector; with ``matchByFilename`` the name is part of the key on which it joins files."""
        if not params[SAME_NAME.name]:
            return run(self, params)
        own = self.files.select(F.col("file_id").cast("long").alias("file1_id"), F.col("workspace_id").cast("long").alias("grp"))
        return run(self.by_name, params).drop("grp").join(own, "file1_id")


def _ngram_run(ctx: Context, p: dict) -> DataFrame:
    return ngram.detect(ctx.texts, int(p["ngram_size"]), int(p["minimum_window"]), p["threshold"])


def _tree_run(ctx: Context, p: dict) -> DataFrame:
    return structure.tree_matches(ctx.packed, ctx.files, int(p["MIN_HEIGHT"]), p["MIN_DICE"], bool(p["ABSTRACT_MATCHING"]))


def _variable_blocks(ctx: Context, p: dict) -> DataFrame:
    """Straight from the declarations: those that another submission has, and for ``matchByFilename`` a file of the same name of it."""
    c = ctx.by_name if p[SAME_NAME.name] else ctx
    d = grouping.shared_declarations(grouping.own_declarations(c.declared, c.skeleton_files))
    if p[SAME_NAME.name]:
        d = d.drop("grp").join(ctx.files.select(F.col("file_id").cast("long").alias("id"), F.col("workspace_id").cast("long").alias("grp")), "id")
    return grouping.variable_groups(d)


REGISTRY = Registry()
NGRAM = REGISTRY.detector(
    DetectorSpec(
        "NGramDetector", "N-Gram Detector",
        (ParamSpec("ngram_size", "N-Gram Size", 8, 1, 10, 1, True), ParamSpec("minimum_window", "Minimum Window", 10, 0, 20, 1, True), ParamSpec("threshold", "Threshold", 0.8, 0, 1, 0.001)),
        ("java", "haskell"), _ngram_run, lambda ctx, m, p: grouping.linked_matches(m, ctx.file_counts, p["common_threshold"], ctx.stash), None,
        (ParamSpec("common_threshold", "Common Threshold", 1.0, 0, 1, 0.001, fixed=False),),
    )
)
VARIABLES = REGISTRY.detector(DetectorSpec("VariableNameDetector", "Variable Name Detector", (), ("java", "haskell"), totals=lambda ctx: grouping.variable_totals(ctx.declared), blocks=_variable_blocks))
TREES = REGISTRY.detector(
    DetectorSpec(
        "ASTDetector", "AST Detector",
        (ParamSpec("MIN_HEIGHT", "Minimum Height", 5, 1, 10, 1, True), ParamSpec("MIN_DICE", "Minimum Dice", 0.8, 0, 1, 0.05), ParamSpec("ABSTRACT_MATCHING", "Abstract Matching", 1, 0, 1, 1, True)),
        ("java", "haskell"), _tree_run, lambda ctx, m, p: grouping.tree_groups(m), lambda ctx: ctx.packed.select(F.lit("ASTDetector").alias("detector"), "file_id", "total"),
    )
)
for _language, _parse in structure.PARSERS.items():
    REGISTRY.artifact("tree", _language, _parse)


@dataclass
class JobConfig:
    """Which detectors to run, with which values of their parameters; values out of range fall back to the default."""

    detectors: dict[str, dict[str, float]] = field(default_factory=lambda: {"NGramDetector": {}, "VariableNameDetector": {}, "ASTDetector": {}})
    priority: str = "DEFAULT"

    @classmethod
    def of(cls, template: Template) -> "JobConfig":
        return cls({k: dict(v) for k, v in template.detectors.items()})


@dataclass
class JobResult:
    """Lazy tables of a job; matches and blocks, where they are asked for, are stored, so that reports don't detect again."""

    files: DataFrame
    matches: DataFrame
    blocks: DataFrame
    totals: DataFrame
    file_scores: DataFrame
    file_overall: DataFrame
    status: str = "COMPLETE"


MATCH_COLUMNS = "detector string, grp long, file1_id long, file2_id long, match_ix int, s1 int, e1 int, s2 int, e2 int, similarity float, string string, weight1 int, weight2 int"


def detect(ctx: Context, config: JobConfig, registry: Registry = REGISTRY) -> DataFrame:
    """Matches of all detectors that make matches, in one table."""
    out = ctx.spark.createDataFrame([], MATCH_COLUMNS)
    for name, given in config.detectors.items():
        spec = registry.detectors[name]
        if spec.blocks:
            continue
        params = spec.values(given)
        m = ctx.detect(spec.run, params)
        have = set(m.columns)
        cols = [F.lit(name).alias("detector")]
        for f in MATCH_COLUMNS.split(", ")[1:]:
            column, kind = f.split()
            cols.append((F.col(column) if column in have else F.lit(None)).cast(kind).alias(column))
        out = out.unionByName(m.select(*cols))
    return out


class Job(JobResult):
    """Tables that are made once they are asked for. Scores don't need stored matches: where none were made, files are compared in
    blocks, of which only scores are rows."""

    def __init__(self, ctx: Context, config: JobConfig, registry: Registry):
        self.ctx, self.config, self.registry, self.status = ctx, config, registry, "COMPLETE"
        self.files = ctx.files.join(ctx.skeleton_files.withColumnRenamed("file", "file_id"), "file_id", "left_anti")

    def _made(self) -> tuple[DataFrame, DataFrame, DataFrame | None]:
        """The matches, blocks and totals of all detectors."""
        ctx, stash, config = self.ctx, self.ctx.stash, self.config
        found = stash.keep(detect(ctx, config, self.registry))
        own = stash.keep(skeleton.without_skeleton(found, ctx.skeleton_files, ["detector"]))
        stash.drop(found)
        blocks = totals = None
        for name, given in config.detectors.items():
            spec = self.registry.detectors[name]
            b = spec.blocks(ctx, spec.values(given)) if spec.blocks else spec.group(ctx, own.where(F.col("detector") == name), spec.values(given))
            blocks = b if blocks is None else blocks.unionByName(b)
            if spec.totals:
                t = spec.totals(ctx)
                totals = t if totals is None else totals.unionByName(t)
        made = stash.keep(blocks)
        blocks = stash.keep(grouping.populated(made))
        stash.drop(made)
        return own, blocks, totals

    @cached_property
    def _tables(self) -> tuple[DataFrame, DataFrame, DataFrame | None]:
        return self._made()

    matches = property(lambda self: self._tables[0])
    blocks = property(lambda self: self._tables[1])
    totals = property(lambda self: self._tables[2])

    def _group_scores(self, blocks: DataFrame, totals: DataFrame | None) -> DataFrame:
        return scoring.group_scores(blocks, self.ctx.files.select("file_id", F.col("n_lines").alias("line_count")), totals)

    @property
    def _stored(self) -> bool:
        """Whether scores are to come from stored blocks: they are there, or detectors of others may have groups of any kind."""
        return "_tables" in self.__dict__ or any(self.registry.detectors[n] is not REGISTRY.detectors.get(n) for n in self.config.detectors)

    def _masks(self, c: Context, files: DataFrame, find: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """(id, mask): given code in files (id, grp, sub), by the matches that a detector finds in pairs with files of given code."""
        given = c.skeleton_files.select(F.col("file").cast("long").alias("_given"))
        pairs_ = given.join(files.select(F.col("id").alias("_given"), "grp", F.col("sub").alias("_sub")), "_given").join(files, "grp").where("sub <> _sub")
        found = find(self.ctx.stash.keep(pairs_.select("grp", F.least("id", "_given").alias("a"), F.greatest("id", "_given").alias("b")).distinct()))
        one, two = (found.join(given.withColumnRenamed("_given", f"file{x}_id"), f"file{x}_id", "left_semi").select(F.col(f"file{y}_id").alias("id"), F.col(f"s{y}").alias("start"), F.col(f"e{y}").alias("end")) for x, y in ((1, 2), (2, 1)))
        return self.ctx.stash.keep(skeleton.masks(one.unionByName(two), ["id"]))

    def _linked(self, p: dict) -> DataFrame:
        """Blocks of n-gram detection, without storing its matches."""
        ctx = self.ctx
        c = ctx.by_name if p[SAME_NAME.name] else ctx
        how = int(p["ngram_size"]), int(p["minimum_window"]), p["threshold"]
        masks = self._masks(c, c.texts.select("id", "grp", "sub"), lambda pairs_: ngram.detect(c.texts, *how, pairs_))
        own = c.texts.join(c.skeleton_files.select(F.col("file").cast("long").alias("id")), "id", "left_anti")
        parts = ngram.links(own, masks, *how)
        if p[SAME_NAME.name]:
            parts = parts.drop("grp").join(ctx.files.select(F.col("file_id").cast("long").alias("file1_id"), F.col("workspace_id").cast("long").alias("grp")), "file1_id")
        return grouping.linked_blocks(parts, ctx.file_counts, p["common_threshold"], ctx.stash)

    @cached_property
    def _items(self) -> tuple[DataFrame, list[str], tuple[str, int, float] | None]:
        """What ``scoring.scores_in_blocks`` gets."""
        ctx, stash = self.ctx, self.ctx.stash
        names = list(self.config.detectors)
        grouped = [n for n in names if n != TREES.name]
        items = ctx.files.select(F.col("file_id").cast("long").alias("id"), F.col("workspace_id").cast("long").alias("grp"))
        items = items.join(ctx.skeleton_files.select(F.col("file").cast("long").alias("id")), "id", "left_anti")
        groups, trees = None, None
        if grouped:
            blocks = totals = None
            for n in grouped:
                spec, p = self.registry.detectors[n], self.registry.detectors[n].values(self.config.detectors[n])
                b = spec.blocks(ctx, p) if spec.blocks else self._linked(p)
                blocks = b if blocks is None else blocks.unionByName(b)
                totals = spec.totals(ctx) if spec.totals else totals
            blocks = stash.keep(grouping.populated(stash.keep(blocks)))
            kind = F.array_position(F.array(*map(F.lit, names)), F.col("detector")).cast("int") - 1
            groups = self._group_scores(blocks, totals).groupBy(F.col("file_id").cast("long").alias("id")).agg(F.collect_list(F.struct(kind.alias("detector"), "group_id", "score")).alias("groups"))
            items = items.join(groups, "id", "left")
        else:
            items = items.withColumn("groups", F.lit(None).cast("array<struct<detector:int,group_id:long,score:double>>"))
        if TREES.name in names:
            p = TREES.values(self.config.detectors[TREES.name])
            trees = TREES.name, int(p["MIN_HEIGHT"]), p["MIN_DICE"]
            c = ctx.by_name if p[SAME_NAME.name] else ctx
            find = lambda pairs_: structure.tree_matches(c.packed, c.files, trees[1], trees[2], bool(p["ABSTRACT_MATCHING"]), pairs=pairs_)
            masks = self._masks(c, c.packed.select(F.col("file_id").alias("id"), "grp", "sub"), find)
            name = F.col("grp").cast("string") if p[SAME_NAME.name] else F.lit("")
            t = c.packed.select(F.col("file_id").alias("id"), "tree", "total", "sub", name.alias("name"))
            items = items.join(t, "id", "left").join(masks, "id", "left").withColumn("mask", F.coalesce("mask", F.array().cast("array<struct<start:int,end:int>>")))
        return stash.keep(items), names, trees

    @cached_property
    def file_scores(self) -> DataFrame:
        if self._stored:
            return self.ctx.stash.keep(scoring.pair_scores(self._group_scores(self.blocks, self.totals), self.ctx.stash))
        return scoring.scores_in_blocks(*self._items, False)

    @cached_property
    def file_overall(self) -> DataFrame:
        if self._stored or "file_scores" in self.__dict__:
            return scoring.file_overall(self.file_scores, self.files)
        return scoring.with_files(self.ctx.stash.keep(scoring.scores_in_blocks(*self._items, True)), self.files)


def run_job(files: DataFrame, workspaces: DataFrame, config: JobConfig | None = None, registry: Registry = REGISTRY) -> JobResult:
    """Preprocess, detect, take out given code, group and score, over all workspaces that have a language. ``matches`` has those of
    the detectors whose groups are made of matches; those of variables are made for files that are reported on, by
    ``structure.variable_matches``, and not for all pairs. ``plans.runs`` stores jobs, and runs them again.

    Workspaces with fewer than two submissions have no pairs and so no matches. Raises where there is nothing to run.
    """
    config = config or JobConfig()
    if not config.detectors:
        raise ValueError("a job needs a detector")
    unknown = [d for d in config.detectors if d not in registry.detectors]
    if unknown:
        raise KeyError(f"no such detector: {unknown}")
    ctx = Context(files, workspaces, trees=config.detectors.keys() != {"VariableNameDetector"}, registry=registry)
    ctx.tree_values = TREES.values(config.detectors.get(TREES.name))
    # what reads the files reads them here, and not again from the input
    ctx.files = ctx.stash.keep(ctx.files)
    return Job(ctx, config, registry)
