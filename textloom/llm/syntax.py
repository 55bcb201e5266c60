"""Source files that do not parse in their language."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import syntax_haskell, syntax_java

#: Parsers by normalised language name.
PARSERS: dict[str, Callable[[str], list[tuple[int, str]]]] = {"java": syntax_java.errors, "haskell": syntax_haskell.errors}
#: Frames of Python that a character of source text can take, more than any does. Frames of these parsers stand on the heap, about
#: a KB for each level of nesting, so that only memory bounds how deeply a text may be nested.
FRAMES = 32


def errors_of(lang: str, text: str) -> list[tuple[int, str]]:
    """All errors of a text in a language of PARSERS, as (line, what was wanted), however deeply it is nested."""
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 10_000 + FRAMES * len(text)))
    return PARSERS[lang](text)


def language(name: str | F.Column) -> F.Column:
    return F.lower(F.trim(F.col(name) if isinstance(name, str) else name))


def parse_files(files: DataFrame, languages: DataFrame, id: str = "file_id", text: str = "content", group: str = "workspace_id", lang: str = "lang") -> DataFrame:
    """For each file of a group with a known language: id, group, lang, valid, n_errors, first_line, first_want and all errors.

    ``errors`` are (line, what was wanted) in order; the first is the cause that counts. Rows that repeat an id count once; null
    ids and texts, groups without a language and languages without a parser are no case. An empty text is valid in either
    language. ``languages`` has one row for each group, few enough for Spark's size check to broadcast or else be shuffled.
    """
    named = languages.select(F.col(group).alias("_group"), language(lang).alias("_lang")).where("_lang IS NOT NULL").groupBy("_group").agg(F.min("_lang").alias("_lang"))
    rows = files.select(F.col(id).cast("long").alias("_id"), F.col(group).alias("_group"), F.col(text).alias("_text")).where("_id IS NOT NULL AND _text IS NOT NULL")
    rows = rows.join(named, "_group").where(F.col("_lang").isin(*PARSERS)).select("_id", F.col("_group").cast("long").alias("_group"), "_lang", "_text")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("line", pa.int32()), ("want", pa.string())]))
        for batch in batches:
            found = [errors_of(lang.as_py(), t.as_py()) for lang, t in zip(batch.column(2), batch.column(3))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array([[{"line": n, "want": w} for n, w in e] for e in found], kind)],
                names=["id", "grp", "lang", "errors"],
            )

    parsed = rows.mapInArrow(parse, "id long, grp long, lang string, errors array<struct<line:int,want:string>>").dropDuplicates(["id"])
    n = F.size("errors")
    return parsed.select(
        F.col("id").alias(id), F.col("grp").alias(group), "lang", (n == 0).alias("valid"), n.alias("n_errors"), F.get("errors", F.lit(0))["line"].alias("first_line"), F.get("errors", F.lit(0))["want"].alias("first_want"), "errors"
    )


def rates(parsed: DataFrame, *by: str) -> DataFrame:
    """Files, invalid files and the share of them by the given columns."""
    return parsed.groupBy(*by).agg(F.count("*").alias("n_files"), F.count_if(~F.col("valid")).alias("n_invalid"), F.avg((~F.col("valid")).cast("double")).alias("invalid_rate"))
