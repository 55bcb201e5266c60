"""From source text to tokens, and from tokens to the lines that detectors compare.

A strategy is a chain of token filters that ends in lines; filters and lines are column expressions, and only the lexers, which
need a scan of the text in order, run in Python over Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import haskell_tokens, java_tokens
from textloom.functions.columns import language_key, split_lines, trim_control
from textloom.functions.java_tokens import COMMENT, DEFAULT, LONG_WHITESPACE, WHITESPACE
from textloom.session import spread

LEXERS: dict[str, Callable] = {"java": java_tokens.tokens, "haskell": haskell_tokens.tokens}
#: Channels that each lexer fills. A strategy fits a lexer that has the channels it names.
CHANNELS: dict[str, tuple[str, ...]] = {"java": java_tokens.CHANNELS, "haskell": java_tokens.CHANNELS}
TOKENS = "array<struct<pos:int,type:string,text:string,channel:int,line:int>>"
_END = re.compile(r"\r?\n|\r")
_ARROW = pa.list_(pa.struct([("pos", pa.int32()), ("type", pa.string()), ("text", pa.string()), ("channel", pa.int32()), ("line", pa.int32())]))


def tokenise(files: DataFrame, id: str = "file_id", text: str = "content", lang: str = "lang") -> DataFrame:
    """(id, lang, tokens). Files with null id, text or language, or one without a lexer, are left out; an empty text has no tokens."""
    rows = files.select(F.col(id).cast("long").alias("id"), language_key(lang).alias("lang"), F.col(text).alias("text"))
    rows = rows.where(F.col("id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isin(*LEXERS))
    lexers = LEXERS

    def lex(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [[(t.pos, t.type, t.text, t.channel, t.line) for t in lexers[lang.as_py()](text.as_py())] for lang, text in zip(b.column(1), b.column(2))]
            lists = [[dict(zip(("pos", "type", "text", "channel", "line"), t)) for t in x] for x in out]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lists, _ARROW)], names=["id", "lang", "tokens"])

    return spread(rows).mapInArrow(lex, f"id long, lang string, tokens {TOKENS}").withColumnRenamed("id", id)


def comments_only(tokens: Column) -> Column:
    return F.filter(tokens, lambda t: t["channel"] == COMMENT)


def without_comments(tokens: Column) -> Column:
    return F.filter(tokens, lambda t: t["channel"].isin(DEFAULT, WHITESPACE, LONG_WHITESPACE))


def trim_whitespace(tokens: Column) -> Column:
    """Long runs of blanks become one."""
    kept = F.filter(tokens, lambda t: t["channel"].isin(DEFAULT, WHITESPACE, LONG_WHITESPACE, COMMENT))
    return F.transform(kept, lambda t: t.withField("text", F.when(t["channel"] == LONG_WHITESPACE, F.lit(" ")).otherwise(t["text"])))


def stringify(df: DataFrame, keys: list[str], tokens: str = "tokens", comment_lines: bool = True) -> DataFrame:
    """(keys, line, value): the text of each line that has tokens. A comment over several lines gives one piece for each, trimmed,
    empty ones too; hidden tokens give none."""
    t = df.select(*keys, F.posexplode(tokens).alias("_at", "t")).select(*keys, "_at", F.col("t.line").alias("line"), F.col("t.text").alias("text"), F.col("t.channel").alias("channel"))
    t = t.where(F.col("channel") != 1)
    if comment_lines:
        piece = F.when(F.col("channel") == COMMENT, F.transform(split_lines("text"), trim_control)).otherwise(F.array("text"))
        t = t.select(*keys, "_at", "line", F.posexplode(piece).alias("_n", "text")).withColumn("line", F.col("line") + F.col("_n"))
    parts = t.groupBy(*keys, "line").agg(F.array_sort(F.collect_list(F.struct("_at", "text"))).alias("x"))
    return parts.select(*keys, "line", F.array_join(F.col("x.text"), "").alias("value"))


def token_names(df: DataFrame, keys: list[str], tokens: str = "tokens") -> DataFrame:
    """(keys, line, value): the names of each line's tokens, joined by blanks. A comment is one name, on its last line."""
    t = df.select(*keys, F.posexplode(tokens).alias("_at", "t"))
    lines = F.when(F.col("t.channel") == COMMENT, F.size(split_lines("t.text")) - 1).otherwise(0)
    t = t.where(F.col("t.channel").isin(DEFAULT, COMMENT)).select(*keys, "_at", (F.col("t.line") + lines).alias("line"), F.col("t.type").alias("type"))
    parts = t.groupBy(*keys, "line").agg(F.array_sort(F.collect_list(F.struct("_at", "type"))).alias("x"))
    return parts.select(*keys, "line", F.array_join(F.col("x.type"), " ").alias("value"))


#: Filters by name, to which others may be added.
FILTERS: dict[str, Callable[[Column], Column]] = {"comments_only": comments_only, "without_comments": without_comments, "trim_whitespace": trim_whitespace}


@dataclass(frozen=True)
class Strategy:
    """Filters from left to right, then token names, or lines made by ``to_lines``, or plain lines."""

    name: str
    filters: tuple[str, ...]
    names: bool = False
    to_lines: Callable[[DataFrame, list[str]], DataFrame] | None = None
    channels: tuple[str, ...] = field(default=java_tokens.CHANNELS)

    def fits(self, lang: str) -> bool:
        """Whether the lexer has the same channels at the same places; ``-`` stands for any."""
        have = CHANNELS.get(lang, ())
        return len(self.channels) <= len(have) and all(a in ("-", b) for a, b in zip(self.channels, have))

    def run(self, tokens: DataFrame, keys: list[str]) -> DataFrame:
        column = F.col("tokens")
        for f in self.filters:
            column = FILTERS[f](column)
        tokens = tokens.withColumn("tokens", column)
        if self.to_lines:
            return self.to_lines(tokens, keys)
        return token_names(tokens, keys) if self.names else stringify(tokens, keys)


NO_WHITESPACE = Strategy("no_whitespace", ("trim_whitespace",))


def lines(files: DataFrame, strategy: Strategy = NO_WHITESPACE, id: str = "file_id", text: str = "content", lang: str = "lang") -> DataFrame:
    """(id, line, value) of the files whose language fits the strategy."""
    fitting = [x for x in LEXERS if strategy.fits(x)]
    return strategy.run(tokenise(files, id, text, lang).where(F.col("lang").isin(*fitting)), [id])


#: What ``trim_control`` takes out; Java's $ also stands before a last separator of lines.
_CONTROL = re.compile(r"\A[\x00-\x20]+|[\x00-\x20]+(?=[\u0085\u2028\u2029]?\Z)")
_LINES = pa.list_(pa.struct([("line", pa.int32()), ("value", pa.string())]))


def file_lines(files: DataFrame, keys: dict[str, Column], types: str, text: str = "content", lang: str = "lang") -> DataFrame:
    """(keys, lines): the rows of ``lines`` by ``NO_WHITESPACE`` as an array for each file that has any, in the task that lexes it.

    No row is made of a token, and nothing is shuffled. ``types`` are the types of the keys. Rows with the same keys are not joined.
    """
    rows = files.select(*[c.alias(k) for k, c in keys.items()], language_key(lang).alias("_lang"), F.col(text).alias("_text"))
    rows = rows.where(F.col("_text").isNotNull() & F.col("_lang").isin(*LEXERS))
    lexers, n, names = LEXERS, len(keys), [*keys, "lines"]

    def of(lang: str, text: str) -> list[dict]:
        at: dict[int, list[str]] = {}
        for t in lexers[lang](text):
            if t.channel == COMMENT:
                for k, piece in enumerate(_END.split(t.text)):
                    at.setdefault(t.line + k, []).append(_CONTROL.sub("", piece))
            elif t.channel in (DEFAULT, WHITESPACE, LONG_WHITESPACE):
                at.setdefault(t.line, []).append(" " if t.channel == LONG_WHITESPACE else t.text)
        return [{"line": line, "value": "".join(at[line])} for line in sorted(at)]

    def lex(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = pa.array([of(lang, text.as_py()) for lang, text in zip(b.column(n).to_pylist(), b.column(n + 1))], _LINES)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in range(n)), found], names=names)

    return spread(rows).mapInArrow(lex, f"{types}, lines array<struct<line:int,value:string>>").where("size(lines) > 0")
