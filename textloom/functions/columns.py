"""Scalar functions of the engine as column expressions. They all run in the JVM; nulls give null unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _c(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


def is_blank(x: ColumnOrName) -> Column:
    """No visible character, or null."""
    return F.coalesce(~_c(x).rlike(r"\S"), F.lit(True))


def pad_right(x: ColumnOrName, n: int) -> Column:
    """Spaces added up to n characters; longer texts stay as they are."""
    return F.when(F.length(_c(x)) < n, F.rpad(_c(x), n, " ")).otherwise(_c(x))


def trim_control(x: ColumnOrName) -> Column:
    """Without the characters up to U+0020 at both ends."""
    return F.regexp_replace(_c(x), r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def split_lines(x: ColumnOrName) -> Column:
    """Pieces between CRLF, LF and CR."""
    return F.split(_c(x), r"\r?\n|\r")


def text_lines(x: ColumnOrName) -> Column:
    """Lines as a line reader gives them: a final line end begins no line, and an empty text has none."""
    x = _c(x)
    return F.when(x == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(x, r"(\r\n|\n|\r)\z", ""), r"\r\n|\n|\r"))


def line_count(x: ColumnOrName) -> Column:
    return F.size(text_lines(x))


def nonempty_line_count(x: ColumnOrName) -> Column:
    """Lines that aren't ''; lines of blanks count."""
    return F.size(F.filter(text_lines(x), lambda v: v != ""))


def line_grams(line: ColumnOrName, n: int) -> Column:
    """The character n-grams of a line that aren't blank; a shorter line is padded, and a blank one has none."""
    padded = pad_right(line, n)
    at = F.sequence(F.lit(1), F.greatest(F.length(padded) - (n - 1), F.lit(1)))
    grams = F.transform(at, lambda i: F.substring(padded, i, F.lit(n)))
    return F.when(is_blank(line), F.array().cast("array<string>")).otherwise(F.filter(grams, lambda g: g.rlike(r"\S")))


def display_name(filename: ColumnOrName, extension: ColumnOrName) -> Column:
    return F.concat(_c(filename), F.lit("."), _c(extension))


def display_path(dirs: ColumnOrName, name: ColumnOrName, separator: str = "/") -> Column:
    """Names of the directories and of the file, joined; the root is left out where it has the file's own base name."""
    dirs, name = _c(dirs), _c(name)
    base = F.substring_index(name, ".", 1)
    kept = F.when(F.get(dirs, F.lit(0)) == base, F.slice(dirs, 2, F.greatest(F.size(dirs) - 1, F.lit(0)))).otherwise(dirs)
    return F.array_join(F.concat(kept, F.array(name)), separator)


def display_size(size: ColumnOrName) -> Column:
    """Bytes, or with one decimal kB, MB, ...: in steps of 1000 each further unit."""
    x = _c(size).cast("double")
    out = F.concat(_c(size).cast("string"), F.lit(" B"))
    for k, unit in enumerate(("kB", "MB", "GB", "TB", "PB"), 1):
        out = F.when(x >= 1000.0**k, F.concat(F.format_string("%.1f", x / 1000.0**k), F.lit(f" {unit}"))).otherwise(out)
    return out


def display_duration(seconds: ColumnOrName) -> Column:
    s = _c(seconds).cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor((s % 3600) / 60), s % 60)


def clamp(x: ColumnOrName) -> Column:
    """To 0..1; NaN is 0."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.nanvl(_c(x).cast("double"), F.lit(0.0))))


def percent(score: ColumnOrName) -> Column:
    """Per cent, rounded half up."""
    return F.floor(_c(score).cast("double") * 100 + 0.5).cast("int")


def bucket(percentage: ColumnOrName) -> Column:
    """Ten buckets of ten per cent; what isn't above 0 is in the first, 100 in the last."""
    p = _c(percentage)
    return F.when(p <= 0, 0).otherwise(F.least(F.lit(9), F.floor(p / 10).cast("int")))


def range_length(r: ColumnOrName) -> Column:
    return _c(r)["end_line"] - _c(r)["start_line"] + 1


def total_length(ranges: ColumnOrName) -> Column:
    """Lines of all ranges; those that stand in two count twice."""
    return F.aggregate(_c(ranges), F.lit(0), lambda a, r: a + range_length(r))


def range_lines(ranges: ColumnOrName) -> Column:
    """The different lines of the ranges, in the order of the ranges."""
    r = F.filter(_c(ranges), lambda x: x["end_line"] >= x["start_line"])
    return F.array_distinct(F.flatten(F.transform(r, lambda x: F.sequence(x["start_line"], x["end_line"]))))


def content_hash(x: ColumnOrName, bits: int = 512) -> Column:
    return F.sha2(_c(x).cast("binary"), bits)


def locator(identifier: ColumnOrName, bits: int = 512, width: int = 1024) -> Column:
    """Where a stored object lies: the hash of its padded identifier, below two directories of its first characters."""
    h = F.sha2(F.rpad(_c(identifier), width, " ").cast("binary"), bits)
    return F.concat_ws("/", F.substring(h, 1, 2), F.substring(h, 3, 2), h)


def before_first(x: ColumnOrName, mark: str) -> Column:
    return F.substring_index(_c(x), mark, 1)


def language_key(x: ColumnOrName) -> Column:
    return F.lower(F.trim(_c(x)))
