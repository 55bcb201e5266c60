import pytest
from pyspark.sql import functions as F

from textloom.functions import columns as c


def value(spark, expression, x, kind="string"):
    return spark.createDataFrame([(x,)], f"x {kind}").select(expression.alias("y")).first()["y"]


@pytest.mark.parametrize(
    "text, n, want",
    [("abcdefgh", 8, ["abcdefgh"]), ("abc", 8, ["abc     "]), ("abcdefghi", 8, ["abcdefgh", "bcdefghi"]), ("", 8, []), ("   ", 2, []), ("a   b", 2, ["a ", " b"]), (None, 2, [])],
)
def test_line_grams(spark, text, n, want):
    assert value(spark, c.line_grams("x", n), text) == want


@pytest.mark.parametrize("text, lines, full", [("", 0, 0), ("a", 1, 1), ("a\n", 1, 1), ("a\n\n b", 3, 2), ("\r\n\r", 2, 0), (" \nx\r\n", 2, 2)])
def test_lines(spark, text, lines, full):
    assert (value(spark, c.line_count("x"), text), value(spark, c.nonempty_line_count("x"), text)) == (lines, full)


@pytest.mark.parametrize("x, want", [(0.5, 0.5), (-1.0, 0.0), (7.0, 1.0), (float("nan"), 0.0)])
def test_clamp(spark, x, want):
    assert value(spark, c.clamp("x"), x, "double") == want


@pytest.mark.parametrize("x, p, b", [(0.0, 0, 0), (0.004, 0, 0), (0.005, 1, 0), (0.095, 10, 1), (0.99, 99, 9), (1.0, 100, 9)])
def test_percent_and_bucket(spark, x, p, b):
    assert (value(spark, c.percent("x"), x, "double"), value(spark, c.bucket(c.percent("x")), x, "double")) == (p, b)


@pytest.mark.parametrize("x, want", [(0, "0 B"), (999, "999 B"), (1000, "1.0 kB"), (1234567, "1.2 MB")])
def test_size(spark, x, want):
    assert value(spark, c.display_size("x"), x, "long") == want


def test_texts(spark):
    assert value(spark, c.trim_control("x"), "\x01\t a b \x1f") == "a b"
    assert value(spark, c.split_lines("x"), "a\r\nb\rc\n") == ["a", "b", "c", ""]
    assert value(spark, c.pad_right("x", 3), "abcd") == "abcd"
    assert value(spark, c.before_first("x", "="), "a=b=c") == "a"
    assert value(spark, c.language_key("x"), " JaVa ") == "java"
    assert value(spark, c.is_blank("x"), None) is True
    assert value(spark, c.display_duration("x"), 3725, "long") == "01:02:05"


def test_ranges_and_paths(spark):
    df = spark.createDataFrame([([(1, 3), (2, 4), (9, 8)], ["A", "b"], "A.java")], "r array<struct<start_line:int,end_line:int>>, d array<string>, n string")
    row = df.select(c.range_lines("r").alias("l"), c.total_length("r").alias("t"), c.display_path("d", "n").alias("p"), c.display_path("d", F.lit("z"), "-").alias("q")).first()
    assert tuple(row) == ([1, 2, 3, 4], 6, "b/A.java", "A-b-z")


def test_content_hash_of_512_bits(spark):
    import hashlib

    df = spark.createDataFrame([("",), ("ü\n",), (None,)], "c string")
    assert [r["h"] for r in df.select(c.content_hash("c", 512).alias("h")).collect()] == [hashlib.sha512(x.encode()).hexdigest() if x is not None else None for x in ("", "ü\n", None)]
