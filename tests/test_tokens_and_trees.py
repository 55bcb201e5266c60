import sys

import pytest

from textloom.functions import haskell_tokens, haskell_tree, java_tokens, java_tree
from textloom.functions.trees import rows
from textloom.operators import preprocess, structure

SOURCE = "int   n = 07; // seven\n/* two\n lines */ n >>= 1;"


@pytest.fixture(scope="module")
def tokens(spark):
    return preprocess.tokenise(spark.createDataFrame([(1, SOURCE, "Java ", "x"), (2, None, "java", "x"), (3, "x", "cobol", "x"), (4, "", "java", "x")], "file_id long, content string, lang string, tokens string"))


def texts(df, column):
    return [t["text"] for t in df.where("file_id = 1").select(column.alias("c")).first()["c"]]


def test_java_tokens():
    """A lone blank is on channel 2, more of them on 3, comments on 4; a comment takes the blanks behind it along, and a token has the
    line on which it begins."""
    assert [(t.type, t.text, t.channel, t.line) for t in java_tokens.tokens(SOURCE)] == [
        ("INT", "int", 0, 1), ("LONG_WS", "   ", 3, 1), ("IDENTIFIER", "n", 0, 1), ("WS", " ", 2, 1), ("ASSIGN", "=", 0, 1), ("WS", " ", 2, 1), ("OCT_LITERAL", "07", 0, 1), ("SEMI", ";", 0, 1), ("WS", " ", 2, 1),
        ("LINE_COMMENT", "// seven", 4, 1), ("COMMENT", "/* two\n lines */", 4, 2), ("IDENTIFIER", "n", 0, 3), ("WS", " ", 2, 3), ("RSHIFT_ASSIGN", ">>=", 0, 3), ("WS", " ", 2, 3), ("DECIMAL_LITERAL", "1", 0, 3), ("SEMI", ";", 0, 3),
    ]
    assert [t.text for t in java_tokens.tokens("  a\t= b;  \n\n\t/* x\n y */  c")] == ["  ", "a", "=", " ", "b", ";", "/* x\n y */", "c"]


def test_every_java_operator_is_one_token():
    """The longest sign that fits, each by itself and beside names; a shift to the right is single signs, as in type arguments."""
    for sign, name in java_tokens.NAMES.items():
        got = [t.type for t in java_tokens.tokens(f"a {sign} b") if t.channel == 0]
        assert got == ["IDENTIFIER", name, "IDENTIFIER"], sign
    kinds = lambda x: [t.type for t in java_tokens.tokens(x) if t.channel == 0]
    assert kinds("a>>=b>>>=c<<=d") == ["IDENTIFIER", "RSHIFT_ASSIGN", "IDENTIFIER", "URSHIFT_ASSIGN", "IDENTIFIER", "LSHIFT_ASSIGN", "IDENTIFIER"]
    assert kinds("A<B<C>>x") == ["IDENTIFIER", "LT", "IDENTIFIER", "LT", "IDENTIFIER", "GT", "GT", "IDENTIFIER"]


def test_shift_assignments_in_trees():
    values = [n[4] for op in (">>=", ">>>=", "<<=", ">>", ">>>", "<<") for n in rows(java_tree.tree(f"class A {{ void f() {{ a = b; c {op} 2; }} }}")[0], "java") if n[3] == "BINARY_EXPR"]
    assert [v for v in values if v != "="] == [">>=", ">>>=", "<<=", ">>", ">>>", "<<"]


def test_filters(tokens):
    from pyspark.sql import functions as F

    t = F.col("tokens")
    assert texts(tokens, preprocess.comments_only(t)) == ["// seven", "/* two\n lines */"]
    assert texts(tokens, preprocess.without_comments(t)) == ["int", "   ", "n", " ", "=", " ", "07", ";", " ", "n", " ", ">>=", " ", "1", ";"]
    assert texts(tokens, preprocess.trim_whitespace(t)) == ["int", " ", "n", " ", "=", " ", "07", ";", " ", "// seven", "/* two\n lines */", "n", " ", ">>=", " ", "1", ";"]
    assert tokens.where("file_id <> 1").count() == 1


def lines(df, keys=("file_id",)):
    return sorted((r["line"], r["value"]) for r in df.collect())


def test_lines(tokens, spark):
    assert lines(preprocess.stringify(tokens, ["file_id"])) == [(1, "int   n = 07; // seven"), (2, "/* two"), (3, "lines */n >>= 1;")]
    assert lines(preprocess.token_names(tokens, ["file_id"])) == [(1, "INT IDENTIFIER ASSIGN OCT_LITERAL SEMI LINE_COMMENT"), (3, "COMMENT IDENTIFIER RSHIFT_ASSIGN DECIMAL_LITERAL SEMI")]
    block = preprocess.tokenise(spark.createDataFrame([(1, "a /* b\n\n  c */ d", "java")], "file_id long, content string, lang string"))
    assert lines(preprocess.stringify(block, ["file_id"])) == [(1, "a /* b"), (2, ""), (3, "c */d")]
    assert lines(preprocess.token_names(block, ["file_id"])) == [(1, "IDENTIFIER"), (3, "COMMENT IDENTIFIER")]


def test_strategies():
    assert preprocess.NO_WHITESPACE.fits("java") and not preprocess.NO_WHITESPACE.fits("cobol")
    assert preprocess.Strategy("x", (), channels=("-", "-", "WHITESPACE")).fits("java")
    assert not preprocess.Strategy("x", (), channels=("WHITESPACE",)).fits("java")


def test_layout():
    text = " ".join(t.text for t in haskell_tokens.tokens("module A where\nf x = do\n  let y = 1\n  print y\n  where\n    z = 2\ng = let a = 1 in a\nh = let\n      b = 2\n    in b -- {- no -}\n"))
    assert text == (
        "module A where VOCURLY f x = do VOCURLY let VOCURLY y = 1 SEMI VCCURLY SEMI print y SEMI VCCURLY where VOCURLY z = 2 SEMI VCCURLY SEMI "
        "g = let VOCURLY a = 1 SEMI VCCURLY in a SEMI h = let VOCURLY b = 2 SEMI VCCURLY in b SEMI VCCURLY"
    )
    assert [t.text for t in haskell_tokens.tokens("f = { a }")][-3:-2] == ["}"]


def kinds(text, lang):
    sys.setrecursionlimit(6000)
    root, found, problem = (java_tree if lang == "java" else haskell_tree).tree(text)
    assert problem is None
    return rows(root, lang), found


@pytest.mark.parametrize(
    "text, want",
    [
        ("class A { void m() {} }", {"PROGRAM", "CLASS_DECL", "FUNCTION_DECL"}),
        ("class A { void m() { if (a) b(); for (;;) ; while (x) ; do ; while (y); try { } catch (E e) { } finally { } } }", {"IF_STATEMENT", "FOR_LOOP", "WHILE_LOOP", "DO_WHILE_LOOP", "TRY_STATEMENT", "CATCH", "FINALLY"}),
        ("class A { void m() { switch (x) { case 1: break; default: break; } } }", {"SWITCH_EXPR", "CASE_LABEL", "BREAK"}),
        ("class A { void m() { foo(a, b, c); Runnable r = () -> {}; int y = -x + (x >> 2); } }", {"CALL_EXPR", "LAMBDA_EXPR", "UNARY_EXPR", "BINARY_EXPR"}),
        ("class A { int x = 42; String s = \"hi\"; boolean b = true; Object o = null; } enum E { A } interface I { } record R(int x) { }", {"NUMBER_LITERAL", "STRING_LITERAL", "BOOL_LITERAL", "NULL_LITERAL", "ENUM_DECL", "INTERFACE_DECL", "RECORD_DECL"}),
    ],
)
def test_java_kinds(text, want):
    assert want <= {r[3] for r in kinds(text, "java")[0]}


def test_java_details():
    r, _ = kinds("class A { void m() { int x = a + b; foo(a, b, c); } }", "java")
    call = next(x for x in r if x[3] == "CALL_EXPR")
    assert call[4] == "foo(a,b,c)" and sum(x[1] == call[0] for x in r) == 3
    plus = next(x for x in r if x[3] == "BINARY_EXPR")
    assert plus[4] == "+" and sum(x[1] == plus[0] for x in r) == 2
    small, large = kinds("class A {}", "java")[0][0], kinds("class A { int x; void m() {} }", "java")[0][0]
    assert large[9] > small[9]
    assert kinds("class A { void m() { for (;;) { while (a) { if (b) { break; } } } } }", "java")[0][0][10] >= 7


def test_tree_invariants():
    for lang, text in (("java", "class A { int f(int a) { return a * (a + 1); } }"), ("haskell", "f x = case x of\n  1 -> [y | y <- z]\n  _ -> (+ 1) 2\n")):
        r, _ = kinds(text, lang)
        for node in r:
            below = [x for x in r if x[1] == node[0]]
            assert node[9] == 1 + sum(x[9] for x in below)
            assert node[10] == 1 + max((x[10] for x in below), default=0)
        assert sorted(x[11] for x in r) == sorted(x[12] for x in r) == list(range(len(r)))


def test_fingerprints():
    a, b, c = (kinds(f"class A {{ int f() {{ return {x}; }} }}", "java")[0][0] for x in ("1", "2", "x"))
    assert a[13] != b[13] and a[14] == b[14] != c[14]


def test_java_declarations():
    text = "class A {\n int x = 1;\n final String y;\n void m() {\n  final int z = 2, w;\n  for (int i = 0; ; ) ;\n  for (int j : k) ;\n } }"
    assert kinds(text, "java")[1] == [(2, "intx"), (3, "Stringy;"), (5, "finalintz"), (6, "inti")]


def test_haskell_kinds_and_bindings():
    text = "module A (foo) where\nimport Data.List\nfoo x = x + 1\ntype S = [Char]\ndata T = A Int | B { q :: Int } deriving Show\nnewtype N = N Int\n(a, b) = (1, 2)\nmain = do\n  c <- getLine\n  let d = 1\n  print c\n"
    r, found = kinds(text, "haskell")
    assert {"MODULE", "IMPORT", "EXPORT", "FUNCTION_DECL", "TYPE_DECL", "DATA_DECL", "NEWTYPE_DECL", "DERIVING", "RECORD_FIELD", "PATTERN_BIND", "TUPLE_EXPR", "DO_EXPR", "DO_BIND", "DO_LET", "DO_STMT", "INFIX_EXPR"} <= {x[3] for x in r}
    assert sum(x[3] == "CONSTRUCTOR" for x in r) == 3
    assert found == [(3, "foox"), (7, "(a,b)"), (8, "main"), (9, "c"), (10, "d")]


def test_unparsable(spark):
    files = spark.createDataFrame([(1, "class A {", "java"), (2, "class A {}", "java"), (3, "", "java"), (4, None, "java"), (5, "f = (", "haskell")], "file_id long, content string, lang string")
    got = {r["file_id"]: (r["nodes"][0]["kind"], r["problem"] is None) for r in structure.parse(files).collect()}
    assert got == {1: ("UNKNOWN", False), 2: ("PROGRAM", True), 3: ("PROGRAM", True), 5: ("MODULE", True)}


def test_below(spark):
    files = spark.createDataFrame([(1, "class A { void m() { x = 1; } }", "java")], "file_id long, content string, lang string")
    n = structure.nodes(structure.parse(files))
    root = n.where("kind = 'FUNCTION_DECL'").first()
    assert structure.below(n, root["node_id"]).count() == root["weight"]


def test_deep_nesting_and_what_is_not_read(spark):
    deep = "class A { int x = " + "(" * 3000 + "1" + ")" * 3000 + "; }"
    haskell = "foreign import ccall f :: Int\ng = " + "(" * 3000 + "1" + ")" * 3000 + "\n"
    files = spark.createDataFrame([(1, deep, "java"), (2, haskell, "haskell")], "file_id long, content string, lang string")
    got = {r["file_id"]: r for r in structure.parse(files).collect()}
    assert got[1]["problem"] is None and got[2]["problem"] is None and "NUMBER_LITERAL" in [n["kind"] for n in got[1]["nodes"]]
    assert [n["kind"] for n in got[2]["nodes"]].count("UNKNOWN") == 1
