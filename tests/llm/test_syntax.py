import pytest

from textloom.llm import syntax, syntax_haskell, syntax_java

JAVA_GOOD = [
    "", "// only a comment", ";", "package a.b; import java.util.*; import static java.lang.Math.max; class A {}",
    "class A<T extends Comparable<T> & Runnable> extends B<T[]> implements C, D<int[]> { int[] a[] = {1, 2, {3},}; }",
    "enum E implements I { A, B(1) { void f() {} }, C; int x; E() {} } @interface N { int v() default 3; String[] w() default {}; }",
    "interface I { default int f() { return 1; } static void g() {} int x = 1; <T> T h(T... t) throws E; }",
    "class A { void f() { for (;;) { break; } for (int i = 0, j = 1; i < j; i++, j--) ; for (final String s : xs) g(s); do x++; while (x < 3); l: while (true) continue l; } }",
    "class A { void f() throws E { try (R r = g(); Q q = h();) { } catch (final A | B e) { throw e; } finally { } synchronized (this) { } assert x : y; switch (a) { case 1: case B: f(); break; default: } } }",
    "class A { Object o = (Runnable & Serializable) () -> {}; F f = x -> x + 1; G g = (int a, String b) -> { return a; }; H h = A::new; K k = int[]::new; L l = List<String>::new; M m = a.b::<T>c; }",
    "class A { int x = (int) -y + (a) - b + (String) z.w(); long q = a >>> 2 >> 1 << 3; boolean b = a < c && d > e | x instanceof String[]; }",
    "class A { Map<String, List<Map<A, B>>> m = new HashMap<>(); int[][] n = new int[3][], o = new int[][] {{1}, {}}; Object p = outer.new Inner<X>(1) { int y; }; Class<?> c = int[].class, d = void.class, e = A[].class; }",
    "class A { { x = y = 3; a[i++] += 2; i >>= 1; j >>>= 2; --k; new B(); this.f(); super.g(); A.this.h(); A.super.toString(); (x) = 1; a.<T>f().b[0]++; } static { } A() { this(1); } A(int a) { super(); } }",
    "@A @B(1) @C(x = 2, y = {3, @D}) public final class Z { @E int f(@F final int a, int... b) { @G int c = 1; final class L {} class M {} return a > 0 ? b : c -> d; } ; }",
    "class A { char a = '\\'', b = '\\u0041', c = '}'; String s = \"// no \\\" comment {\"; double d = 1e10 + .5f + 0x1.8p3 + 1_000L + 0b101 + 017; int var = 1, record = 2; var v = 3; }",
    "class A { int f(A this, int a) { if (a) return 1; else if (b) ; else { } return (a); } int g()[] { return null; } }",
]
JAVA_BAD = [
    "class A {", "class A { void f() { }", "class A { int x = ; }", "class A { void f() { x = 1 } }", "class A { void f() { g(1; } }", "class A { void f() { int 3x = 1; } }", "class A } {",
    "module A where\nx = 1", "<<<<<<< HEAD\nclass A {}\n=======\n>>>>>>> b", "class A { String s = \"abc; }", "class A { /* no end }", "class A { void f() { if x { } } }", "class A { void f() { else { } } }",
    "class A { void f() { try { } } }", "class A { void f() { a + b; } }", "class A { void f() { 5; } }", "class A { void f() { case 1: } }", "class A { void f() { f() = 3; } }", "class A { int catch = 3; }",
    "class A { void f() { int[] a = new int[]; } }", "class A { char c = 'ab'; }", "class A { int x = 08; }", "import a.b; package c; class A {}", "class A {} import b;", "class A { void f() { if (a) int x = 1; } }",
    "class A { String s = “x”; }", "class A { void f() { for (int i = 0; i < 3) { } } }", "hello world", "class A { int f( { } }", "class A { } }", "class A { void f(int... a, int b) {} }", "class { }", "class A { String s = \"\\q\"; }",
    "class A { var x = switch (a) { case 1 -> 2; }; }", "class A { void f() { List<String x; } }",
]
HASKELL_GOOD = [
    "", "-- nothing", "{- a {- nested -} one -}", "module A where", "module A (f, T(..), module B, (+++), C(D, e)) where\nimport qualified B.C as D hiding (x, (!))\nimport E (T(..), f)\nx = 1",
    "f 0 = 1\nf n | n > 0, Just y <- g n = y\n    | otherwise = case n of\n        1 -> 2\n        _ | n < 3 -> 4\n          | True -> 5\n  where\n    g = Just\n    h = 2",
    "main :: IO ()\nmain = do\n  let x = 1\n      y = 2\n  z <- getLine\n  if x > y\n    then print x\n    else do\n      print y\n  mapM_ print [a | a <- [1 ..], let b = a, odd b]\n  print z",
    "f x = let y = 1 in y + x\ng = let { a = 1; b = 2 } in a\nh = (let x = 1 in x, 2)\nk = [x | let y = 2, x <- [1..y]]",
    "data T a = A Int a | B { p, q :: !Int, r :: Maybe a } | a :+: Int deriving (Eq, Show)\nnewtype N = N { un :: Int } deriving Eq\ntype S = [Char]\ndata E",
    "class (Eq a) => C a where\n  f :: a -> a\n  f x = x\n  infixl 6 <+>\n  (<+>) :: a -> a -> a\ninstance C a => C [a] where\n  f = id\ninstance Show T",
    "infixr 5 +++, `op`\nx +++ y = x ++ y\n(a, b) = (1, 2)\n[c] = [3]\nx `op` y = x\n(f . g) x = f (g x)\np@(Just ~q) = Just 1\n(-) = undefined",
    "f = \\x (Just y) _ -> x + y\ng = (+ 1) . (2 *) . (`div` 3) . (subtract 1)\nh = (,) 1 2\nk = (-1)\nl = -x + 2\nm = r { a = 1, b = 2 } { c = 3 }\nn = f x :: Int -> (Maybe a, [b])",
    "f x = case x of { 1 -> 2; _ -> 3 }\ng = do { a; b <- c; return b }\nh = if a then b else c\nm = do\n  if a\n  then b\n  else c\n  return ()",
    "f = g $ do\n  a\n  b\n where g = h\nx = 'a' : '\\'' : \"a \\\n   \\b\" ++ ['\\n', '\\x41', '\\DEL']\ny' = x'' where x'' = 0x1F + 1.5e-3",
    "f x\n  | x = 1\n  | otherwise\n  = 2\ng =\n  1\n  + 2\nh a b = a\n  where a = 1\n        b = 2",
    "f :: (Ord a, Show a) => a -> (a -> b) -> [b]\nf = undefined\nas qualified hiding = 1",
    "main = do\n    print 1\n    where\n    x = 2\n",
]
HASKELL_BAD = [
    "f x = ", "f x = (1", "f = 1)", "module A", "module a where", "f x = case x\n  1 -> 2", "f x = if x then 1", "f = let x = 1", "f = do\n  let x = 1", "f = do", "f = [1, 2", "f = \"abc", "{- open",
    "class A { int x; }", "public static void main", "<<<<<<< HEAD\nf = 1\n=======\nf = 2\n>>>>>>> x", "f | otherwise", "x = 1\nimport A", "f = \\ -> 1", "f x = x where\n  1", "data t = A", "f = x * - 1", "f = (x + ) y )",
    "f (x + y = 1", "f = {}", "type T", "f = 1 +", "f = + 1", "  f = 1\n g = 2", "f = x = y", "f x = do\n  y <-\n  z", "f = a where b = ", "f = _", "f = x@y", "1 + f = case of", "{\"a\": 1}", "f = a; ) b", "hello, world",
]


@pytest.mark.parametrize("text", JAVA_GOOD)
def test_java_accepts(text):
    assert syntax_java.errors(text) == []


@pytest.mark.parametrize("text", JAVA_BAD)
def test_java_rejects(text):
    assert syntax_java.errors(text)


@pytest.mark.parametrize("text", HASKELL_GOOD)
def test_haskell_accepts(text):
    assert syntax_haskell.errors(text) == []


@pytest.mark.parametrize("text", [t for t in HASKELL_BAD if t != "data t = A"])
def test_haskell_rejects(text):
    assert syntax_haskell.errors(text)


@pytest.mark.parametrize("text", HASKELL_BAD)
def test_haskell_rejects_all(text):
    assert syntax_haskell.errors(text)


HEADS_GOOD = [
    "data Eq a => T a = A", "data (Eq a, Show (f a)) => T f a = A", "data () => T = A", "newtype Ord (f Int) => N f = N (f Int)", "class C a", "class (Eq a, M.Ord a) => C a where", "class () => C a", "instance M.C M.T", "instance (Eq a, Eq b) => C (a, b)",
    "instance C ()", "instance C []", "instance C [a]", "instance C (->)", "instance C (,)", "instance C (,,)", "instance C (a -> b)", "instance C (Either e)", "instance C ((->) r)", "instance C ((,) a)", "instance C ([] a)", "instance C (T)", "type S a b = a -> [b]",
    "data T = [a] :+ !Int | !Int `B` [a] | Maybe a :* Maybe b | (:-) Int !a | A | B !Int (a -> b) ![c]", "data T = (:+) { a, b :: !Int, (+++) :: a -> b } | A {}", "newtype N a = N { un :: a -> b }", "newtype N a = (:+) [a]", "newtype N = N { (+++) :: Int }",
    "f :: () => Int\nf = 1", "f :: Eq (m a) => m a\nf = 1", "f :: (M.Eq a, Show (m a b)) => m a b\nf = 1",
]
HEADS_BAD = [
    "data tree = Leaf", "data T = red | blue", "class monoid a where", "type [a] = b", "data T = Int :+", "data T = :+ Int", "data T = A | ", "data T A = B", "data T [a] = B", "data M.T = A", "newtype n = N Int", "newtype N = N", "newtype N = N Int Int", "newtype N = N !Int",
    "newtype N = N { a, b :: Int }", "newtype N = N { a :: Int, b :: Int }", "newtype N = Int :+ Int", "newtype N = n Int", "data T = M.A", "data T = !Int", "data T = (Int)", "data T = [Int]", "data T = A !Int :+ Int", "data T = (:+) Int :+ Int", "data T = Int :+ Int :+ Int",
    "data T = Int : Int", "data T = Int `b` Int", "data T = A { b :: !Maybe Int }", "data T = A { B :: Int }", "type T = ", "type T a B = a", "type t = Int", "class C", "class C A", "class C a b", "class C (f a)", "class M.C a", "class a => C a",
    "class Eq [a] => C a", "class Eq (f a) => C f", "instance C", "instance c Int", "instance C a", "instance C [Int]", "instance C (Maybe Int)", "instance C Maybe a", "instance C (a)", "instance C (a b)", "instance C (a, Int)", "instance C (a -> Int)",
    "instance Eq (f a) => C (T f)", "instance eq a => C (T a)", "data a => T a = A", "data Eq Int => T = A", "data Eq (f) => T f = A", "f :: a => Int", "f :: Eq (Maybe a) => a", "f :: (Eq a => b) => a", "f :: Eq => a", "f :: (Eq a) => ",
]


@pytest.mark.parametrize("text", HEADS_GOOD)
def test_haskell_accepts_heads(text):
    assert syntax_haskell.errors(text) == []


@pytest.mark.parametrize("text", HEADS_BAD)
def test_haskell_rejects_heads(text):
    assert syntax_haskell.errors(text)


def test_recovery_finds_the_errors_behind():
    java = "class A {\n  void f() {\n    int x = ;\n    g();\n  }\n  void h() {\n    y = 1 2;\n    if (a { }\n  }\n  int z;\n}\n"
    assert [line for line, _ in syntax_java.errors(java)] == [3, 7, 8]
    assert [line for line, _ in syntax_haskell.errors("a = 1\nb = (\nc = 2\nd = )\ne = 3\n")] == [2, 4]


@pytest.mark.parametrize(
    "text, lines",
    [
        ("class C a where\n  f :: => a\n  g :: a\n  h = )\ninstance C Int where\n  f = 1 +) 2\n  g = 1\n  h = 2 = 3\n", [2, 4, 6, 8]),
        ("f = do\n  a ]\n  b <- )\n  let x = = 1\n      y = 2 )\n  c\ng = 1\nh = )\n", [2, 3, 4, 5, 8]),
        ("f x = y\n  where\n    a = )\n    b = 1\n    c = then\n", [3, 5]),
        ("f x = case x of\n  1 -> )\n  2 -> 3\n  4 -> = 5\n", [2, 4]),
        ("f = (do { a; b ]; c; = d; e }) )\n", [1, 1, 1]),
        ("f = if a then do\n    b )\n    c\n    d ]\n  else do\n    e }\n    g\n", [2, 4, 6]),
        ("f = let a = ) in let b = 1 in ]\n", [1, 1]),
        ("  f = )\n  g = 1\n  h = ]\n", [1, 3]),
        ("module A where {\nf = );\ng = 1;\nh = ]\n}\n", [2, 4]),
        ("  f = 1\n g = 2\n h = )\n", [2, 3]),
        ("f = g (do\n  a )\n  b)\ng = { \n", [3, 4]),
        ("f = do\n  x <- 1\ng = )\n", [2, 3]),
        ("f = do {\n a; )\n", [2, 2]),
    ],
)
def test_haskell_goes_on_in_blocks(text, lines):
    assert [line for line, _ in syntax_haskell.errors(text)] == lines


def test_memory_changes_nothing():
    """What was parsed before is accepted alike, and what wasn't isn't."""
    good, bad = "class A { void f() { if (a > 1) { x = f(1); } } }", "class A { void f() { if (a > ) { x = f(1); } } }"
    for _ in range(3):
        assert not syntax_java.errors(good) and syntax_java.errors(bad)


NESTED = [
    ("java", "class A { int x = ", "(", "1", ")", "; }"), ("java", "class A { void f() ", "{", "", "}", " }"), ("java", "class A { void f() { ", "if (a) ", ";", "", " } }"), ("java", "class A { ", "A<", "B", ">", " x; }"),
    ("java", "class A { int x = ", "a ? b : ", "c", "", "; }"), ("java", "class A { Object x = ", "() -> ", "1", "", "; }"), ("java", "class A { int x = ", "f(", "1", ")", "; }"), ("java", "class A { int[] x = ", "{", "1", "}", "; }"),
    ("haskell", "x = ", "(", "1", ")", "\n"), ("haskell", "x = ", "[", "1", "]", "\n"), ("haskell", "x = ", "if a then b else ", "c", "", "\n"), ("haskell", "x = ", "\\a -> ", "1", "", "\n"), ("haskell", "f ", "(", "x", ")", " = 1\n"), ("haskell", "x :: ", "(", "A", ")", "\n"),
]


@pytest.mark.parametrize("lang, head, left, middle, right, tail", NESTED)
def test_deep_nesting(lang, head, left, middle, right, tail):
    n = 20_000
    assert syntax.errors_of(lang, head + left * n + middle + right * n + tail) == []
    if right:
        assert syntax.errors_of(lang, head + left * n + middle + right * (n - 1) + tail)


def test_deep_nesting_in_spark(spark):
    text = "class A { int x = " + "(" * 5000 + "1" + ")" * 5000 + "; }"
    files = spark.createDataFrame([(1, 1, text), (2, 1, text[:-4]), (3, 2, "x = " + "(" * 5000 + "1" + ")" * 5000)], "file_id long, workspace_id long, content string")
    spaces = spark.createDataFrame([(1, "java"), (2, "haskell")], "workspace_id long, lang string")
    assert {r["file_id"]: r["valid"] for r in syntax.parse_files(files, spaces).collect()} == {1: True, 2: False, 3: True}


def test_files(spark):
    files = spark.createDataFrame(
        [(1, 1, "class A {}", "x"), (1, 1, "class A {}", "y"), (2, 1, "class A {", "x"), (3, 2, "f = 1", "x"), (4, 2, "f = ", "x"), (5, 3, "f", "x"), (6, None, "f", "x"), (7, 1, None, "x"), (None, 1, "x", "x"), (8, 4, "f", "x"), (9, 1, "", "x")],
        "file_id long, workspace_id long, content string, lang string",
    )
    spaces = spark.createDataFrame([(1, " Java"), (2, "HASKELL "), (3, None), (4, "cobol"), (None, "java")], "workspace_id long, lang string")
    parsed = syntax.parse_files(files, spaces)
    assert sorted((r["file_id"], r["lang"], r["valid"], r["first_line"]) for r in parsed.collect()) == [(1, "java", True, None), (2, "java", False, 1), (3, "haskell", True, None), (4, "haskell", False, 1), (9, "java", True, None)]
    assert sorted(tuple(r) for r in syntax.rates(parsed, "lang").collect()) == [("haskell", 2, 1, 0.5), ("java", 3, 1, 1 / 3)]
    assert syntax.parse_files(files.limit(0), spaces).count() == 0
