"""Java's tokens in SQL, for the comparison of the lexer with a second one: the text is cut by one pattern, and a token's line is told
by the line ends before it."""

from __future__ import annotations

from textloom.functions.java_tokens import KEYWORDS, NAMES

ENDS = r"\r\n|\n|\r"
NUMBERS = (
    ("HEX_FLOAT_LITERAL", r"0[xX][0-9a-fA-F_]*\.?[0-9a-fA-F_]*[pP][+-]?[0-9_]+[fFdD]?"),
    ("HEX_LITERAL", r"0[xX][0-9a-fA-F_]+[lL]?"),
    ("BINARY_LITERAL", r"0[bB][01_]+[lL]?"),
    ("FLOAT_LITERAL", r"(?:[0-9][0-9_]*\.[0-9_]*|\.[0-9][0-9_]*)(?:[eE][+-]?[0-9_]+)?[fFdD]?|[0-9][0-9_]*(?:[eE][+-]?[0-9_]+[fFdD]?|[fFdD])"),
    ("OCT_LITERAL", r"0[0-7_]+[lL]?"),
    ("DECIMAL_LITERAL", r"[0-9][0-9_]*[lL]?"),
)
WORD = r"[\p{L}_$][\p{L}\p{N}_$]*"
SIGNS = "|".join("".join("\\" + c for c in x) for x in sorted(NAMES, key=len, reverse=True))
TOKEN = "|".join(
    [rf"[ \t]*(?:{ENDS})[ \t]*", " {2,}", " ", r"[\t\f]+", r"/\*[\s\S]*?\*/ *", r"//[^\r\n]*", r'"(?:[^"\\\r\n]|\\.)*"', r"'(?:[^'\\\r\n]|\\[^\r\n]+?)'", WORD, *(f"(?:{x})" for _, x in NUMBERS), SIGNS, "."]
)


def q(text: str) -> str:
    """A literal of SQL."""
    return "'" + text.replace("'", "''") + "'"


def kind(x: str) -> str:
    """The name of a token; null for line ends and tabs."""
    rules = [
        (rf"regexp_matches({x}, '^[ \t]*[\r\n]') OR regexp_full_match({x}, '[\t\f]+')", "NULL"),
        (f"{x} = ' '", "'WS'"),
        (f"regexp_full_match({x}, ' +')", "'LONG_WS'"),
        (f"starts_with({x}, '/*')", "'COMMENT'"),
        (f"starts_with({x}, '//')", "'LINE_COMMENT'"),
        (f"len({x}) > 1 AND starts_with({x}, {q('"')})", "'STRING_LITERAL'"),
        (f"len({x}) > 1 AND starts_with({x}, {q("'")})", "'CHAR_LITERAL'"),
        (f"{x} IN ('true', 'false')", "'BOOL_LITERAL'"),
        (f"{x} = 'null'", "'NULL_LITERAL'"),
        (f"{x} IN ({', '.join(map(q, sorted(KEYWORDS)))})", f"upper({x})"),
        (f"regexp_full_match({x}, {q(WORD)})", "'IDENTIFIER'"),
        *((f"regexp_full_match({x}, {q(r)})", q(n)) for n, r in NUMBERS),
        *((f"{x} = {q(s)}", q(n)) for s, n in NAMES.items()),
    ]
    return "CASE " + " ".join(f"WHEN {a} THEN {b}" for a, b in rules) + " ELSE 'OTHER' END"


def tokens(files: str) -> str:
    """WITH ... of the tables jt (file_id, n, kind, x, line, channel), a row for each token, and jp, a row for each of its lines.
    ``files`` defines f (file_id, content, workspace_id)."""
    return f"""WITH {files}, wl AS (SELECT workspace_id, min(lower(trim(lang))) AS lang FROM workspaces WHERE workspace_id IS NOT NULL AND lang IS NOT NULL GROUP BY 1),
jf AS (SELECT file_id, regexp_extract_all(content, {q(TOKEN)}) AS t FROM f JOIN wl USING (workspace_id) WHERE content IS NOT NULL AND wl.lang = 'java'),
jx AS (SELECT file_id, unnest(t) AS x, generate_subscripts(t, 1) AS n FROM jf),
jk AS (SELECT file_id, n, {kind("x")} AS kind, CASE WHEN starts_with(x, '/*') THEN rtrim(x, ' ') ELSE x END AS x, 1 + coalesce(sum(len(regexp_extract_all(x, {q(ENDS)}))) OVER (PARTITION BY file_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line FROM jx),
jt AS (SELECT *, CASE kind WHEN 'WS' THEN 2 WHEN 'LONG_WS' THEN 3 WHEN 'COMMENT' THEN 4 WHEN 'LINE_COMMENT' THEN 4 ELSE 0 END AS channel FROM jk WHERE kind IS NOT NULL),
jp AS (SELECT file_id, n, line - 1 + generate_subscripts(p, 1) AS line, unnest(p) AS x, channel FROM (SELECT *, CASE WHEN channel = 4 THEN list_transform(string_split_regex(x, {q(ENDS)}), lambda y: regexp_replace(y, '^[\\x00-\\x20]+|[\\x00-\\x20]+$', '', 'g')) ELSE [x] END AS p FROM jt))
"""


def lines(value: str, channels: str) -> str:
    """The text of each line, of the tokens on the given channels."""
    return f"SELECT file_id, line::INT AS line, string_agg({value}, '' ORDER BY n) AS value FROM jp WHERE channel IN ({channels}) GROUP BY file_id, line"


NAMED = f"""SELECT file_id, line::INT AS line, string_agg(kind, ' ' ORDER BY n) AS value
FROM (SELECT file_id, n, kind, line + CASE WHEN channel = 4 THEN len(regexp_extract_all(x, {q(ENDS)})) ELSE 0 END AS line FROM jt WHERE channel IN (0, 4)) GROUP BY file_id, line"""
