"""Tokens of Haskell source, with the braces and semicolons that its layout stands for."""

from __future__ import annotations

import re

from textloom.functions.java_tokens import DEFAULT, Token

KEYWORDS = frozenset("case class data default deriving do else export family forall foreign if import in infix infixl infixr instance let mdo module newtype of pattern rec then type where".split())
LAYOUT = frozenset(("where", "let", "do", "mdo", "of", "rec"))
OPEN, SEMI, CLOSE = "VOCURLY", "SEMI", "VCCURLY"
SYMBOL = r"!#$%&*+./<=>?@\\^|~:\-"
RESERVED = {"..": "DotDot", ":": "Colon", "::": "DoubleColon", "=": "Eq", "\\": "ReverseSlash", "|": "Pipe", "<-": "Revarrow", "->": "Arrow", "@": "Atsign", "~": "Tilde", "=>": "DoubleArrow"}
SPECIAL = {"(": "OpenRoundBracket", ")": "CloseRoundBracket", "[": "OpenSquareBracket", "]": "CloseSquareBracket", ",": "Comma", ";": "Semi", "`": "BackQuote", "{": "OCURLY", "}": "CCURLY"}

TOKEN = re.compile(
    rf"""
    (?P<NEWLINE>\r?\n|\r) | (?P<WS>[ \f]+) | (?P<TAB>\t+)
  | (?P<COMMENT>--+(?![{SYMBOL}])[^\r\n]*) | (?P<OPENCOMMENT>\{{-)
  | (?P<STRING>"(?:[^"\\\r\n]|\\\s+\\|\\.)*") | (?P<CHAR>'(?:[^'\\\r\n]|\\[^'\r\n]+|\\')')
  | (?P<WORD>(?:[A-Z][\w']*\.)*[^\W\d][\w']*)
  | (?P<FLOAT>[0-9]+\.[0-9]+(?:[eE][+-]?[0-9]+)?|[0-9]+[eE][+-]?[0-9]+) | (?P<HEXADECIMAL>0[xX][0-9a-fA-F]+) | (?P<OCTAL>0[oO][0-7]+) | (?P<DECIMAL>[0-9]+)
  | (?P<SYMBOLS>[{SYMBOL}]+) | (?P<SPECIAL>[()\[\],;`{{}}]) | (?P<OTHER>.)
    """,
    re.VERBOSE,
)
_NEST = re.compile(r"\{-|-\}")


def plain_tokens(text: str) -> list[tuple[str, str, int, int]]:
    """(type, text, line, column from 0), without blanks and comments, which nest; a tab counts eight columns."""
    out = []
    line, column, p = 1, 0, 0
    while p < len(text):
        m = TOKEN.match(text, p)
        kind, t = m.lastgroup, m.group()
        p = m.end()
        if kind == "NEWLINE":
            line, column = line + 1, 0
            continue
        if kind == "OPENCOMMENT":
            depth = 1
            while depth and (n := _NEST.search(text, p)):
                depth += 1 if n.group() == "{-" else -1
                p = n.end()
            if depth:
                p = len(text)
            t = text[m.start() : p]
            ends = t.count("\n")
            line += ends
            column = len(t) - t.rfind("\n") - 1 if ends else column + len(t)
            continue
        at = column
        column += 8 * len(t) if kind == "TAB" else len(t)
        if kind in ("WS", "TAB", "COMMENT"):
            continue
        if kind == "STRING" and "\n" in t:
            out.append((kind, t, line, at))
            line += t.count("\n")
            column = len(t) - t.rfind("\n") - 1
            continue
        if kind == "WORD":
            last = t.rpartition(".")[2] if "." in t else t
            kind = t.upper() if t in KEYWORDS else "CONID" if last[0].isupper() else "VARID"
        elif kind == "SYMBOLS":
            kind = RESERVED.get(t, "OPERATOR")
        elif kind == "SPECIAL":
            kind = SPECIAL[t]
        out.append((kind, t, line, at))
    return out


def tokens(text: str) -> list[Token]:
    """All tokens with virtual braces and semicolons, whose text is their name.

    A block opens at the first token of the body and after each layout keyword, unless a brace follows; a token at the column of
    the open block begins an item, one left of it closes it. ``in`` closes blocks up to that of its ``let``; ``where`` closes
    blocks of ``do`` and ``of`` at or right of it; a closing bracket or comma closes what was opened since its own opened.
    """
    source = plain_tokens(text)
    out: list[Token] = []
    blocks: list[tuple[str, int, int]] = []  # keyword, column, brackets open at its start

    def emit(kind: str, t: str, line: int, char: int):
        out.append(Token(len(out), kind, t, DEFAULT, line, char))

    def close(line: int):
        emit(SEMI, SEMI, line, 0)
        emit(CLOSE, CLOSE, line, 0)
        blocks.pop()

    pending: str | None = None
    explicit = 0
    brackets = 0
    seen_line = 0
    module = bool(source) and source[0][1] == "module"
    if source and not module and source[0][1] != "{":
        pending = "top"
    for kind, t, line, column in source:
        if pending and t == "{":
            explicit += 1
            pending = None
            emit(kind, t, line, column)
            seen_line = line
            continue
        if pending:
            around = blocks[-1][1] if blocks else -1
            if column > around or pending == "top":
                emit(OPEN, OPEN, line, column)
                blocks.append((pending, column, brackets))
                pending = None
                seen_line = line
            else:
                emit(OPEN, OPEN, line, column)
                emit(CLOSE, CLOSE, line, column)
                pending = None
        ended_let = False
        if line != seen_line and not explicit:
            while blocks and column < blocks[-1][1] and not (t == "in" and ended_let):
                ended_let = blocks[-1][0] == "let"
                close(line)
            if blocks and column == blocks[-1][1] and t not in ("then", "else", "of", "in", ")", "]", ",") and not (t == "where" and blocks[-1][0] in ("do", "mdo", "of")):
                emit(SEMI, SEMI, line, column)
        seen_line = line
        if t == "in" and not explicit and not ended_let and any(b[0] == "let" for b in blocks):
            while blocks and blocks[-1][0] != "let":
                close(line)
            if blocks:
                close(line)
        elif t == "where" and not explicit:
            while blocks and blocks[-1][0] in ("do", "mdo", "of") and column <= blocks[-1][1]:
                close(line)
        elif t in (")", "]", ",") and not explicit:
            while blocks and blocks[-1][2] >= brackets and blocks[-1][2] > 0 and blocks[-1][0] != "top":
                if t == "," and blocks[-1][0] not in ("of", "do", "mdo", "let"):
                    break
                close(line)
        if t in ("(", "["):
            brackets += 1
        elif t in (")", "]"):
            brackets -= 1
        elif t == "}" and explicit:
            explicit -= 1
        emit(kind, t, line, column)
        if t in LAYOUT:
            pending = t if not (module and t == "where" and not blocks and not explicit) else "top"
    last = source[-1][2] if source else 1
    if pending and pending != "top":
        emit(OPEN, OPEN, last, 0)
        emit(CLOSE, CLOSE, last, 0)
    while blocks:
        close(last)
    return out
