"""Tokens of Java source with their names, channels and lines."""

from __future__ import annotations

import re
from typing import NamedTuple

#: Channels. Hidden tokens (line ends) carry no text and aren't kept.
DEFAULT, HIDDEN, WHITESPACE, LONG_WHITESPACE, COMMENT = range(5)
CHANNELS = ("DEFAULT", "HIDDEN", "WHITESPACE", "LONG_WHITESPACE", "COMMENT")

KEYWORDS = frozenset(
    (
        "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for if goto implements import "
        "instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient "
        "try void volatile while"
    ).split()
)
# The names of separators and operators.
NAMES = {
    "(": "LPAREN", ")": "RPAREN", "{": "LBRACE", "}": "RBRACE", "[": "LBRACK", "]": "RBRACK", ";": "SEMI", ",": "COMMA", ".": "DOT", "=": "ASSIGN", ">": "GT", "<": "LT",
    "!": "BANG", "~": "TILDE", "?": "QUESTION", ":": "COLON", "==": "EQUAL", "<=": "LE", ">=": "GE", "!=": "NOTEQUAL", "&&": "AND", "||": "OR", "++": "INC", "--": "DEC",
    "+": "ADD", "-": "SUB", "*": "MUL", "/": "DIV", "&": "BITAND", "|": "BITOR", "^": "CARET", "%": "MOD", "+=": "ADD_ASSIGN", "-=": "SUB_ASSIGN", "*=": "MUL_ASSIGN",
    "/=": "DIV_ASSIGN", "&=": "AND_ASSIGN", "|=": "OR_ASSIGN", "^=": "XOR_ASSIGN", "%=": "MOD_ASSIGN", "<<=": "LSHIFT_ASSIGN", ">>=": "RSHIFT_ASSIGN", ">>>=": "URSHIFT_ASSIGN",
    "->": "ARROW", "::": "COLONCOLON", "@": "AT", "...": "ELLIPSIS",
}

TOKEN = re.compile(
    r"""
    (?P<NEWLINE>[ \t]*(?:\r?\n|\r)[ \t]*)
  | (?P<LONG>\x20{2,}) | (?P<SPACE>\x20) | (?P<TAB>[\t\f]+)
  | (?P<COMMENT>/\*[\s\S]*?\*/)\x20* | (?P<LINE_COMMENT>//[^\r\n]*)
  | (?P<TEXT_BLOCK>\"\"\"[ \t]*[\r\n](?:[^\\]|\\.)*?\"\"\")
  | (?P<STRING_LITERAL>"(?:[^"\\\r\n]|\\.)*") | (?P<CHAR_LITERAL>'(?:[^'\\\r\n]|\\[^\r\n]+?)')
  | (?P<WORD>(?:[^\W\d]|\$)[\w$]*)
  | (?P<HEX_FLOAT_LITERAL>0[xX][0-9a-fA-F_]*\.?[0-9a-fA-F_]*[pP][+-]?[0-9_]+[fFdD]?)
  | (?P<HEX_LITERAL>0[xX][0-9a-fA-F_]+[lL]?) | (?P<BINARY_LITERAL>0[bB][01_]+[lL]?)
  | (?P<FLOAT_LITERAL>(?:[0-9][0-9_]*\.[0-9_]*|\.[0-9][0-9_]*)(?:[eE][+-]?[0-9_]+)?[fFdD]?|[0-9][0-9_]*(?:[eE][+-]?[0-9_]+[fFdD]?|[fFdD]))
  | (?P<OCT_LITERAL>0[0-7_]+[lL]?) | (?P<DECIMAL_LITERAL>[0-9][0-9_]*[lL]?)
  | (?P<OPERATOR>\.\.\.|->|::|\+\+|--|&&|\|\||>>>=|>>=|<<=|==|<=|>=|!=|[-+*/&|^%]=|[(){}\[\];,.=><!~?:+\-*/&|^%@])
  | (?P<OTHER>.)
    """,
    re.VERBOSE,
)


class Token(NamedTuple):
    pos: int
    type: str
    text: str
    channel: int
    line: int
    char: int = 0


def tokens(text: str) -> list[Token]:
    """All tokens but line ends and tabs. A lone space and a longer run are on channels of their own, and comments on another."""
    out: list[Token] = []
    line, start = 1, 0
    for m in TOKEN.finditer(text):
        kind, t = m.lastgroup, m.group()
        at, char = line, m.start() - start
        if "\n" in t or "\r" in t:
            ends = list(re.finditer(r"\r\n|\n|\r", t))
            line += len(ends)
            start = m.start() + ends[-1].end()
        if kind in ("NEWLINE", "TAB"):
            continue
        channel = DEFAULT
        if kind == "SPACE":
            name, channel = "WS", WHITESPACE
        elif kind == "LONG":
            name, channel = "LONG_WS", LONG_WHITESPACE
        elif kind in ("COMMENT", "LINE_COMMENT"):
            name, channel, t = kind, COMMENT, m.group(kind)
        elif kind == "WORD":
            name = "BOOL_LITERAL" if t in ("true", "false") else "NULL_LITERAL" if t == "null" else t.upper() if t in KEYWORDS else "IDENTIFIER"
        elif kind == "OPERATOR":
            name = NAMES[t]
        else:
            name = kind
        out.append(Token(len(out), name, t, channel, at, char))
    return out
