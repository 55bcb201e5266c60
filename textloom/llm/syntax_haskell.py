"""A recursive-descent parser for the syntax of Haskell 2010, with layout, that keeps going after errors.

Tokens become one character each; a line is its column and its kinds, and the column of a token after a layout keyword is kept.
The layout rule is part of the descent: a token at the column of the open block begins a new item, one left of it closes the
block, and a block also ends where the next token can't continue it (the rule that lets ``let x = 1 in x`` stand on one line).
Expressions are parsed by precedence climbing as far as syntax goes: a minus sign can't follow an operator that binds as tightly.
Patterns are read as expressions, and each is held against what only the one or the other may contain.

After an error the parser goes on with the next item of the innermost block around it. As blocks also end where the next token
can't continue them, an item is only given up at a token that nothing around its block waits for (``Parser.open``). The first error
is that of a parser without recovery. Declarations parse alike in every file; those seen before are remembered by their kinds and
columns.
"""

from __future__ import annotations

import re

KEYWORDS = "case class data default deriving do else foreign if import in infix infixl infixr instance let module newtype of then type where".split()
KIND = {w: chr(0x4E00 + i) for i, w in enumerate(KEYWORDS)}
KIND |= {"as": "a", "qualified": "q", "hiding": "h", "_": "_"}
KIND |= {x: x for x in "()[],;`{}"}
KIND |= {"..": "…", ":": ":", "::": "∷", "=": "=", "\\": "\\", "|": "|", "<-": "←", "->": "→", "@": "@", "~": "~", "=>": "⇒", "-": "-", "!": "!"}
#: Operators of the Prelude that bind as tightly as a minus sign, or tighter.
KIND |= dict.fromkeys(("+", "*", "/", "^", "^^", "**", "."), "p")
#: Operators of the Prelude that bind less tightly.
KIND |= dict.fromkeys(("$", "$!", ">>", ">>=", "=<<", "||", "&&", "==", "/=", "<", "<=", ">", ">=", "++", "<$>", "<$", "<*>", "<*", "*>"), "o")
VAR, CON, QVAR, QCON, NUMBER, STRING, CHAR, OP, CONOP, WRONG, END = "v", "C", "w", "Q", "n", "s", "c", "x", "X", "E", " "
(CASE, CLASS, DATA, DEFAULT, DERIVING, DO, ELSE, FOREIGN, IF, IMPORT, IN, INFIX, INFIXL, INFIXR, INSTANCE, LET, MODULE, NEWTYPE, OF, THEN, TYPE, WHERE) = (KIND[w] for w in KEYWORDS)
LAYOUT = frozenset((DO, LET, OF, WHERE))
#: What ends what follows a keyword; after ``if`` there is ``else`` as well.
ENDS = {LET: IN, IF: THEN, CASE: OF}
VARS = frozenset("vaqh")
OPS = frozenset("opx!-X:~")
SYMBOLS = frozenset("opx!-")
COLUMN = 0xF000  # characters from here on are columns

_SYM = r"!#$%&*+./<=>?@\\^|~:\-"
_ESC = r"\\(?:[abfnrtv\\\"'&]|\^[A-Z@\[\\\]^_]|[0-9]+|o[0-7]+|x[0-9a-fA-F]+|[A-Z]{2,3}[0-9]?)"
TOKEN = re.compile(
    rf"--+(?![{_SYM}]).*"
    rf"|\"(?:[^\"\\\n]|{_ESC}|\\\s+\\)*\"|'(?:[^'\\\n]|{_ESC})'(?!')"
    r"|(?:[A-Z][\w']*\.)+(?:[a-z_][\w']*|[A-Z][\w']*|[!#$%&*+./<=>?@\\^|~:\-]+)"
    r"|[^\W\d][\w']*"
    r"|0[xX][0-9a-fA-F]+|0[oO][0-7]+|[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?"
    rf"|[{_SYM}]+|\S"
)
_BLOCK = re.compile(rf"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.[^'\n]*)'|--+(?![{_SYM}])[^\n]*|\{{-|-\}}")
_GAP = re.compile(r"\\[ \t]*\n\s*\\")


class Kinds(dict):
    def __init__(self, most: int = 500_000):
        super().__init__(KIND)
        self.most = most

    def __missing__(self, t: str) -> str:
        c = t[0]
        if c == '"':
            return STRING if len(t) > 1 else WRONG
        if c == "'":
            return CHAR if len(t) > 1 else WRONG
        if c == "-" and t.startswith("--") and not t.strip("-").startswith(tuple("!#$%&*+./<=>?@\\^|~:")):
            return ""
        if c.isdecimal():
            kind = NUMBER
        elif c == "_" or c.isalpha():
            last = t.rpartition(".")[2] if "." in t else t
            if "." in t and not t[-1].isalnum() and t[-1] not in "_'":
                kind = "x" if ":" not in t else "X"
            elif "." in t:
                kind = QCON if last[0].isupper() else QVAR
            else:
                kind = CON if c.isupper() else VAR
        elif c in "!#$%&*+./<=>?@\\^|~:-":
            kind = CONOP if c == ":" else OP
        else:
            return WRONG
        if len(self) >= self.most:
            self.clear()
            self.update(KIND)
        self[t] = kind
        return kind


class Wrong(Exception):
    def __init__(self, at: int, want: str):
        self.at, self.want = at, want


def without_comments(text: str) -> tuple[str, bool]:
    """The text with block comments blanked out, which nest, and whether they all end."""
    out, last, depth, begun = [], 0, 0, 0
    p = 0
    inside = re.compile(r"\{-|-\}")
    while True:
        m = (inside if depth else _BLOCK).search(text, p)
        if not m:
            break
        t = m.group()
        p = m.end()
        if t == "{-":
            if not depth:
                begun = m.start()
            depth += 1
        elif t == "-}" and depth:
            depth -= 1
            if not depth:
                out.append(text[last:begun])
                out.append(re.sub(r"[^\n\t]", " ", text[begun:p]))
                last = p
    out.append(text[last:])
    return "".join(out), not depth


_KINDS = Kinds()


def encode(text: str) -> tuple[list[tuple[int, str]], bool]:
    """(line number, its column and kinds) of each line that has tokens; and whether comments end."""
    closed = True
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    if "{-" in text:
        text, closed = without_comments(text)
    if "\\" in text and _GAP.search(text):
        text = _GAP.sub(lambda m: "\\&" + "\n" * 0, text)
    out = []
    get, find = _KINDS.__getitem__, TOKEN.findall
    for n, line in enumerate(text.split("\n"), 1):
        body = line.lstrip(" ")
        if not body:
            continue
        if "\t" in line:
            line = line.expandtabs(8)
            body = line.lstrip()
            if not body:
                continue
        kinds = "".join(map(get, find(body)))
        if not kinds:
            continue
        indent = len(line) - len(body)
        if LAYOUT & set(kinds[:-1]):
            parts, after = [], False
            for m in TOKEN.finditer(line, indent):
                k = get(m.group())
                if k and after:
                    parts.append(chr(COLUMN + min(m.start() + 1, 0x7FF)))
                if k:
                    parts.append(k)
                    after = k in LAYOUT
            kinds = "".join(parts)
        out.append((n, chr(COLUMN + 0x800 + min(indent + 1, 0x7FE)) + kinds))
    return out, closed


class Parser:
    """Over the kinds of one stretch. ``first[i]`` is the column of a token that is the first of its line, else 0; ``col[i]`` the
    column of a token where it is known."""

    def __init__(self, stretch: str, recover: bool = False):
        k, first, col = [], [], []
        f = c = 0
        for ch in stretch:
            o = ord(ch)
            if COLUMN <= o < COLUMN + 0x1000:
                if o >= COLUMN + 0x800:
                    f = c = o - COLUMN - 0x800
                else:
                    c = o - COLUMN
                continue
            k.append(ch)
            first.append(f)
            col.append(c)
            f = c = 0
        k.append(END)
        first.append(0)
        col.append(0)
        self.k, self.first, self.col, self.p, self.seen = k, first, col, 0, -1
        self.blocks: list[int] = []
        self.only_exp = self.only_pat = -1
        self.recover = recover
        self.noted: list[tuple[int, str]] = []
        #: What each construct around waits for, and so may end a block in it.
        self.open: list[str] = []

    def fail(self, want: str):
        raise Wrong(self.p, want)

    # layout

    def tok(self) -> str:
        """The kind of the next token; ``;`` before a new item is ``\\n`` and the end of a block ``\\r``."""
        p = self.p
        k = self.k[p]
        if self.blocks:
            b = self.blocks[-1]
            if b:
                if k == END:
                    return "\r"
                f = self.first[p]
                if f and self.seen != p:
                    if f == b:
                        return "\n"
                    if f < b:
                        return "\r"
                elif f and f < b:
                    return "\r"
        return k

    def next(self):
        self.p += 1

    def need(self, kind: str, want: str | None = None):
        if self.tok() != kind:
            self.fail(want or kind)
        self.p += 1

    def block(self, item, closers: frozenset = frozenset()):
        """Items of a block after a layout keyword."""
        p = self.p
        if self.k[p] == "{" and self.tok() == "{":
            self.p += 1
            self.blocks.append(0)
            self.open.append("}")
            while self.tok() == ";":
                self.p += 1
            while self.tok() != "}":
                self.attempt(item)
                if self.tok() == ";":
                    while self.tok() == ";":
                        self.p += 1
                elif self.tok() != "}":
                    self.fail("; or }")
            self.blocks.pop()
            self.open.pop()
            self.p += 1
            return
        around = next((b for b in reversed(self.blocks)), 0)
        column = self.col[p]
        if self.k[p] == END or column <= around:
            return
        self.blocks.append(column)
        depth = len(self.blocks)
        self.seen = p
        while True:
            while self.tok() in (";", "\n"):
                if self.tok() == ";":
                    self.p += 1
                else:
                    self.seen = self.p
            t = self.tok()
            if t == "\r" or (t in ")]},` " or t in (THEN, ELSE, OF, IN, WHERE)) and (not self.recover or self.awaited(t)):
                break
            self.attempt(item)
            if self.tok() not in (";", "\n"):
                break
        del self.blocks[depth - 1 :]

    # recovery

    def attempt(self, item):
        """An item of a block; in recovery an error in it is noted, and what is left of it skipped."""
        if not self.recover:
            item()
            return
        if self.k[self.p] == END:
            self.fail("}")
        start, blocks, opened, only = self.p, list(self.blocks), list(self.open), (self.only_exp, self.only_pat)
        try:
            item()
            if not self.ends_item():
                self.fail("end of item")
        except Wrong as e:
            self.noted.append((e.at, e.want))
            self.blocks, self.open = blocks, opened
            self.only_exp, self.only_pat = only
            self.skip(start, e.at)

    def awaited(self, t: str) -> bool:
        """Whether something around waits for this token, seen from within the innermost brackets."""
        for o in reversed(self.open):
            if t in o:
                return True
            if o[0] in ")]}":
                break
        return False

    def ends_item(self) -> bool:
        t = self.tok()
        if not self.blocks[-1]:
            return t in ";}"
        if t in ";\n\r" or self.awaited(t):
            return True
        op = self.operator()
        # one that stands before a parenthesis ends a section
        return bool(op) and (self.k[self.p + (3 if op in "bB" else 1)] != ")" or self.awaited(")"))

    def skip(self, start: int, at: int):
        """To the end of the item that began at ``start``, from an error on: a token that begins the next one or ends the block."""
        k, first, b, p, depth = self.k, self.first, self.blocks[-1], start, 0
        inner = dict.fromkeys((IN, THEN, ELSE, OF), 0)
        while k[p] != END:
            t = k[p]
            if p > start and p >= at:
                if b and 0 < first[p] <= b:
                    break
                if not depth and (t == ";" or t in ")]}," and self.awaited(t) or t in inner and not inner[t] and self.awaited(t)):
                    break
            if t in "([{":
                depth += 1
            elif t in ")]}":
                depth = max(0, depth - 1)
            elif t in ENDS:
                inner[ENDS[t]] += 1
                if t == IF:
                    inner[ELSE] += 1
            elif t in inner:
                inner[t] = max(0, inner[t] - 1)
            p += 1
        self.p, self.seen = p, -1

    # patterns read as expressions

    def pattern(self, read):
        save = self.only_exp, self.only_pat
        self.only_exp = self.only_pat = -1
        read()
        if self.only_exp >= 0:
            self.p = self.only_exp
            self.fail("pattern")
        self.only_exp, self.only_pat = save

    def expression(self, read=None):
        save = self.only_exp, self.only_pat
        self.only_exp = self.only_pat = -1
        (read or self.exp)()
        if self.only_pat >= 0:
            self.p = self.only_pat
            self.fail("expression")
        self.only_exp, self.only_pat = save

    def is_exp(self, at: int):
        if self.only_exp < 0:
            self.only_exp = at

    def is_pat(self, at: int):
        if self.only_pat < 0:
            self.only_pat = at

    # expressions

    def exp(self):
        self.infix()
        if self.tok() == "∷":
            self.is_exp(self.p)
            self.p += 1
            self.type_with_context()

    def operator(self) -> str:
        """The operator here, without reading it; '' if there is none. A backquoted name is ``b``, a constructor's ``B``."""
        t = self.tok()
        if t == "`":
            a, b = self.k[self.p + 1], self.k[self.p + 2]
            if b == "`" and (a in VARS or a in "wCQ"):
                return "B" if a in "CQ" else "b"
            return ""
        return t if t in OPS else ""

    def take_operator(self):
        self.p += 3 if self.k[self.p] == "`" else 1

    def infix(self):
        tight = False
        while True:
            if self.tok() == "-":
                if tight:
                    self.fail("operand")
                self.p += 1
                if self.tok() not in "nN":
                    self.is_exp(self.p - 1)
                tight = True
            self.operand()
            op = self.operator()
            if not op or op == "~":
                return
            if op in SYMBOLS or op == "b":
                self.is_exp(self.p)
            save = self.p
            self.take_operator()
            if self.tok() == ")" and save > 0:
                # a section: the caller closes it
                self.p = save
                return
            tight = op in "p-"

    def operand(self):
        t = self.tok()
        if t == "\\":
            self.is_exp(self.p)
            self.p += 1
            n = 0
            while self.tok() != "→":
                self.pattern(self.aexp)
                n += 1
            if not n:
                self.fail("pattern")
            self.p += 1
            self.expression()
        elif t == LET:
            self.is_exp(self.p)
            self.p += 1
            self.open.append(IN)
            self.block(self.declaration)
            self.open.pop()
            self.need(IN, "in")
            self.expression()
        elif t == IF:
            self.is_exp(self.p)
            self.p += 1
            self.open.append(THEN)
            self.expression()
            self.optional_semicolon(THEN)
            self.need(THEN, "then")
            self.open[-1] = ELSE
            self.expression()
            self.optional_semicolon(ELSE)
            self.open.pop()
            self.need(ELSE, "else")
            self.expression()
        elif t == CASE:
            self.is_exp(self.p)
            self.p += 1
            self.open.append(OF)
            self.expression()
            self.open.pop()
            self.need(OF, "of")
            self.block(self.alternative)
        elif t == DO:
            self.is_exp(self.p)
            self.p += 1
            self.last_statement = ""
            before = self.p
            self.do_block()
            if self.p == before:
                self.fail("statement")
        else:
            self.aexp()
            while self.starts_aexp():
                self.aexp()

    def optional_semicolon(self, keyword: str):
        if self.tok() == "\n" and self.k[self.p] == keyword:
            self.seen = self.p
        elif self.tok() == ";" and self.k[self.p + 1] == keyword:
            self.p += 1

    def do_block(self):
        last = [""]

        def item():
            last[0] = "e"
            last[0] = self.statement()

        self.block(item)
        if last[0] != "e":
            self.fail("expression as the last statement")

    def statement(self) -> str:
        if self.tok() == LET:
            save, blocks, seen, n = self.p, list(self.blocks), self.seen, len(self.noted)
            self.p += 1
            self.open.append(IN)
            self.block(self.declaration)
            self.open.pop()
            if self.tok() != IN:
                return "l"
            self.p, self.blocks, self.seen = save, blocks, seen
            del self.noted[n:]
        return "b" if self.bind_or_exp() else "e"

    def bind_or_exp(self) -> bool:
        save = self.only_exp, self.only_pat
        self.only_exp = self.only_pat = -1
        self.exp()
        bind = self.tok() == "←"
        wrong = self.only_exp if bind else self.only_pat
        if wrong >= 0:
            self.p = wrong
            self.fail("pattern" if bind else "expression")
        self.only_exp, self.only_pat = save
        if bind:
            self.p += 1
            self.expression()
        return bind

    def starts_aexp(self) -> bool:
        t = self.tok()
        return t in VARS or t in "wCQnsc([_~" and not (t == "~" and not self.only_pattern_here())

    def only_pattern_here(self) -> bool:
        return True

    def aexp(self):
        t = self.tok()
        if t in VARS or t in "wCQ":
            self.p += 1
            if t in VARS and self.tok() == "@":
                self.is_pat(self.p)
                self.p += 1
                self.aexp()
                return
        elif t in "nsc":
            self.p += 1
        elif t == "_":
            self.is_pat(self.p)
            self.p += 1
        elif t == "~":
            self.is_pat(self.p)
            self.p += 1
            self.aexp()
            return
        elif t == "(":
            self.open.append("),")
            self.parenthesized()
            self.open.pop()
        elif t == "[":
            self.open.append("],|…")
            self.bracketed()
            self.open.pop()
        else:
            self.fail("expression")
        while self.tok() == "{":
            self.open.append("},")
            self.record()
            self.open.pop()

    def record(self):
        self.p += 1
        self.blocks.append(0)
        if self.tok() == "…":
            self.fail("field")
        while self.tok() != "}":
            if self.tok() not in VARS and self.tok() != "w" and self.tok() != "(":
                self.fail("field")
            if self.tok() == "(":
                self.fail("field")
            self.p += 1
            self.need("=")
            self.exp()
            if self.tok() == ",":
                self.p += 1
                if self.tok() == "}":
                    self.fail("field")
            elif self.tok() != "}":
                self.fail("}")
        self.p += 1
        self.blocks.pop()

    def parenthesized(self):
        self.p += 1
        t = self.tok()
        if t == ")":
            self.p += 1
            return
        if t == ",":
            while self.tok() == ",":
                self.p += 1
            self.need(")")
            return
        op = self.operator()
        if op and op != "~":
            save = self.p
            self.take_operator()
            if self.tok() == ")":
                self.p += 1
                if op in "bB":
                    self.p = save
                    self.fail("expression")
                return
            if op == "-":
                self.p = save
            else:
                self.is_exp(save)
                self.infix()
                self.need(")")
                return
        elif t == "~" and self.k[self.p + 1] == ")":
            self.fail("expression")
        self.exp_in_brackets()
        op = self.operator()
        if op and op != "~":
            self.is_exp(self.p)
            self.take_operator()
            self.need(")")
            return
        while self.tok() == ",":
            self.p += 1
            self.exp_in_brackets()
        self.need(")")

    def exp_in_brackets(self):
        self.exp()
        if self.tok() == "→":
            self.fail(")")

    def bracketed(self):
        self.p += 1
        if self.tok() == "]":
            self.p += 1
            return
        self.exp()
        t = self.tok()
        if t == "…":
            self.is_exp(self.p)
            self.p += 1
            if self.tok() != "]":
                self.exp()
        elif t == "|":
            self.is_exp(self.p)
            self.p += 1
            while True:
                self.qualifier()
                if self.tok() != ",":
                    break
                self.p += 1
        else:
            n = 1
            while self.tok() == ",":
                self.p += 1
                self.exp()
                n += 1
            if self.tok() == "…" and n == 2:
                self.is_exp(self.p)
                self.p += 1
                if self.tok() != "]":
                    self.exp()
        self.need("]")

    def qualifier(self):
        if self.tok() == LET:
            save, blocks, seen, n = self.p, list(self.blocks), self.seen, len(self.noted)
            self.p += 1
            self.open.append(IN)
            self.block(self.declaration)
            self.open.pop()
            if self.tok() != IN:
                return
            self.p, self.blocks, self.seen = save, blocks, seen
            del self.noted[n:]
        self.bind_or_exp()

    def alternative(self):
        self.pattern(self.exp_no_type)
        self.right_side("→")

    def exp_no_type(self):
        self.infix()

    def right_side(self, sign: str):
        t = self.tok()
        self.open.append(WHERE)
        if t == sign:
            self.p += 1
            self.expression()
        elif t == "|":
            while self.tok() == "|":
                self.p += 1
                self.open[-1] = sign + ","
                while True:
                    self.qualifier()
                    if self.tok() != ",":
                        break
                    self.p += 1
                self.need(sign)
                self.open[-1] = "|" + WHERE
                self.expression()
        else:
            self.fail(sign)
        self.open.pop()
        if self.tok() == WHERE:
            self.p += 1
            self.block(self.declaration)

    # declarations

    def signature_ahead(self) -> bool:
        k, p = self.k, self.p
        while True:
            if k[p] in VARS:
                p += 1
            elif k[p] == "(" and (k[p + 1] in OPS or k[p + 1] == "|") and k[p + 2] == ")":
                p += 3
            else:
                return False
            if k[p] == ",":
                p += 1
                continue
            return k[p] == "∷"

    def declaration(self):
        t = self.tok()
        if t in (INFIX, INFIXL, INFIXR):
            self.p += 1
            if self.tok() == "n":
                self.p += 1
            while True:
                if not self.operator():
                    self.fail("operator")
                self.take_operator()
                if self.tok() != ",":
                    return
                self.p += 1
        if self.signature_ahead():
            while self.tok() != "∷":
                if self.tok() in "\r\n":
                    self.fail("::")
                self.p += 1
            self.p += 1
            self.type_with_context()
            return
        start = self.p
        save = self.only_exp, self.only_pat
        self.only_exp = self.only_pat = -1
        self.left_side()
        if self.only_exp >= 0:
            self.p = self.only_exp
            self.fail("pattern")
        self.only_exp, self.only_pat = save
        if self.tok() not in "=|":
            self.fail("=")
        if self.k[start] in "nsc":
            pass
        self.right_side("=")

    def left_side(self):
        """A pattern, the operands of a defined operator, or a function and its arguments."""
        if self.tok() == "!":
            self.fail("declaration")
        self.operand_pattern()
        op = self.operator()
        defined = False
        while op and op != "~":
            if op in SYMBOLS or op == "b":
                if defined:
                    self.is_exp(self.p)
                defined = True
            self.take_operator()
            if self.tok() == "-":
                self.p += 1
            self.operand_pattern()
            op = self.operator()

    def operand_pattern(self):
        if self.tok() == "-":
            self.p += 1
        if self.tok() == "(" and self.defines_operator_in_parentheses():
            self.p += 1
            self.left_side()
            self.need(")")
        else:
            if self.tok() == "(" and self.k[self.p + 1] in SYMBOLS and self.k[self.p + 2] == ")":
                self.p += 3
            else:
                self.aexp()
        while self.starts_aexp():
            self.aexp()

    def defines_operator_in_parentheses(self) -> bool:
        """(x <+> y) z = ...: a closed parenthesis with a variable operator at depth 1, followed by an argument."""
        k, p, depth, found = self.k, self.p, 0, False
        while k[p] != END:
            if k[p] in "([":
                depth += 1
            elif k[p] in ")]":
                depth -= 1
                if not depth:
                    return found and (k[p + 1] in VARS or k[p + 1] in "C([_nsc")
            elif depth == 1 and (k[p] in "opx" or k[p] == "`" and k[p + 1] in VARS) and k[p - 1] != "(":
                found = True
            p += 1
        return False

    def type_with_context(self):
        if self.context_ahead():
            self.context(False)
        self.type()

    def context_ahead(self) -> bool:
        k, p = self.k, self.p
        while k[p] in VARS or k[p] in "CQ()[],→":
            p += 1
        return k[p] == "⇒"

    def context(self, simple: bool):
        """Assertions and ``=>``; in a simple one, of class and instance heads, only type variables are asserted."""
        if self.tok() == "(":
            self.p += 1
            if self.tok() != ")":
                while True:
                    self.assertion(simple)
                    if self.tok() != ",":
                        break
                    self.p += 1
            self.need(")")
        else:
            self.assertion(simple)
        self.need("⇒", "=>")

    def assertion(self, simple: bool):
        self.one_of("CQ", "class")
        if self.tok() == "(" and not simple:
            self.p += 1
            self.one_of(VARS, "type variable")
            self.btype()
            self.need(")")
        else:
            self.one_of(VARS, "type variable")

    def one_of(self, kinds: frozenset | str, want: str):
        if self.tok() not in kinds:
            self.fail(want)
        self.p += 1

    def simple_type(self):
        """A type constructor and its variables: the head of a data, newtype or type declaration."""
        self.one_of("C", "type constructor")
        while self.tok() in VARS:
            self.p += 1

    def instance_type(self):
        """A type constructor; or in brackets one with variables, a tuple or list of variables, or a function between two."""
        t = self.tok()
        if t == "[":
            self.p += 1
            if self.tok() != "]":
                self.one_of(VARS, "type variable")
            self.need("]")
        elif t != "(":
            self.one_of("CQ", "type constructor")
        else:
            self.p += 1
            t = self.tok()
            if t == "→":
                self.p += 1
            elif t == ",":
                while self.tok() == ",":
                    self.p += 1
            elif t in VARS:
                self.p += 1
                if self.tok() == "→":
                    self.p += 1
                    self.one_of(VARS, "type variable")
                else:
                    if self.tok() != ",":
                        self.fail(", or ->")
                    while self.tok() == ",":
                        self.p += 1
                        self.one_of(VARS, "type variable")
            elif t != ")":
                if t in "([":
                    self.constructor_in_brackets()
                else:
                    self.one_of("CQ", "type constructor")
                while self.tok() in VARS:
                    self.p += 1
            self.need(")")

    def constructor_in_brackets(self):
        """(), [], (->) or (,) as a type constructor."""
        end = ")" if self.tok() == "(" else "]"
        self.p += 1
        if end == ")" and self.tok() == "→":
            self.p += 1
        elif end == ")":
            while self.tok() == ",":
                self.p += 1
        self.need(end)

    def type(self):
        self.btype()
        if self.tok() == "→":
            self.p += 1
            self.type()

    def starts_atype(self) -> bool:
        t = self.tok()
        return t in VARS or t in "CQ(["

    def btype(self):
        self.atype()
        while self.starts_atype():
            self.atype()

    def atype(self):
        t = self.tok()
        if t in VARS or t in "CQ":
            self.p += 1
        elif t == "(":
            self.p += 1
            if self.tok() == ")":
                self.p += 1
            elif self.tok() == "→":
                self.p += 1
                self.need(")")
            elif self.tok() == ",":
                while self.tok() == ",":
                    self.p += 1
                self.need(")")
            else:
                self.type()
                while self.tok() == ",":
                    self.p += 1
                    self.type()
                self.need(")")
        elif t == "[":
            self.p += 1
            if self.tok() != "]":
                self.type()
            self.need("]")
        else:
            self.fail("type")

    def top(self):
        t = self.tok()
        if t == DATA or t == NEWTYPE:
            self.p += 1
            if self.context_ahead():
                self.context(False)
            self.simple_type()
            if self.tok() == "=":
                self.p += 1
                if t == NEWTYPE:
                    self.new_constructor()
                else:
                    self.constructor()
                    while self.tok() == "|":
                        self.p += 1
                        self.constructor()
            elif t == NEWTYPE:
                self.fail("=")
            if self.tok() == DERIVING:
                self.p += 1
                if self.tok() == "(":
                    self.p += 1
                    if self.tok() != ")":
                        while True:
                            if self.tok() not in "CQ":
                                self.fail("class")
                            self.p += 1
                            if self.tok() != ",":
                                break
                            self.p += 1
                    self.need(")")
                elif self.tok() in "CQ":
                    self.p += 1
                else:
                    self.fail("class")
        elif t == TYPE:
            self.p += 1
            self.simple_type()
            self.need("=")
            self.type()
        elif t == CLASS or t == INSTANCE:
            self.p += 1
            if self.context_ahead():
                self.context(True)
            if t == CLASS:
                self.one_of("C", "class")
                self.one_of(VARS, "type variable")
            else:
                self.one_of("CQ", "class")
                self.instance_type()
            if self.tok() == WHERE:
                self.p += 1
                self.block(self.declaration)
        elif t == DEFAULT:
            self.p += 1
            self.atype()
        elif t == FOREIGN:
            self.p += 1
            while self.tok() != "∷":
                if self.tok() in "\r\n ":
                    self.fail("::")
                self.p += 1
            self.p += 1
            self.type()
        else:
            self.declaration()

    def constructor_name(self) -> int:
        """How many tokens a constructor's name has here: 1, 3 for an operator in parentheses, 0 if there is none."""
        k, p = self.k, self.p
        if self.tok() == "(" and k[p + 1] == "X" and k[p + 2] == ")":
            return 3
        return int(self.tok() == "C")

    def constructor_operator(self) -> bool:
        op = self.operator()
        return op == "X" or op == "B" and self.k[self.p + 1] == "C"

    def new_constructor(self):
        """A constructor with one field."""
        n = self.constructor_name()
        if not n:
            self.fail("constructor")
        self.p += n
        if self.tok() == "{":
            self.p += 1
            self.blocks.append(0)
            self.field_name()
            self.need("∷", "::")
            self.type()
            self.need("}")
            self.blocks.pop()
        else:
            self.atype()

    def field_name(self):
        if self.tok() == "(" and self.k[self.p + 1] in SYMBOLS and self.k[self.p + 2] == ")":
            self.p += 3
        else:
            self.one_of(VARS, "field")

    def constructor(self):
        """A constructor and its fields, or one that stands between two."""
        start, n = self.p, self.constructor_name()
        if n and self.k[start + n] == "{":
            self.p += n + 1
            self.blocks.append(0)
            while self.tok() != "}":
                self.field_name()
                while self.tok() == ",":
                    self.p += 1
                    self.field_name()
                self.need("∷")
                if self.tok() == "!":
                    self.p += 1
                    self.atype()
                else:
                    self.type()
                if self.tok() == ",":
                    self.p += 1
                    if self.tok() == "}":
                        self.fail("field")
                elif self.tok() != "}":
                    self.fail("}")
            self.p += 1
            self.blocks.pop()
            return
        strict = False
        if n:
            self.p += n
        elif self.tok() == "!":
            self.p += 1
            self.atype()
        elif self.starts_atype():
            self.btype()
        else:
            self.fail("constructor")
        while n and (self.starts_atype() or self.tok() == "!"):
            if self.tok() == "!":
                strict = True
                self.p += 1
            self.atype()
        if not self.constructor_operator():
            if not n:
                self.p = start
                self.fail("constructor")
            return
        if n == 3 or strict:
            return
        self.take_operator()
        if self.tok() == "!":
            self.p += 1
            self.atype()
        else:
            self.btype()

    def import_(self):
        self.p += 1
        if self.tok() == "q":
            self.p += 1
        if self.tok() not in "CQ":
            self.fail("module name")
        self.p += 1
        if self.tok() == "a":
            self.p += 1
            if self.tok() not in "CQ":
                self.fail("module name")
            self.p += 1
        if self.tok() == "h":
            self.p += 1
            if self.tok() != "(":
                self.fail("(")
        if self.tok() == "(":
            self.entities()

    def entities(self):
        self.p += 1
        while self.tok() != ")":
            t = self.tok()
            if t == ",":
                self.p += 1
                continue
            if t == MODULE:
                self.p += 1
                t = self.tok()
            if t in VARS or t == "w":
                self.p += 1
            elif t in "CQ":
                self.p += 1
                if self.tok() == "(":
                    self.p += 1
                    if self.tok() == "…":
                        self.p += 1
                    else:
                        while self.tok() != ")":
                            if self.tok() == "(" and self.k[self.p + 1] in OPS and self.k[self.p + 2] == ")":
                                self.p += 3
                            elif self.tok() in VARS or self.tok() == "C":
                                self.p += 1
                            else:
                                self.fail(")")
                            if self.tok() == ",":
                                self.p += 1
                            elif self.tok() != ")":
                                self.fail(")")
                    self.need(")")
            elif t == "(" and self.k[self.p + 1] in OPS and self.k[self.p + 2] == ")":
                self.p += 3
            else:
                self.fail(")")
            if self.tok() == ",":
                self.p += 1
            elif self.tok() != ")":
                self.fail(")")
        self.p += 1

    def header(self):
        """module M (exports) where"""
        self.need(MODULE)
        if self.tok() not in "CQ":
            self.fail("module name")
        self.p += 1
        if self.tok() == "(":
            self.entities()
        self.need(WHERE, "where")


_known: dict[str, tuple[bool, list[tuple[int, str]]]] = {}
MOST = 200_000


def _errors(stretch: str, read) -> list[tuple[int, str]]:
    """Errors, by token, of what ``read`` reads with a parser: the one that ends it and, with recovery, those behind."""
    parser = Parser(stretch)
    try:
        read(parser)
        return []
    except Wrong as e:
        found = [(e.at, e.want)]
    parser = Parser(stretch, True)
    try:
        read(parser)
    except Wrong as e:
        parser.noted.append((e.at, e.want))
    for at, want in sorted(parser.noted, key=lambda e: e[0]):
        if at > found[-1][0]:
            found.append((at, want))
    return found


def _top_level(stretch: str, imports: bool) -> list[tuple[int, str]]:
    """Errors, by token, of what begins in the first column and is the only item of its block."""

    def read(parser: Parser):
        def item():
            if parser.tok() == IMPORT:
                if not imports:
                    parser.fail("declaration")
                parser.import_()
            else:
                parser.top()

        parser.blocks.append(parser.first[0])
        parser.seen = 0
        while parser.tok() == ";":
            parser.p += 1
        while parser.tok() != "\r":
            parser.attempt(item)
            if parser.tok() == ";":
                while parser.tok() == ";":
                    parser.p += 1
            elif parser.tok() != "\r":
                parser.fail("end of declaration")

    return _errors(stretch, read)


def _whole(stretch: str) -> list[tuple[int, str]]:
    """Errors of a body that isn't in the first column, or in braces."""

    def read(parser: Parser):
        imports = True

        def item():
            nonlocal imports
            if parser.tok() == IMPORT and imports:
                parser.import_()
            else:
                imports = False
                parser.top()

        parser.block(item)
        while parser.k[parser.p] != END:
            if not parser.recover:
                parser.fail("end of file")
            # what is left is read as a block of its own
            p = parser.p
            parser.noted.append((p, "end of file"))
            parser.block(item)
            while parser.p == p or not parser.first[parser.p] and parser.k[parser.p] != END:
                parser.p += 1

    return _errors(stretch, read)


def errors(text: str) -> list[tuple[int, str]]:
    """(line, what was wanted) for each error, in order; none if the text is a module of Haskell 2010.

    An empty text, or one of comments only, is a module without declarations.
    """
    lines, closed = encode(text)
    out: list[tuple[int, str]] = []

    def place(found: list[tuple[int, str]], of: list[tuple[int, str]]):
        for at, want in found:
            for n, kinds in of:
                size = sum(not COLUMN <= ord(c) < COLUMN + 0x1000 for c in kinds)
                if at < size:
                    break
                at -= size
            out.append((n, want))

    rest = lines
    if lines and MODULE in lines[0][1][:2]:
        parser = Parser("".join(k for _, k in lines))
        try:
            parser.header()
        except Wrong as e:
            place([(e.at, e.want)], lines)
            rest = lines[1:]
        else:
            left, i = parser.p, 0
            while i < len(lines):
                size = sum(not COLUMN <= ord(c) < COLUMN + 0x1000 for c in lines[i][1])
                if left < size:
                    break
                left -= size
                i += 1
            rest = lines[i:]
            if left and i < len(lines):
                kinds = [c for c in lines[i][1] if not COLUMN <= ord(c) < COLUMN + 0x800]
                first = lines[i][1]
                n = 0
                for j, c in enumerate(first):
                    if not COLUMN <= ord(c) < COLUMN + 0x1000:
                        n += 1
                        if n == left:
                            break
                rest = [(lines[i][0], first[j + 1 :]), *lines[i + 1 :]]
                place(_whole("".join(k for _, k in rest)), rest)
                if not closed:
                    out.append((text.count("\n") + 1, "-}"))
                return out
    if rest and (rest[0][1][0] != chr(COLUMN + 0x801) or rest[0][1][1:2] == "{"):
        place(_whole("".join(k for _, k in rest)), rest)
    else:
        start, imports = 0, True
        edge = chr(COLUMN + 0x801)
        for i in range(1, len(rest) + 1):
            if i < len(rest) and rest[i][1][0] != edge:
                continue
            stretch = "".join(k for _, k in rest[start:i])
            if IMPORT != stretch[1:2]:
                imports = False
            key = stretch if imports else "!" + stretch
            found = _known.get(key)
            if found is None:
                found = _top_level(stretch, imports)
                if len(_known) >= MOST:
                    _known.clear()
                if len(key) <= 2000:
                    _known[key] = found
            if found:
                place(found, rest[start:i])
            start = i
    if not closed:
        out.append((text.count("\n") + 1, "-}"))
    return out
