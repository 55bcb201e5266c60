"""A recursive-descent parser for the syntax of Java 8 that keeps going after errors.

Tokens become one character each, so that a file is a string over an alphabet of kinds: names, literals, and every keyword and
operator. Statements and declarations are parsed by descent, expressions by precedence climbing. After an error the parser
panics: it skips to the end of the statement or declaration, or to the brace that closes it, and goes on.

Whether a stretch of kinds parses doesn't depend on the file it stands in; stretches that did, up to a semicolon or an opening
brace, are remembered by their kinds and not parsed again.
"""

from __future__ import annotations

import re

KEYWORDS = (
    "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if "
    "implements import instanceof int interface long native new package private protected public return short static strictfp super switch "
    "synchronized this throw throws transient try void volatile while null true false"
).split()
#: The kind of each keyword: characters of no other use.
KIND = {w: chr(0x4E00 + i) for i, w in enumerate(KEYWORDS)}
KIND |= {x: x for x in "(){}[];,.@=><!~?:+-*/&|^%"}
KIND |= {"==": "≡", "<=": "≤", ">=": "≥", "!=": "≠", "&&": "∧", "||": "∨", "++": "⊕", "--": "⊖", "->": "→", "::": "∷", "...": "…", "<<": "«"}
KIND |= dict.fromkeys(("+=", "-=", "*=", "/=", "&=", "|=", "^=", "%=", "<<="), "≔")
KIND |= dict.fromkeys(("true", "false", "null"), "n")
NAME, NUMBER, STRING, CHAR, WRONG, END = "i", "n", "s", "c", "E", " "

_ESCAPE = r"\\(?:[btnfr\"'\\]|[0-3]?[0-7]{1,2}|u+[0-9a-fA-F]{4})"
TOKEN = re.compile(
    r"//[^\n\r]*|/\*[\s\S]*?\*/|/\*"
    rf"|\"(?:[^\"\\\n\r]|{_ESCAPE})*\"|'(?:[^'\\\n\r]|{_ESCAPE})'"
    r"|(?:[^\W\d]|\$)[\w$]*"
    r"|(?:0[xX](?:[0-9a-fA-F][0-9a-fA-F_]*\.?[0-9a-fA-F_]*|\.[0-9a-fA-F_]+)(?:[pP][+-]?[0-9]+)?|0[bB][01][01_]*|(?:[0-9][0-9_]*\.?[0-9_]*|\.[0-9][0-9_]*)(?:[eE][+-]?[0-9][0-9_]*)?)[lLfFdD]?"
    r"|\.\.\.|->|::|\+\+|--|&&|\|\||<<=|[-+*/&|^%=<>!]=|<<|\S"
)
_BAD_NUMBER = re.compile(r"0[0-9_]*[89][0-9_]*[lL]?$|.*_[lLfFdD]?$")


class Kinds(dict):
    """The kind of a lexeme; comments have none. Remembers names and numbers, up to a bound."""

    def __init__(self, most: int = 500_000):
        super().__init__(KIND)
        self.most = most

    def __missing__(self, t: str) -> str:
        c = t[0]
        if c == "/":
            return "" if len(t) > 2 or t == "//" else WRONG
        if c == '"':
            return STRING if len(t) > 1 else WRONG
        if c == "'":
            return CHAR if len(t) > 1 else WRONG
        if c.isdecimal() or c == ".":
            kind = WRONG if _BAD_NUMBER.match(t) and not t[:2] in ("0x", "0X") else NUMBER
        elif c == "_" or c == "$" or c.isalpha():
            kind = NAME
        else:
            return WRONG if not (len(t) == 1 and c.isidentifier()) else NAME
        if len(self) >= self.most:
            self.clear()
            self.update(KIND)
        self[t] = kind
        return kind


class Wrong(Exception):
    def __init__(self, at: int, want: str):
        self.at, self.want = at, want


def _k(*words: str) -> str:
    return "".join(KIND[w] for w in words)


PRIMITIVE = frozenset(_k("boolean", "byte", "char", "double", "float", "int", "long", "short"))
MODIFIER = frozenset(_k("abstract", "default", "final", "native", "private", "protected", "public", "static", "strictfp", "synchronized", "transient", "volatile"))
LOCAL_MODIFIER = frozenset(_k("abstract", "final", "static", "strictfp"))
BINARY = {"∨": 1, "∧": 2, "|": 3, "^": 4, "&": 5, "≡": 6, "≠": 6, "<": 7, ">": 7, "≤": 7, "≥": 7, KIND["instanceof"]: 7, "«": 8, "+": 9, "-": 9, "*": 10, "/": 10, "%": 10}
(CLASS, INTERFACE, ENUM, EXTENDS, IMPLEMENTS, THROWS, IMPORT, PACKAGE, STATIC, VOID, DEFAULT, CASE, IF, ELSE, FOR, WHILE, DO, SWITCH, TRY, CATCH, FINALLY, RETURN, BREAK, CONTINUE, THROW, ASSERT, SYNC, NEW, THIS, SUPER, FINAL, INSTANCEOF) = (
    KIND[w] for w in "class interface enum extends implements throws import package static void default case if else for while do switch try catch finally return break continue throw assert synchronized new this super final instanceof".split()
)
LITERAL = frozenset("nsc")
AFTER_CAST = frozenset("insc(!~") | PRIMITIVE | {NEW, THIS, SUPER, VOID}
HEADED = frozenset((IF, FOR, WHILE, SWITCH, TRY, SYNC))
SLOW = HEADED | frozenset((DO, CLASS, INTERFACE, ENUM, ELSE, CASE, DEFAULT, CATCH, FINALLY)) | frozenset("{};") | {END}


class Parser:
    #: Stretches of kinds known to parse, by what they are; cleared when there are too many.
    known: dict[str, set[str]] = {"statement": set(), "head": set(), "member": set()}
    most = 200_000

    def __init__(self, kinds: str):
        self.k, self.p, self.errors = kinds + END, 0, []
        self.arrow: dict[int, bool] = {}

    # helpers

    def fail(self, want: str):
        raise Wrong(self.p, want)

    def need(self, kind: str, want: str | None = None):
        if self.k[self.p] != kind:
            self.fail(want or kind)
        self.p += 1

    def note(self, e: Wrong):
        if not self.errors or self.errors[-1][0] != e.at:
            self.errors.append((e.at, e.want))

    def learn(self, what: str, stretch: str):
        known = self.known[what]
        if len(known) >= self.most:
            known.clear()
        if len(stretch) <= 400:
            known.add(stretch)

    def panic(self, start: int):
        """To after the next semicolon or closed block at this depth, or before the brace that closes what is around."""
        k, p, depth = self.k, max(self.p, start), 0
        if p == start and k[p] not in "{}" and k[p] != END:
            p += 1
        while (c := k[p]) != END:
            if c == "{":
                depth += 1
            elif c == "}":
                if not depth:
                    break
                depth -= 1
                if not depth:
                    p += 1
                    break
            elif c == ";" and not depth:
                p += 1
                break
            p += 1
        self.p = p

    # types

    def type_at(self, p: int, dims: bool = True, diamond: bool = False) -> int:
        """Where the type that begins here ends; -1 if none does."""
        k = self.k
        while k[p] == "@" and k[p + 1] == NAME:
            p = self.annotation_at(p)
            if p < 0:
                return -1
        if k[p] in PRIMITIVE:
            p += 1
        else:
            while True:
                if k[p] != NAME:
                    return -1
                p += 1
                if k[p] == "<":
                    p = self.arguments_at(p, diamond)
                    if p < 0:
                        return -1
                if k[p] == "." and k[p + 1] == NAME:
                    p += 1
                    continue
                break
        while dims and k[p] == "[" and k[p + 1] == "]":
            p += 2
        return p

    def arguments_at(self, p: int, diamond: bool = False) -> int:
        k = self.k
        p += 1
        if diamond and k[p] == ">":
            return p + 1
        while True:
            if k[p] == "?":
                p += 1
                if k[p] in (EXTENDS, SUPER):
                    p = self.type_at(p + 1)
            else:
                p = self.type_at(p)
            if p < 0:
                return -1
            if k[p] == ",":
                p += 1
                continue
            return p + 1 if k[p] == ">" else -1

    def annotation_at(self, p: int) -> int:
        save, self.p = self.p, p
        try:
            self.annotation()
            return self.p
        except Wrong:
            return -1
        finally:
            self.p = save

    def type(self, dims: bool = True, diamond: bool = False):
        p = self.type_at(self.p, dims, diamond)
        if p < 0:
            self.fail("type")
        self.p = p

    def type_list(self, separator: str = ","):
        self.type()
        while self.k[self.p] == separator:
            self.p += 1
            self.type()

    def type_parameters(self):
        self.need("<")
        while True:
            while self.k[self.p] == "@":
                self.annotation()
            self.need(NAME, "type parameter")
            if self.k[self.p] == EXTENDS:
                self.p += 1
                self.type_list("&")
            if self.k[self.p] != ",":
                break
            self.p += 1
        self.need(">")

    def qualified(self):
        self.need(NAME, "name")
        while self.k[self.p] == "." and self.k[self.p + 1] == NAME:
            self.p += 2

    def dims(self):
        while self.k[self.p] == "[":
            self.p += 1
            self.need("]")

    # annotations and modifiers

    def annotation(self):
        self.need("@")
        self.qualified()
        if self.k[self.p] == "(":
            self.p += 1
            if self.k[self.p] != ")":
                if self.k[self.p] == NAME and self.k[self.p + 1] == "=":
                    while True:
                        self.need(NAME, "element")
                        self.need("=")
                        self.element_value()
                        if self.k[self.p] != ",":
                            break
                        self.p += 1
                else:
                    self.element_value()
            self.need(")")

    def element_value(self):
        c = self.k[self.p]
        if c == "@":
            self.annotation()
        elif c == "{":
            self.p += 1
            while self.k[self.p] != "}":
                self.element_value()
                if self.k[self.p] == ",":
                    self.p += 1
                elif self.k[self.p] != "}":
                    self.fail("}")
            self.p += 1
        else:
            self.ternary()

    def modifiers(self, allowed=MODIFIER):
        k = self.k
        while True:
            c = k[self.p]
            if c in allowed and not (c == DEFAULT and k[self.p + 1] in (":", "→")):
                self.p += 1
            elif c == "@" and k[self.p + 1] != INTERFACE:
                self.annotation()
            else:
                return

    # declarations

    def compilation_unit(self):
        k = self.k
        stage = 0
        while k[self.p] != END:
            start = self.p
            try:
                if k[self.p] == ";":
                    self.p += 1
                    continue
                if k[self.p] == IMPORT:
                    if stage > 1:
                        self.fail("type declaration")
                    stage = 1
                    self.p += 1
                    if k[self.p] == STATIC:
                        self.p += 1
                    self.qualified()
                    if k[self.p] == ".":
                        self.p += 1
                        self.need("*")
                    self.need(";")
                    continue
                self.modifiers()
                if k[self.p] == PACKAGE:
                    if stage:
                        self.fail("type declaration")
                    stage = 1
                    self.p += 1
                    self.qualified()
                    self.need(";")
                    continue
                stage = 2
                self.type_declaration()
            except Wrong as e:
                self.note(e)
                self.panic(start)
                if k[self.p] == "}":
                    self.p += 1

    def type_declaration(self):
        k = self.k
        c = k[self.p]
        if c == CLASS:
            self.p += 1
            self.need(NAME, "class name")
            if k[self.p] == "<":
                self.type_parameters()
            if k[self.p] == EXTENDS:
                self.p += 1
                self.type(dims=False)
            if k[self.p] == IMPLEMENTS:
                self.p += 1
                self.type_list()
            self.body("class")
        elif c == INTERFACE:
            self.p += 1
            self.need(NAME, "interface name")
            if k[self.p] == "<":
                self.type_parameters()
            if k[self.p] == EXTENDS:
                self.p += 1
                self.type_list()
            self.body("interface")
        elif c == "@" and k[self.p + 1] == INTERFACE:
            self.p += 2
            self.need(NAME, "annotation name")
            self.body("annotation")
        elif c == ENUM:
            self.p += 1
            self.need(NAME, "enum name")
            if k[self.p] == IMPLEMENTS:
                self.p += 1
                self.type_list()
            self.need("{")
            while k[self.p] not in ";}":
                self.modifiers(())
                self.need(NAME, "enum constant")
                if k[self.p] == "(":
                    self.arguments()
                if k[self.p] == "{":
                    self.body("class")
                if k[self.p] != ",":
                    break
                self.p += 1
            if k[self.p] == ";":
                self.p += 1
                self.members("enum")
            else:
                self.need("}")
        else:
            self.fail("class, interface or enum")

    def body(self, kind: str):
        self.need("{")
        self.members(kind)

    def members(self, kind: str):
        k = self.k
        while k[self.p] != "}":
            if k[self.p] == END:
                self.fail("}")
            start = self.p
            try:
                self.member(kind)
            except Wrong as e:
                self.note(e)
                self.panic(start)
        self.p += 1

    def member(self, kind: str):
        k, p = self.k, self.p
        semicolon, brace = k.find(";", p), k.find("{", p)
        e = semicolon if brace < 0 or 0 <= semicolon < brace else brace
        stretch = kind[0] + k[p : e + 1]
        if e > 0 and stretch in self.known["member"]:
            if k[e] == ";":
                self.p = e + 1
            else:
                self.p = e
                self.block()
            return
        block = self.member_head(kind)
        if block is None:
            return
        if not block and self.p == e + 1 and k[e] == ";" or block and self.p == e:
            self.learn("member", stretch)
        if block:
            self.block()

    def member_head(self, kind: str) -> bool | None:
        """Whether a block follows; None for what has been parsed as a whole."""
        k = self.k
        if k[self.p] == ";":
            self.p += 1
            return None
        if kind in ("class", "enum"):
            if k[self.p] == "{":
                return True
            if k[self.p] == STATIC and k[self.p + 1] == "{":
                self.p += 1
                return True
        self.modifiers()
        c = k[self.p]
        if c in (CLASS, INTERFACE, ENUM) or c == "@":
            self.type_declaration()
            return None
        if c == "<":
            self.type_parameters()
            c = k[self.p]
        if c == NAME and k[self.p + 1] == "(" and kind in ("class", "enum"):
            self.p += 1
            self.parameters()
            self.throws()
            if k[self.p] != "{":
                self.fail("{")
            return True
        if c == VOID:
            self.p += 1
        else:
            self.type()
        self.need(NAME, "name")
        if k[self.p] == "(":
            self.parameters()
            self.dims()
            self.throws()
            if k[self.p] == DEFAULT and kind == "annotation":
                self.p += 1
                self.element_value()
            if k[self.p] == ";":
                self.p += 1
                return False
            if k[self.p] != "{":
                self.fail("{ or ;")
            return True
        if c == VOID:
            self.fail("(")
        self.declarators()
        self.need(";")
        return False

    def throws(self):
        if self.k[self.p] == THROWS:
            self.p += 1
            self.type_list()

    def parameters(self):
        k = self.k
        self.need("(")
        if k[self.p] != ")":
            while True:
                self.modifiers((FINAL,))
                self.type()
                while k[self.p] == "@":
                    self.annotation()
                last = k[self.p] == "…"
                if last:
                    self.p += 1
                if k[self.p] == THIS:
                    self.p += 1
                elif k[self.p] == NAME and k[self.p + 1] == "." and not last:
                    self.qualified()
                    self.need(".")
                    self.need(THIS)
                else:
                    self.need(NAME, "parameter name")
                    self.dims()
                if k[self.p] != ",":
                    break
                if last:
                    self.fail(")")
                self.p += 1
        self.need(")")

    def declarators(self, first_named: bool = True):
        """After the first name."""
        k = self.k
        while True:
            self.dims()
            if k[self.p] == "=":
                self.p += 1
                self.initializer()
            if k[self.p] != ",":
                return
            self.p += 1
            self.need(NAME, "name")

    def initializer(self):
        if self.k[self.p] == "{":
            self.p += 1
            while self.k[self.p] != "}":
                self.initializer()
                if self.k[self.p] == ",":
                    self.p += 1
                elif self.k[self.p] != "}":
                    self.fail("}")
            self.p += 1
        else:
            self.expression()

    # statements

    def block(self):
        self.need("{")
        self.statements()
        self.need("}")

    def statements(self):
        k = self.k
        while (c := k[self.p]) != "}" and c != CASE and not (c == DEFAULT and k[self.p + 1] == ":"):
            if c == END:
                self.fail("}")
            start = self.p
            try:
                self.statement(True)
            except Wrong as e:
                self.note(e)
                if k[self.p] == END:
                    return
                self.panic(start)

    def statement(self, declared: bool):
        """``declared``: whether a declaration may stand here."""
        k = self.k
        while True:
            p = self.p
            c = k[p]
            if c not in SLOW:
                e = k.find(";", p) + 1
                stretch = k[p:e] if declared else "!" + k[p:e]
                if stretch in self.known["statement"]:
                    self.p = e
                    return
                self.simple(declared)
                if self.p == e:
                    self.learn("statement", stretch)
                return
            if c == "{":
                return self.block()
            if c == ";":
                self.p += 1
                return
            if c in HEADED:
                e = k.find("{", p)
                stretch = k[p:e] if e > 0 else ""
                if stretch and stretch in self.known["head"]:
                    self.p = e
                else:
                    self.head()
                    if self.p == e:
                        self.learn("head", stretch)
                if c == IF:
                    self.statement(False)
                    if k[self.p] == ELSE:
                        self.p += 1
                        declared = False
                        continue
                    return
                if c in (FOR, WHILE):
                    declared = False
                    continue
                if c == SWITCH:
                    return self.switch_body()
                if c == SYNC:
                    return self.block()
                return self.try_rest(k[self.p - 1] == ")")
            if c == DO:
                self.p += 1
                self.statement(False)
                self.need(WHILE, "while")
                self.parenthesized()
                return self.need(";")
            if c in (CLASS, INTERFACE, ENUM):
                if not declared or c == INTERFACE or c == ENUM:
                    self.fail("statement")
                return self.type_declaration()
            self.fail("statement")

    def parenthesized(self):
        self.need("(")
        self.expression()
        self.need(")")

    def head(self):
        k = self.k
        c = k[self.p]
        self.p += 1
        if c == TRY:
            if k[self.p] == "(":
                self.p += 1
                while True:
                    self.modifiers((FINAL,))
                    self.type()
                    self.need(NAME, "resource name")
                    self.dims()
                    self.need("=")
                    self.expression()
                    if k[self.p] == ";":
                        self.p += 1
                        if k[self.p] != ")":
                            continue
                    break
                self.need(")")
        elif c == FOR:
            self.need("(")
            if k[self.p] != ";":
                if self.is_declaration():
                    self.modifiers((FINAL,))
                    self.type()
                    self.need(NAME, "name")
                    self.dims()
                    if k[self.p] == ":":
                        self.p += 1
                        self.expression()
                        self.need(")")
                        return
                    self.declarators()
                else:
                    self.effects()
            self.need(";")
            if k[self.p] != ";":
                self.expression()
            self.need(";")
            if k[self.p] != ")":
                self.effects()
            self.need(")")
        else:
            self.parenthesized()

    def effects(self):
        while True:
            self.effect()
            if self.k[self.p] != ",":
                return
            self.p += 1

    def effect(self):
        at = self.p
        if self.expression() not in "acuN":
            raise Wrong(at, "statement")

    def switch_body(self):
        k = self.k
        self.need("{")
        while k[self.p] != "}":
            if k[self.p] == CASE:
                self.p += 1
                self.ternary()
                self.need(":")
            elif k[self.p] == DEFAULT:
                self.p += 1
                self.need(":")
            else:
                self.fail("case, default or }")
            self.statements()
        self.p += 1

    def try_rest(self, resources: bool):
        k = self.k
        self.block()
        n = 0
        while k[self.p] == CATCH:
            self.p += 1
            self.need("(")
            self.modifiers((FINAL,))
            self.type_list("|")
            self.need(NAME, "name")
            self.need(")")
            self.block()
            n += 1
        if k[self.p] == FINALLY:
            self.p += 1
            self.block()
        elif not n and not resources:
            self.fail("catch or finally")

    def is_declaration(self) -> bool:
        k, p = self.k, self.p
        if k[p] == FINAL or k[p] == "@":
            return True
        if k[p] in PRIMITIVE:
            q = self.type_at(p)
            return k[q] != "." and k[q] != "∷"
        if k[p] != NAME:
            return False
        q = self.type_at(p)
        return q > 0 and k[q] == NAME

    def simple(self, declared: bool):
        k = self.k
        c = k[self.p]
        if c == NAME and k[self.p + 1] == ":":
            self.p += 2
            return self.statement(False)
        if c == RETURN:
            self.p += 1
            if k[self.p] != ";":
                self.expression()
        elif c in (BREAK, CONTINUE):
            self.p += 1
            if k[self.p] == NAME:
                self.p += 1
        elif c == THROW:
            self.p += 1
            self.expression()
        elif c == ASSERT:
            self.p += 1
            self.expression()
            if k[self.p] == ":":
                self.p += 1
                self.expression()
        elif c in LOCAL_MODIFIER or c == "@" or self.is_declaration():
            if not declared:
                self.fail("statement")
            self.modifiers(LOCAL_MODIFIER)
            if k[self.p] == CLASS:
                return self.type_declaration()
            self.type()
            self.need(NAME, "name")
            self.declarators()
        else:
            self.effect()
        self.need(";")

    # expressions; each returns its sort: v variable, c call, N object creation, a assignment, u increment, o other

    def expression(self) -> str:
        k, p = self.k, self.p
        if k[p] == NAME and k[p + 1] == "→" or k[p] == "(" and self.is_lambda(p):
            return self.lambda_()
        sort = self.ternary()
        c = k[self.p]
        shift = c == ">" and (k[self.p + 1] == "≥" or k[self.p + 1] == ">" and k[self.p + 2] == "≥")
        if c == "=" or c == "≔" or shift:
            if sort != "v":
                self.fail("variable before =")
            self.p += 1 if not shift else 2 if k[self.p + 1] == "≥" else 3
            self.expression()
            return "a"
        return sort

    def is_lambda(self, p: int) -> bool:
        """Whether an arrow follows the bracket that closes the one here. One scan answers for all brackets within, too."""
        known = self.arrow.get(p)
        if known is not None:
            return known
        k, q = self.k, p
        open_: list[int] = []
        while (c := k[q]) != END:
            if c == "(":
                open_.append(q)
            elif c == ")":
                self.arrow[open_.pop()] = k[q + 1] == "→"
                if not open_:
                    break
            elif c in ";{}":
                break
            q += 1
        for o in open_:
            self.arrow[o] = False
        return self.arrow[p]

    def lambda_(self) -> str:
        k = self.k
        if k[self.p] == NAME:
            self.p += 1
        elif k[self.p + 1] == NAME and k[self.p + 2] in ",)":
            self.p += 1
            while True:
                self.need(NAME, "parameter")
                if k[self.p] != ",":
                    break
                self.p += 1
            self.need(")")
        else:
            self.parameters()
        self.need("→")
        if k[self.p] == "{":
            self.block()
        else:
            self.expression()
        return "o"

    def ternary(self) -> str:
        sort = self.binary(1)
        if self.k[self.p] == "?":
            self.p += 1
            self.expression()
            self.need(":")
            k, p = self.k, self.p
            if k[p] == NAME and k[p + 1] == "→" or k[p] == "(" and self.is_lambda(p):
                self.lambda_()
            else:
                self.ternary()
            return "o"
        return sort

    def binary(self, least: int) -> str:
        k = self.k
        sort = self.unary()
        while True:
            c = k[self.p]
            level = BINARY.get(c, 0)
            if not level:
                return sort
            n = 1
            if c == ">" and k[self.p + 1] in ">≥":
                n = 3 if k[self.p + 1] == ">" and k[self.p + 2] == ">" else 2
                if k[self.p + n - 1] == "≥" or k[self.p + n] == "≥" and k[self.p + 1] == ">":
                    return sort
                level = 8
            if level < least:
                return sort
            self.p += n
            if c == INSTANCEOF:
                self.type()
            else:
                self.binary(level + 1)
            sort = "o"

    def unary(self) -> str:
        k = self.k
        c = k[self.p]
        if c in "+-!~":
            self.p += 1
            self.unary()
            return "o"
        if c in "⊕⊖":
            self.p += 1
            self.unary()
            return "u"
        if c == "(":
            n = self.cast_at(self.p)
            if n:
                self.p = n
                if k[n] == NAME and k[n + 1] == "→" or k[n] == "(" and self.is_lambda(n):
                    self.lambda_()
                else:
                    self.unary()
                return "o"
        sort = self.primary()
        while k[self.p] in "⊕⊖":
            self.p += 1
            sort = "u"
        return sort

    def cast_at(self, p: int) -> int:
        """Where the operand of the cast that begins here begins; 0 if it isn't one."""
        k = self.k
        q = self.type_at(p + 1)
        if q < 0:
            return 0
        while k[q] == "&":
            q = self.type_at(q + 1)
            if q < 0:
                return 0
        if k[q] != ")":
            return 0
        return q + 1 if k[p + 1] in PRIMITIVE and k[q - 1] in PRIMITIVE or k[q + 1] in AFTER_CAST else 0

    def arguments(self):
        self.need("(")
        if self.k[self.p] != ")":
            while True:
                self.expression()
                if self.k[self.p] != ",":
                    break
                self.p += 1
        self.need(")")

    def primary(self) -> str:
        k = self.k
        c = k[self.p]
        if c == NAME:
            if k[self.p + 1] == "<":
                q = self.type_at(self.p)
                if q > 0 and k[q] == "∷":
                    self.p = q
                    return self.suffixes("o")
            self.p += 1
            if k[self.p] == "(":
                self.arguments()
                return self.suffixes("c")
            if k[self.p] == "[" and k[self.p + 1] == "]":
                self.dims()
                if k[self.p] not in ".∷":
                    self.fail(".class")
                return self.suffixes("o")
            return self.suffixes("v")
        if c in LITERAL:
            self.p += 1
            return self.suffixes("o")
        if c == "(":
            self.p += 1
            sort = self.expression()
            self.need(")")
            return self.suffixes(sort if sort == "v" else "o")
        if c == THIS or c == SUPER:
            self.p += 1
            if k[self.p] == "(":
                self.arguments()
                return self.suffixes("c")
            if c == SUPER and k[self.p] not in ".∷":
                self.fail(".")
            return self.suffixes("o")
        if c == NEW:
            return self.suffixes(self.creation())
        if c == VOID or c in PRIMITIVE:
            self.p += 1
            self.dims()
            if k[self.p] == "." and k[self.p + 1] == CLASS:
                self.p += 2
                return self.suffixes("o")
            if k[self.p] == "∷" and c != VOID:
                return self.suffixes("o")
            self.fail(".class")
        self.fail("expression")
        return ""

    def creation(self) -> str:
        k = self.k
        self.p += 1
        if k[self.p] == "<":
            self.p = self.need_at(self.arguments_at(self.p))
        self.type(dims=False, diamond=True)
        if k[self.p] == "[":
            empty = k[self.p + 1] == "]"
            if empty:
                self.dims()
                if k[self.p] != "{":
                    self.fail("array dimension or {")
                self.initializer()
                return "o"
            while k[self.p] == "[" and k[self.p + 1] != "]":
                self.p += 1
                self.expression()
                self.need("]")
            while k[self.p] == "[" and k[self.p + 1] == "]":
                self.p += 2
            return "o"
        if k[self.p] != "(":
            self.fail("( or [")
        self.arguments()
        if k[self.p] == "{":
            self.body("class")
        return "N"

    def need_at(self, p: int) -> int:
        if p < 0:
            self.fail("type arguments")
        return p

    def suffixes(self, sort: str) -> str:
        k = self.k
        while True:
            c = k[self.p]
            if c == ".":
                self.p += 1
                c = k[self.p]
                if c == NAME:
                    if k[self.p + 1] == "<":
                        q = self.type_at(self.p)
                        if q > 0 and k[q] == "∷":
                            self.p = q
                            sort = "o"
                            continue
                    self.p += 1
                    if k[self.p] == "(":
                        self.arguments()
                        sort = "c"
                    else:
                        sort = "v"
                elif c == "<":
                    self.p = self.need_at(self.arguments_at(self.p))
                    if k[self.p] == SUPER:
                        self.p += 1
                    else:
                        self.need(NAME, "method name")
                    self.arguments()
                    sort = "c"
                elif c == CLASS or c == THIS:
                    self.p += 1
                    sort = "o"
                elif c == SUPER:
                    self.p += 1
                    sort = "o"
                    if k[self.p] == "(":
                        self.arguments()
                        sort = "c"
                    elif k[self.p] not in ".∷":
                        self.fail(".")
                elif c == NEW:
                    sort = self.creation()
                else:
                    self.fail("name")
            elif c == "[":
                if k[self.p + 1] == "]":
                    self.dims()
                    if k[self.p] not in ".∷":
                        self.fail("expression")
                    sort = "o"
                    continue
                self.p += 1
                self.expression()
                self.need("]")
                sort = "v"
            elif c == "∷":
                self.p += 1
                if k[self.p] == "<":
                    self.p = self.need_at(self.arguments_at(self.p))
                if k[self.p] == NEW:
                    self.p += 1
                else:
                    self.need(NAME, "method name")
                sort = "o"
            else:
                return sort


_KINDS = Kinds()


def errors(text: str) -> list[tuple[int, str]]:
    """(line, what was wanted) for each error, in order; none if the text is a compilation unit of Java 8.

    An empty text, or one of comments only, is a valid compilation unit.
    """
    tokens = TOKEN.findall(text)
    kinds = "".join(map(_KINDS.__getitem__, tokens))
    if kinds.endswith(WRONG) and tokens and tokens[-1] == "\x1a":
        kinds = kinds[:-1]
    parser = Parser(kinds)
    parser.compilation_unit()
    if not parser.errors:
        return []
    starts = [m.start() for m in TOKEN.finditer(text) if _KINDS[m.group()]]
    lines = lambda at: text.count("\n", 0, starts[at] if at < len(starts) else len(text)) + 1
    return [(lines(at), want) for at, want in sorted(parser.errors)]
