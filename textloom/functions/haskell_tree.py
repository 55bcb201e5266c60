"""Syntax trees and bindings of Haskell source, over tokens in which layout is explicit.

A documented subset: modules, imports and exports; type, data, newtype, class and instance declarations with deriving; fixities;
signatures; function and pattern bindings with guards and where; expressions with operators, application, lambda, let, if, case,
do, tuples, lists, sequences, comprehensions, sections, annotations and records; patterns, which are read as expressions.
Pragmas, Template Haskell and arrows are left out. A declaration that doesn't parse becomes one node UNKNOWN.
"""

from __future__ import annotations

from textloom.functions.haskell_tokens import CLOSE, OPEN, SEMI, tokens
from textloom.functions.java_tokens import Token
from textloom.functions.trees import Node, gather

LITERALS = {"DECIMAL": "INTEGER_LITERAL", "OCTAL": "INTEGER_LITERAL", "HEXADECIMAL": "INTEGER_LITERAL", "FLOAT": "FLOAT_LITERAL", "CHAR": "CHAR_LITERAL", "STRING": "STRING_LITERAL"}
OPENERS, SEPARATORS, CLOSERS = (OPEN, "{"), (SEMI, ";"), (CLOSE, "}")
NO_OPERATORS = frozenset(("..", "::", "=", "\\", "|", "<-", "->", "@", "=>"))


class Unparsable(Exception):
    pass


class Builder:
    def __init__(self, source: list[Token]):
        self.t, self.p = source, 0
        self.variables: list[tuple[int, str]] = []

    def at(self, k: int = 0) -> str:
        return self.t[self.p + k].text if 0 <= self.p + k < len(self.t) else ""

    def kind(self, k: int = 0) -> str:
        return self.t[self.p + k].type if 0 <= self.p + k < len(self.t) else "EOF"

    def here(self) -> tuple[int, int]:
        return (self.t[self.p].line, self.t[self.p].char) if self.p < len(self.t) else self.last()

    def last(self) -> tuple[int, int]:
        t = self.t[max(0, min(self.p, len(self.t)) - 1)] if self.t else None
        return (t.line, t.char) if t else (1, 0)

    def node(self, kind: str, start, parts, value: str | None = None) -> Node:
        return Node(kind, value, [p for p in parts if p is not None], start, self.last())

    def group(self, start, parts) -> Node | None:
        return gather(parts, start, self.last())

    def take(self, text: str):
        if self.at() != text:
            raise Unparsable(f"line {self.here()[0]}: {text} expected")
        self.p += 1

    def maybe(self, text: str) -> bool:
        if self.at() == text:
            self.p += 1
            return True
        return False

    def leaf(self, kind: str) -> Node:
        t = self.t[self.p]
        self.p += 1
        return Node(kind, t.text, (), (t.line, t.char), (t.line, t.char + len(t.text)))

    def text(self, first: int, last: int) -> str:
        return "".join(x.text for x in self.t[first:last])

    # blocks

    def block(self, item) -> list[Node | None]:
        if self.at() not in OPENERS:
            raise Unparsable(f"line {self.here()[0]}: block expected")
        self.p += 1
        out: list[Node | None] = []
        while True:
            while self.at() in SEPARATORS:
                self.p += 1
            if self.at() in CLOSERS:
                self.p += 1
                return out
            if self.p >= len(self.t):
                return out
            out.append(item())
            if self.at() not in SEPARATORS and self.at() not in CLOSERS:
                raise Unparsable(f"line {self.here()[0]}: end of item expected")

    # modules

    def module(self) -> Node:
        start, parts = self.here(), []
        if self.maybe("module"):
            parts.append(self.leaf("MODID"))
            if self.maybe("("):
                while self.at() != ")" and self.p < len(self.t):
                    at, one = self.here(), self.entity()
                    parts.append(self.node("EXPORT", at, one))
                    if not self.maybe(","):
                        break
                self.take(")")
            self.take("where")
        at = self.here()
        items: list[Node | None] = []
        if self.at() in OPENERS:
            items = self.block(self.top)
        body = self.node("BLOCK", at, items)
        parts.append(self.node("MODULE_CONTENT", at, [body]))
        return self.node("MODULE", start, parts)

    def entity(self) -> list[Node | None]:
        out: list[Node | None] = []
        if self.maybe("module"):
            return [self.leaf("MODID")]
        depth = 0
        while self.p < len(self.t) and not (depth == 0 and self.at() in (",", ")")):
            depth += (self.at() == "(") - (self.at() == ")")
            out.append(self.terminal())
        return out

    def terminal(self) -> Node | None:
        k = self.kind()
        if k in ("VARID", "CONID"):
            return self.leaf(k)
        if k in LITERALS:
            return self.leaf(LITERALS[k])
        if k == "OPERATOR":
            return self.leaf("OPERATOR")
        self.p += 1
        return None

    def skip_item(self):
        depth = 0
        while self.p < len(self.t):
            x = self.at()
            if depth == 0 and (x in SEPARATORS or x in CLOSERS):
                return
            depth += (x in OPENERS) - (x in CLOSERS)
            self.p += 1

    def top(self) -> Node | None:
        start, first = self.here(), self.p
        try:
            out = self.declaration_top()
            if self.at() not in SEPARATORS and self.at() not in CLOSERS and self.p < len(self.t):
                raise Unparsable("end of declaration expected")
            return out
        except (Unparsable, RecursionError):
            self.p = first
            self.skip_item()
            return Node("UNKNOWN", None, (), start, self.last())

    def declaration_top(self) -> Node | None:
        start, word = self.here(), self.at()
        if word == "import":
            self.p += 1
            self.maybe("qualified")
            parts: list[Node | None] = [self.leaf("MODID")]
            if self.maybe("as"):
                parts.append(self.leaf("MODID"))
            self.maybe("hiding")
            if self.maybe("("):
                while self.at() != ")" and self.p < len(self.t):
                    at = self.here()
                    parts.append(self.group(at, self.entity()))
                    if not self.maybe(","):
                        break
                self.take(")")
            return self.node("IMPORT", start, parts)
        if word in ("data", "newtype"):
            self.p += 1
            parts = [self.head()]
            if self.maybe("="):
                at, constructors = self.here(), [self.constructor()]
                while self.maybe("|"):
                    constructors.append(self.constructor())
                parts.append(self.node("BLOCK", at, constructors))
            while self.at() == "deriving":
                at = self.here()
                self.p += 1
                classes: list[Node | None] = []
                if self.maybe("("):
                    while self.at() != ")":
                        classes.append(self.type())
                        if not self.maybe(","):
                            break
                    self.take(")")
                else:
                    classes.append(self.leaf("CONID"))
                parts.append(self.node("DERIVING", at, classes))
            return self.node("DATA_DECL" if word == "data" else "NEWTYPE_DECL", start, parts)
        if word == "type":
            self.p += 1
            parts = [self.head()]
            self.take("=")
            parts.append(self.type())
            return self.node("TYPE_DECL", start, parts)
        if word in ("class", "instance"):
            self.p += 1
            parts = [self.head()]
            if self.at() == "where":
                at = self.here()
                self.p += 1
                parts.append(self.node("WHERE_BLOCK", at, self.block(self.declaration)))
            return self.node("CLASS_DECL" if word == "class" else "INSTANCE_DECL", start, parts)
        return self.declaration()

    def head(self) -> Node | None:
        start = self.here()
        out = self.btype()
        if self.maybe("=>"):
            return self.node("TYPE_CONSTRAINT", start, [out, self.btype()])
        return out

    def constructor(self) -> Node:
        start = self.here()
        if self.kind() == "CONID" and self.at(1) == "{":
            parts: list[Node | None] = [self.leaf("CONID")]
            self.p += 1
            while self.at() != "}":
                at, field = self.here(), []
                while self.kind() == "VARID":
                    field.append(self.leaf("VARID"))
                    self.maybe(",")
                self.take("::")
                self.maybe("!")
                field.append(self.type())
                parts.append(self.node("RECORD_FIELD", at, field))
                if not self.maybe(","):
                    break
            self.take("}")
        else:
            parts = []
            while True:
                self.maybe("!")
                if self.kind() in ("CONID", "VARID") or self.at() in ("(", "["):
                    parts.append(self.atype())
                elif self.kind() == "OPERATOR" and self.at().startswith(":"):
                    parts.append(self.leaf("OPERATOR"))
                else:
                    break
            if not parts:
                raise Unparsable("constructor expected")
        return self.node("CONSTRUCTOR", start, parts)

    # types

    def type(self) -> Node | None:
        start = self.here()
        if self.at() == "forall":
            self.p += 1
            parts: list[Node | None] = []
            while self.kind() == "VARID":
                parts.append(self.leaf("VARID"))
            self.p += 1
            return self.node("TYPE_FORALL", start, [*parts, self.type()])
        left = self.btype()
        if self.maybe("=>"):
            return self.node("TYPE_CONSTRAINT", start, [left, self.type()])
        if self.maybe("->"):
            return self.node("TYPE_FUN", start, [left, self.type()])
        return left

    def btype(self) -> Node:
        start, parts = self.here(), [self.atype()]
        while self.kind() in ("CONID", "VARID") or self.at() in ("(", "["):
            parts.append(self.atype())
        return self.node("TYPE_APP", start, parts)

    def atype(self) -> Node:
        start = self.here()
        if self.kind() in ("CONID", "VARID"):
            return self.node("TYPE_APP", start, [self.leaf(self.kind())])
        if self.maybe("("):
            parts: list[Node | None] = []
            while self.at() != ")":
                if self.at() in (",", "->"):
                    self.p += 1
                    continue
                parts.append(self.type())
            self.take(")")
            return self.node("TYPE_APP", start, parts)
        if self.maybe("["):
            inner = [] if self.at() == "]" else [self.type()]
            self.take("]")
            return self.node("TYPE_APP", start, inner)
        raise Unparsable(f"line {start[0]}: type expected")

    # bindings

    def declaration(self) -> Node | None:
        start, first = self.here(), self.p
        if self.at() in ("infix", "infixl", "infixr"):
            parts: list[Node | None] = []
            while self.at() not in SEPARATORS and self.at() not in CLOSERS and self.p < len(self.t):
                parts.append(self.terminal())
            return self.node("FIXITY_DECL", start, parts)
        if self.is_signature():
            parts = []
            while self.at() != "::":
                parts.append(self.terminal())
            self.p += 1
            return self.node("TYPE_SIG", start, [*parts, self.type()])
        word = self.at()
        left = self.infix()
        self.variables.append((start[0], self.text(first, self.p).split("::")[0]))
        annotated = self.type() if self.maybe("::") else None
        right = self.right_side("=")
        pattern = word[:1].isupper() or word in ("(", "[")
        return self.node("PATTERN_BIND" if pattern else "FUNCTION_DECL", start, [left, annotated, right])

    def is_signature(self) -> bool:
        k = 0
        while True:
            if self.kind(k) == "VARID":
                k += 1
            elif self.at(k) == "(" and self.at(k + 2) == ")":
                k += 3
            else:
                return False
            if self.at(k) != ",":
                return self.at(k) == "::"
            k += 1

    def right_side(self, sign: str) -> Node:
        start, parts = self.here(), []
        if self.maybe(sign):
            parts.append(self.exp())
        elif self.at() == "|":
            guards, at = [], self.here()
            while self.at() == "|":
                one_at = self.here()
                self.p += 1
                tests = self.qualifiers()
                self.take(sign)
                guards.append(self.node("GUARD_EXPR", one_at, [*tests, self.exp()]))
            parts.append(self.node("BLOCK", at, guards))
        else:
            raise Unparsable(f"line {start[0]}: {sign} expected")
        self.skip_close_before_where()
        if self.at() == "where":
            at = self.here()
            self.p += 1
            parts.append(self.node("WHERE_BLOCK", at, self.block(self.declaration)))
        return self.node("BLOCK", start, parts)

    def skip_close_before_where(self):
        if self.at() in SEPARATORS and self.at(1) == "where":
            self.p += 1

    # expressions

    def exp(self) -> Node | None:
        start = self.here()
        out = self.infix()
        if self.maybe("::"):
            return self.node("TYPE_ANNOTATION", start, [out, self.type()])
        return out

    def is_operator(self) -> bool:
        if self.at() == "`":
            return True
        return (self.kind() == "OPERATOR" or self.at() in (":", "~")) and self.at() not in NO_OPERATORS

    def operator(self) -> Node | None:
        start = self.here()
        if self.maybe("`"):
            out = self.leaf(self.kind() if self.kind() in ("VARID", "CONID") else "VARID")
            self.take("`")
            return self.group(start, [out])
        return self.leaf("OPERATOR")

    def infix(self) -> Node | None:
        start = self.here()
        parts = [self.operand()]
        while self.is_operator() and self.at(3 if self.at() == "`" else 1) != ")":
            parts.append(self.operator())
            parts.append(self.operand())
        return self.node("INFIX_EXPR", start, parts) if len(parts) > 1 else parts[0]

    def operand(self) -> Node | None:
        start = self.here()
        if self.at() == "-":
            self.p += 1
            return self.node("NEGATE_EXPR", start, [self.application()])
        return self.application()

    def application(self) -> Node | None:
        start, word = self.here(), self.at()
        if word == "\\":
            self.p += 1
            parts = []
            while self.at() != "->":
                parts.append(self.aexp())
            self.p += 1
            return self.node("LAMBDA_EXPR", start, [*parts, self.exp()])
        if word == "let":
            self.p += 1
            at = self.here()
            binds = self.node("BLOCK", at, self.block(self.declaration))
            self.take("in")
            return self.node("LET_EXPR", start, [binds, self.exp()])
        if word == "if":
            self.p += 1
            parts = [self.exp()]
            for keyword in ("then", "else"):
                if self.at() in SEPARATORS:
                    self.p += 1
                self.take(keyword)
                parts.append(self.exp())
            return self.node("IF_EXPR", start, parts)
        if word == "case":
            self.p += 1
            scrutinee = self.exp()
            self.take("of")
            at = self.here()
            return self.node("CASE_EXPR", start, [scrutinee, self.node("BLOCK", at, self.block(self.alternative))])
        if word in ("do", "mdo"):
            self.p += 1
            at = self.here()
            return self.node("DO_EXPR", start, [self.node("BLOCK", at, self.block(self.statement))])
        parts = [self.aexp()]
        while self.starts_aexp():
            parts.append(self.aexp())
        return self.node("APP_EXPR", start, parts)

    def starts_aexp(self) -> bool:
        return self.kind() in ("VARID", "CONID") or self.kind() in LITERALS or self.at() in ("(", "[", "~", "_")

    def aexp(self) -> Node | None:
        start, k = self.here(), self.kind()
        if self.at() == "_":
            self.p += 1
            out: Node | None = Node("PAT_WILDCARD", None, (), start, start)
        elif k in ("VARID", "CONID"):
            out = self.leaf(k)
            if self.at() == "@":
                self.p += 1
                return self.node("PAT_AS", start, [out, self.aexp()])
        elif k in LITERALS:
            out = self.leaf(LITERALS[k])
        elif self.maybe("~"):
            return self.node("PAT_IRREFUTABLE", start, [self.aexp()])
        elif self.at() == "(":
            out = self.parenthesized()
        elif self.at() == "[":
            out = self.bracketed()
        else:
            raise Unparsable(f"line {start[0]}: expression expected")
        while self.at() == "{" and self.kind(1) in ("VARID",) and self.at(2) == "=":
            self.p += 1
            fields: list[Node | None] = []
            while self.at() != "}":
                at, one = self.here(), [self.leaf("VARID")]
                self.take("=")
                one.append(self.exp())
                fields.append(self.group(at, one))
                if not self.maybe(","):
                    break
            self.take("}")
            out = self.group(start, [out, *fields])
        return out

    def parenthesized(self) -> Node | None:
        start = self.here()
        self.take("(")
        if self.at() in (")", ","):
            while self.maybe(","):
                pass
            self.take(")")
            return None
        if self.is_operator() and self.at() != "~" and self.at() != "-" or self.at() == "-" and self.at(1) == ")":
            op = self.operator()
            if self.maybe(")"):
                return op
            out = self.node("SECTION_RIGHT", start, [op, self.infix()])
            self.take(")")
            return out
        parts = [self.exp()]
        if self.is_operator():
            parts.append(self.operator())
            self.take(")")
            return self.node("SECTION_LEFT", start, parts)
        if self.at() == ",":
            while self.maybe(","):
                parts.append(self.exp())
            self.take(")")
            return self.node("TUPLE_EXPR", start, parts)
        self.take(")")
        return parts[0]

    def bracketed(self) -> Node | None:
        start = self.here()
        self.take("[")
        if self.maybe("]"):
            return None
        parts, kind = [self.exp()], "LIST_EXPR"
        while self.maybe(","):
            parts.append(self.exp())
        if self.maybe(".."):
            kind = "ARITHMETIC_SEQ"
            if self.at() != "]":
                parts.append(self.exp())
        elif self.maybe("|"):
            kind = "LIST_COMPREHENSION"
            at = self.here()
            parts.append(self.node("BLOCK", at, self.qualifiers()))
        self.take("]")
        return self.node(kind, start, parts)

    def qualifiers(self) -> list[Node | None]:
        out = [self.statement()]
        while self.maybe(","):
            out.append(self.statement())
        return out

    def alternative(self) -> Node:
        start = self.here()
        return self.node("EQUATION", start, [self.exp(), self.right_side("->")])

    def statement(self) -> Node | None:
        start, first = self.here(), self.p
        if self.at() == "let":
            self.p += 1
            at = self.here()
            binds = self.node("BLOCK", at, self.block(self.declaration))
            if self.maybe("in"):
                return self.node("DO_STMT", start, [self.node("LET_EXPR", start, [binds, self.exp()])])
            return self.node("DO_LET", start, [binds])
        left = self.exp()
        if self.at() == "<-":
            self.variables.append((start[0], self.text(first, self.p)))
            self.p += 1
            return self.node("DO_BIND", start, [left, self.exp()])
        return self.node("DO_STMT", start, [left])


def tree(text: str) -> tuple[Node, list[tuple[int, str]], str | None]:
    """The tree, the bound left sides as (line, text up to ::), and why the module as a whole doesn't parse, if so."""
    builder = Builder(tokens(text))
    try:
        return builder.module(), builder.variables, None
    except (Unparsable, RecursionError, IndexError) as e:
        return Node("UNKNOWN"), builder.variables, str(e)[:200] or "nesting"
