"""Syntax trees and declarations of Java source.

The parser accepts more than the language does (it is for comparing programs, not for checking them), up to records, switch
expressions and patterns. Trees keep declarations, statements, literals and names; punctuation, modifiers and primitive types
leave no node, and a construct without a kind of its own is replaced by its parts.
"""

from __future__ import annotations

from textloom.functions.java_tokens import DEFAULT, Token, tokens
from textloom.functions.trees import Node, gather

MODIFIERS = frozenset("public protected private static abstract final strictfp native synchronized transient volatile default sealed".split())
PRIMITIVES = frozenset("boolean char byte short int long float double".split())
LEAF = {"IDENTIFIER": "IDENTIFIER", "STRING_LITERAL": "STRING_LITERAL", "CHAR_LITERAL": "STRING_LITERAL", "DECIMAL_LITERAL": "NUMBER_LITERAL", "FLOAT_LITERAL": "NUMBER_LITERAL", "BOOL_LITERAL": "BOOL_LITERAL", "NULL_LITERAL": "NULL_LITERAL"}
LITERALS = frozenset(("STRING_LITERAL", "CHAR_LITERAL", "DECIMAL_LITERAL", "HEX_LITERAL", "OCT_LITERAL", "BINARY_LITERAL", "FLOAT_LITERAL", "HEX_FLOAT_LITERAL", "BOOL_LITERAL", "NULL_LITERAL", "TEXT_BLOCK"))
ASSIGN = frozenset(("=", "+=", "-=", "*=", "/=", "&=", "|=", "^=", "%=", "<<=", ">>=", ">>>="))
LEVELS = {"||": 2, "&&": 3, "|": 4, "^": 5, "&": 6, "==": 7, "!=": 7, "<": 8, ">": 8, "<=": 8, ">=": 8, "instanceof": 8, "<<": 9, ">>": 9, ">>>": 9, "+": 10, "-": 10, "*": 11, "/": 11, "%": 11}


class Unparsable(Exception):
    pass


class Builder:
    def __init__(self, source: list[Token]):
        self.t = [x for x in source if x.channel == DEFAULT]
        self.end = Token(-1, "EOF", "", DEFAULT, self.t[-1].line if self.t else 1)
        self.p = 0
        self.variables: list[tuple[int, str]] = []
        self.arrows: dict[int, bool] = {}

    # tokens

    def at(self, k: int = 0) -> str:
        return self.t[self.p + k].text if self.p + k < len(self.t) else ""

    def tok(self, k: int = 0) -> Token:
        return self.t[self.p + k] if self.p + k < len(self.t) else self.end

    def is_name(self, k: int = 0) -> bool:
        return self.tok(k).type == "IDENTIFIER"

    def take(self, text: str):
        if self.at() != text:
            raise Unparsable(f"line {self.tok().line}: {text} expected")
        self.p += 1

    def maybe(self, text: str) -> bool:
        if self.at() == text:
            self.p += 1
            return True
        return False

    def here(self) -> tuple[int, int]:
        return self.tok().line, self.tok().char

    def last(self) -> tuple[int, int]:
        t = self.t[max(0, min(self.p, len(self.t)) - 1)] if self.t else self.end
        return t.line, t.char

    def node(self, kind: str, start, parts, value: str | None = None) -> Node:
        return Node(kind, value, [p for p in parts if p is not None], start, self.last())

    def group(self, start, parts) -> Node | None:
        return gather(parts, start, self.last())

    def leaf(self, kind: str | None = None) -> Node | None:
        t = self.tok()
        self.p += 1
        kind = kind or LEAF.get(t.type)
        return Node(kind, t.text, (), (t.line, t.char), (t.line, t.char + len(t.text))) if kind else None

    def name(self) -> Node:
        if not self.is_name():
            raise Unparsable(f"line {self.tok().line}: name expected")
        return self.leaf()

    def qualified(self) -> Node | None:
        start, parts = self.here(), [self.name()]
        while self.at() == "." and self.is_name(1):
            self.p += 1
            parts.append(self.name())
        return self.group(start, parts)

    # types

    def type(self) -> Node:
        start, parts = self.here(), []
        while self.at() == "@":
            parts.append(self.annotation())
        if self.at() in PRIMITIVES or self.at() == "void":
            self.p += 1
        else:
            inner, at = [], self.here()
            while True:
                inner.append(self.name())
                if self.at() == "<":
                    inner.append(self.type_arguments())
                if self.at() == "." and self.is_name(1):
                    self.p += 1
                    continue
                break
            parts.append(self.group(at, inner))
        while self.at() == "[" and self.at(1) == "]":
            self.p += 2
        return self.node("TYPE", start, parts)

    def type_arguments(self) -> Node | None:
        start, parts = self.here(), []
        self.take("<")
        while self.at() != ">":
            if self.maybe("?"):
                if self.at() in ("extends", "super"):
                    self.p += 1
                    parts.append(self.type())
            else:
                parts.append(self.type())
            if not self.maybe(","):
                break
        self.take(">")
        return self.group(start, parts)

    def skip_type(self) -> bool:
        """Whether a type is here; reads it if so."""
        save = self.p
        try:
            if not (self.is_name() or self.at() in PRIMITIVES or self.at() == "@"):
                return False
            self.type()
            return True
        except Unparsable:
            self.p = save
            return False

    def type_parameters(self) -> Node | None:
        start, parts = self.here(), []
        self.take("<")
        while self.at() != ">":
            at, one = self.here(), [self.name()]
            if self.maybe("extends"):
                bounds, bound_at = [self.type()], self.here()
                while self.maybe("&"):
                    bounds.append(self.type())
                one.append(self.group(bound_at, bounds))
            parts.append(self.group(at, one))
            if not self.maybe(","):
                break
        self.take(">")
        return self.group(start, parts)

    def type_list(self) -> Node | None:
        start, parts = self.here(), [self.type()]
        while self.maybe(","):
            parts.append(self.type())
        return self.group(start, parts)

    # declarations

    def annotation(self) -> Node | None:
        start = self.here()
        self.take("@")
        parts = [self.qualified()]
        if self.maybe("("):
            while self.at() != ")":
                if self.is_name() and self.at(1) == "=":
                    at, pair = self.here(), [self.name()]
                    self.p += 1
                    pair.append(self.element_value())
                    parts.append(self.group(at, pair))
                else:
                    parts.append(self.element_value())
                if not self.maybe(","):
                    break
            self.take(")")
        return self.group(start, parts)

    def element_value(self) -> Node | None:
        if self.at() == "@":
            return self.annotation()
        if self.at() == "{":
            return self.array_initializer(self.element_value)
        return self.expression()

    def modifiers(self) -> list[Node | None]:
        parts = []
        while True:
            if self.at() == "@" and self.at(1) != "interface":
                parts.append(self.annotation())
            elif self.at() in MODIFIERS and not (self.at() == "default" and self.at(1) in (":", "->")) and not (self.at() == "sealed" and not self.at(1).isidentifier()):
                self.p += 1
            elif self.at() == "non" and self.at(1) == "-" and self.at(2) == "sealed":
                self.p += 3
            else:
                return parts

    def compilation_unit(self) -> Node:
        start, parts = self.here(), []
        while self.p < len(self.t):
            at = self.here()
            if self.maybe(";"):
                continue
            if self.at() == "import":
                self.p += 1
                self.maybe("static")
                parts.append(self.qualified())
                if self.maybe("."):
                    self.take("*")
                self.take(";")
                continue
            mods = self.modifiers()
            if self.maybe("package"):
                parts.append(self.group(at, [*mods, self.qualified()]))
                self.take(";")
                continue
            parts.append(self.group(at, [*mods, self.type_declaration()]))
        return self.node("PROGRAM", start, parts)

    def starts_type_declaration(self) -> bool:
        return self.at() in ("class", "interface", "enum") or self.at() == "@" and self.at(1) == "interface" or self.at() == "record" and self.is_name(1) and self.at(2) in ("(", "<")

    def type_declaration(self) -> Node:
        start, word = self.here(), self.at()
        if word == "@":
            self.p += 2
            parts = [self.name(), self.class_body()]
            return self.node("UNKNOWN", start, parts)
        if word not in ("class", "interface", "enum", "record"):
            raise Unparsable(f"line {self.tok().line}: declaration expected")
        self.p += 1
        parts = [self.name()]
        if self.at() == "<":
            parts.append(self.type_parameters())
        if word == "record":
            self.take("(")
            inner, at = [], self.here()
            while self.at() != ")":
                one_at = self.here()
                inner.append(self.group(one_at, [*self.modifiers(), self.type(), self.name()]))
                if not self.maybe(","):
                    break
            self.take(")")
            parts.append(self.group(at, inner))
        for clause in ("extends", "implements", "permits"):
            if self.maybe(clause):
                parts.append(self.type_list() if clause != "extends" or word == "interface" else self.type())
        if word == "enum":
            self.take("{")
            constants, at = [], self.here()
            while self.at() not in (";", "}"):
                one_at, one = self.here(), [*self.modifiers(), self.name()]
                if self.at() == "(":
                    one.append(self.arguments())
                if self.at() == "{":
                    one.append(self.class_body())
                constants.append(self.group(one_at, one))
                if not self.maybe(","):
                    break
            parts.append(self.group(at, constants))
            if self.maybe(";"):
                body_at, members = self.here(), []
                while self.at() != "}":
                    members.append(self.member())
                parts.append(self.group(body_at, members))
            self.take("}")
        else:
            parts.append(self.class_body())
        return self.node({"class": "CLASS_DECL", "interface": "INTERFACE_DECL", "enum": "ENUM_DECL", "record": "RECORD_DECL"}[word], start, parts)

    def class_body(self) -> Node:
        start, parts = self.here(), []
        self.take("{")
        while self.at() != "}":
            if self.p >= len(self.t):
                raise Unparsable("end of file in a class")
            parts.append(self.member())
        self.p += 1
        return self.node("BLOCK", start, parts)

    def member(self) -> Node | None:
        start = self.here()
        if self.maybe(";"):
            return None
        if self.at() == "{" or self.at() == "static" and self.at(1) == "{":
            self.maybe("static")
            return self.block()
        mods = self.modifiers()
        if self.starts_type_declaration():
            return self.group(start, [*mods, self.type_declaration()])
        generic = self.type_parameters() if self.at() == "<" else None
        at = self.here()
        if self.is_name() and self.at(1) in ("(", "{"):
            parts = [self.name()]
            if self.at() == "(":
                parts.append(self.parameters())
            parts.extend(self.throws())
            parts.append(self.block())
            return self.group(start, [*mods, self.group(start, [generic, self.node("CONSTRUCTOR_DECL", at, parts)])])
        first = self.p
        if self.at() == "void":
            self.p += 1
            type_ = None
        else:
            type_ = self.type()
        if self.at(1) == "(":
            parts = [type_, self.name(), self.parameters()]
            while self.at() == "[":
                self.p += 2
            parts.extend(self.throws())
            if self.maybe("default"):
                parts.append(self.element_value())
            parts.append(None if self.maybe(";") else self.block())
            return self.group(start, [*mods, self.group(start, [generic, self.node("FUNCTION_DECL", at, parts)])])
        declared = self.declarators()
        self.take(";")
        self.variables.append((at[0], "".join(x.text for x in self.t[first : self.p]).split("=")[0]))
        return self.group(start, [*mods, self.group(at, [type_, declared])])

    def throws(self) -> list[Node | None]:
        if not self.maybe("throws"):
            return []
        start, parts = self.here(), [self.qualified()]
        while self.maybe(","):
            parts.append(self.qualified())
        return [self.group(start, parts)]

    def parameters(self) -> Node | None:
        start, parts = self.here(), []
        self.take("(")
        while self.at() != ")":
            at, one = self.here(), [*self.modifiers(), self.type()]
            kind = "PARAMETER"
            if self.maybe("..."):
                kind = "UNKNOWN"
            if self.at() == "this":
                self.p += 1
            else:
                one.append(self.name())
                while self.at() == "[":
                    self.p += 2
            parts.append(self.node(kind, at, one))
            if not self.maybe(","):
                break
        self.take(")")
        return self.group(start, parts)

    def declarators(self) -> Node | None:
        start, parts = self.here(), []
        while True:
            at, one = self.here(), [self.name()]
            while self.at() == "[":
                self.p += 2
            if self.maybe("="):
                one.append(self.initializer())
            parts.append(self.node("VARIABLE_DECL", at, one))
            if not self.maybe(","):
                return self.group(start, parts)

    def initializer(self) -> Node | None:
        return self.array_initializer(self.initializer) if self.at() == "{" else self.expression()

    def array_initializer(self, item) -> Node | None:
        start, parts = self.here(), []
        self.take("{")
        while self.at() != "}":
            parts.append(item())
            if not self.maybe(","):
                break
        self.take("}")
        return self.group(start, parts)

    # statements

    def block(self) -> Node:
        start, parts = self.here(), []
        self.take("{")
        while self.at() != "}":
            if self.p >= len(self.t):
                raise Unparsable("end of file in a block")
            parts.append(self.block_statement())
        self.p += 1
        return self.node("BLOCK", start, parts)

    def is_local(self) -> bool:
        if self.at() in ("final", "@"):
            return True
        if self.at() in PRIMITIVES:
            return self.at(1) not in (".", "::") and not (self.at(1) == "[" and self.at(3) in (".", "::"))
        if not self.is_name():
            return False
        save = self.p
        ok = self.skip_type() and self.is_name()
        self.p = save
        return ok

    def local(self) -> Node | None:
        start, first = self.here(), self.p
        mods = self.modifiers()
        type_ = self.type()
        declared = self.declarators()
        self.variables.append((start[0], "".join(x.text for x in self.t[first : self.p]).split("=")[0]))
        return self.group(start, [*mods, type_, declared])

    def block_statement(self) -> Node | None:
        start = self.here()
        if self.starts_type_declaration() or self.at() in ("final", "abstract", "static", "strictfp") and self._class_after_modifiers():
            mods = self.modifiers()
            return self.group(start, [*mods, self.type_declaration()])
        if self.at() != "yield" and self.is_local():
            out = self.local()
            self.take(";")
            return out
        return self.statement()

    def _class_after_modifiers(self) -> bool:
        k = 0
        while self.at(k) in MODIFIERS:
            k += 1
        return self.at(k) in ("class", "interface", "enum", "record")

    def parenthesized(self) -> Node | None:
        self.take("(")
        out = self.expression()
        self.take(")")
        return out

    def statement(self) -> Node | None:
        start, word = self.here(), self.at()
        if word == "{":
            return self.block()
        if self.maybe(";"):
            return None
        if word == "if":
            self.p += 1
            parts = [self.parenthesized(), self.statement()]
            if self.maybe("else"):
                parts.append(self.statement())
            return self.node("IF_STATEMENT", start, parts)
        if word == "while":
            self.p += 1
            return self.node("WHILE_LOOP", start, [self.parenthesized(), self.statement()])
        if word == "do":
            self.p += 1
            parts = [self.statement()]
            self.take("while")
            parts.append(self.parenthesized())
            self.take(";")
            return self.node("DO_WHILE_LOOP", start, parts)
        if word == "for":
            self.p += 1
            self.take("(")
            control = self.for_control()
            self.take(")")
            return self.node("FOR_LOOP", start, [control, self.statement()])
        if word == "try":
            return self.try_(start)
        if word == "switch":
            self.p += 1
            parts = [self.parenthesized(), *self.switch_body()]
            return self.node("SWITCH_EXPR", start, parts)
        if word == "throw":
            self.p += 1
            value = self.expression()
            self.take(";")
            return self.node("THROW", start, [value])
        if word in ("return", "break", "continue"):
            parts = [self.leaf(word.upper())]
            if self.at() != ";":
                parts.append(self.expression() if word == "return" else self.name())
            self.take(";")
            return self.group(start, parts)
        if word == "synchronized":
            self.p += 1
            return self.group(start, [self.parenthesized(), self.block()])
        if word == "assert":
            self.p += 1
            parts = [self.expression()]
            if self.maybe(":"):
                parts.append(self.expression())
            self.take(";")
            return self.group(start, parts)
        if word == "yield" and self.at(1) not in ("=", ".", "(", "++", "--"):
            self.p += 1
            value = self.expression()
            self.take(";")
            return value
        if self.is_name() and self.at(1) == ":":
            label = self.name()
            self.p += 1
            return self.group(start, [label, self.statement()])
        out = self.expression()
        self.take(";")
        return out

    def for_control(self) -> Node | None:
        start = self.here()
        init = None
        if self.at() != ";":
            if self.is_local():
                save, kept = self.p, len(self.variables)
                mods = self.modifiers()
                type_, name = self.type(), self.name()
                if self.maybe(":"):
                    return self.group(start, [*mods, type_, name, self.expression()])
                self.p = save
                del self.variables[kept:]
                init = self.local()
            else:
                init = self.expressions()
        self.take(";")
        test = self.expression() if self.at() != ";" else None
        self.take(";")
        return self.group(start, [init, test, self.expressions() if self.at() != ")" else None])

    def expressions(self) -> Node | None:
        start, parts = self.here(), [self.expression()]
        while self.maybe(","):
            parts.append(self.expression())
        return self.group(start, parts)

    def try_(self, start) -> Node:
        self.p += 1
        parts: list[Node | None] = []
        if self.maybe("("):
            at, resources = self.here(), []
            while self.at() != ")":
                one_at = self.here()
                if self.is_local():
                    mods = self.modifiers()
                    one = [*mods, self.type(), self.name()]
                    self.take("=")
                    one.append(self.expression())
                    resources.append(self.group(one_at, one))
                else:
                    resources.append(self.expression())
                if not self.maybe(";"):
                    break
            self.take(")")
            parts.append(self.group(at, resources))
        parts.append(self.block())
        while self.at() == "catch":
            at = self.here()
            self.p += 1
            self.take("(")
            one = self.modifiers()
            type_at, types = self.here(), [self.qualified()]
            while self.maybe("|"):
                types.append(self.qualified())
            one += [self.group(type_at, types), self.name()]
            self.take(")")
            one.append(self.block())
            parts.append(self.node("CATCH", at, one))
        if self.at() == "finally":
            at = self.here()
            self.p += 1
            parts.append(self.node("FINALLY", at, [self.block()]))
        return self.node("TRY_STATEMENT", start, parts)

    def switch_body(self) -> list[Node | None]:
        self.take("{")
        out: list[Node | None] = []
        while self.at() != "}":
            at, labels = self.here(), []
            arrow = False
            while self.at() in ("case", "default"):
                label_at, parts = self.here(), []
                if self.at() == "default":
                    self.p += 1
                else:
                    self.p += 1
                    parts.append(self.case_value())
                    while self.maybe(","):
                        parts.append(self.case_value())
                labels.append(self.node("CASE_LABEL", label_at, parts))
                if self.maybe("->"):
                    arrow = True
                    break
                self.take(":")
            if not labels:
                raise Unparsable(f"line {self.tok().line}: case expected")
            if arrow:
                body = self.block() if self.at() == "{" else self.statement() if self.at() == "throw" else self.expression()
                self.maybe(";")
                out.append(self.node("CASE_GROUP", at, [*labels[0].children, body]))
                continue
            body = []
            while self.at() not in ("}", "case") and not (self.at() == "default" and self.at(1) in (":", "->")):
                if self.p >= len(self.t):
                    raise Unparsable("end of file in a switch")
                body.append(self.block_statement())
            out.extend(labels if not body else [self.group(at, [*labels, *body])])
        self.p += 1
        return out

    def case_value(self) -> Node | None:
        start = self.here()
        if self.is_local():
            mods = self.modifiers()
            return self.node("PATTERN", start, [*mods, self.type(), self.name()])
        return self.ternary()

    # expressions

    def is_lambda(self) -> bool:
        if self.is_name() and self.at(1) == "->":
            return True
        if self.at() != "(":
            return False
        if self.p not in self.arrows:
            # one scan answers for all brackets within as well
            opened: list[int] = []
            for at in range(self.p, len(self.t)):
                x = self.t[at].text
                if x == "(":
                    opened.append(at)
                elif x == ")":
                    self.arrows[opened.pop()] = at + 1 < len(self.t) and self.t[at + 1].text == "->"
                    if not opened:
                        break
                elif x in (";", "{", "}"):
                    break
            self.arrows.update(dict.fromkeys(opened, False))
        return self.arrows[self.p]

    def expression(self) -> Node | None:
        start = self.here()
        if self.is_lambda():
            while self.at() != "->":
                self.p += 1
            self.p += 1
            return self.node("LAMBDA_EXPR", start, [self.block() if self.at() == "{" else self.expression()])
        left = self.ternary()
        op = self.operator()
        if op in ASSIGN:
            self.p += self.width(op)
            return self.node("BINARY_EXPR", start, [left, self.expression()], op)
        return left

    def operator(self) -> str:
        """The operator here; shifts are made of single signs."""
        x = self.at()
        if x == "<" and self.at(1) == "<" and self._adjacent(1):
            return "<<"
        if x == ">":
            if self.at(1) == ">" and self._adjacent(1):
                return ">>>" if self.at(2) == ">" and self._adjacent(2) else ">>"
        return x

    def _adjacent(self, k: int) -> bool:
        a, b = self.tok(k - 1), self.tok(k)
        return a.line == b.line and a.char + len(a.text) == b.char

    @staticmethod
    def width(op: str) -> int:
        return {"<<": 2, ">>": 2, ">>>": 3}.get(op, 1)

    def ternary(self) -> Node | None:
        start = self.here()
        out = self.binary(2)
        if self.maybe("?"):
            yes = self.expression()
            self.take(":")
            no = self.expression() if self.is_lambda() else self.ternary()
            return self.group(start, [out, yes, no])
        return out

    def binary(self, least: int) -> Node | None:
        start = self.here()
        out = self.unary()
        while True:
            op = self.operator()
            level = LEVELS.get(op, 0)
            if level < least:
                return out
            self.p += self.width(op)
            if op == "instanceof":
                at = self.here()
                mods = self.modifiers()
                type_ = self.type()
                if self.is_name():
                    type_ = self.node("PATTERN", at, [*mods, type_, self.name()])
                out = self.group(start, [out, type_])
            else:
                out = self.node("BINARY_EXPR", start, [out, self.binary(level + 1)], op)

    def unary(self) -> Node | None:
        start = self.here()
        if self.at() in ("+", "-", "++", "--", "~", "!"):
            op = self.at()
            self.p += 1
            return self.node("UNARY_EXPR", start, [self.unary()], op)
        if self.at() == "(":
            save = self.p
            self.p += 1
            primitive = self.at() in PRIMITIVES
            try:
                types = [self.type()] if self.is_name() or primitive else []
                while types and self.maybe("&"):
                    types.append(self.type())
            except Unparsable:
                types = []
            if types and self.maybe(")") and (primitive or self.is_name() or self.tok().type in LITERALS or self.at() in ("(", "!", "~", "this", "super", "new", "switch") or self.at() in PRIMITIVES):
                operand = self.expression() if self.is_lambda() else self.unary()
                return self.group(start, [*types, operand])
            self.p = save
        out = self.postfix(start)
        while self.at() in ("++", "--"):
            self.p += 1
        return out

    def arguments(self) -> Node | None:
        self.take("(")
        out = self.expressions() if self.at() != ")" else None
        self.take(")")
        return out

    def call_text(self, first: int) -> str:
        return "".join(x.text for x in self.t[first : self.p])

    def postfix(self, start) -> Node | None:
        out = self.primary()
        while True:
            x = self.at()
            if x == ".":
                self.p += 1
                if self.at() == "<":
                    generic = self.type_arguments()
                    name = self.name() if self.is_name() else None
                    if name is None:
                        self.p += 1
                    out = self.group(start, [out, self.group(start, [generic, name, self.arguments()])])
                elif self.at() == "new":
                    self.p += 1
                    out = self.group(start, [out, self.creation()])
                elif self.is_name():
                    at, name = self.here(), self.name()
                    out = self.group(start, [out, self.group(at, [name, self.arguments()]) if self.at() == "(" else name])
                elif self.at() in ("this", "class"):
                    self.p += 1
                elif self.at() == "super":
                    self.p += 1
                    if self.at() == "(":
                        out = self.group(start, [out, self.arguments()])
                else:
                    raise Unparsable(f"line {self.tok().line}: name expected")
            elif x == "[":
                self.p += 1
                index = self.expression()
                self.take("]")
                out = self.group(start, [out, index])
            elif x == "::":
                self.p += 1
                generic = self.type_arguments() if self.at() == "<" else None
                name = None
                if not self.maybe("new"):
                    name = self.name()
                out = self.group(start, [out, generic, name])
            else:
                return out

    def primary(self) -> Node | None:
        t, start = self.tok(), self.here()
        if t.type in LITERALS:
            return self.leaf()
        if t.text == "(":
            return self.parenthesized()
        if t.text in ("this", "super"):
            first = self.p
            self.p += 1
            if self.at() == "(":
                args = self.call_arguments()
                return self.node("CALL_EXPR", start, args, self.call_text(first))
            return None
        if t.text == "new":
            self.p += 1
            return self.creation()
        if t.text == "switch":
            self.p += 1
            return self.node("SWITCH_EXPR", start, [self.parenthesized(), *self.switch_body()])
        if t.text in PRIMITIVES or t.text == "void":
            out = self.type()
            if self.at() == "." and self.at(1) == "class":
                self.p += 2
            return out
        if t.type == "IDENTIFIER":
            if self.at(1) == "(":
                first = self.p
                self.p += 1
                args = self.call_arguments()
                return self.node("CALL_EXPR", start, args, self.call_text(first))
            if self.at(1) in ("<", "["):
                save = self.p
                if self.skip_type() and (self.at() == "::" or self.at() == "." and self.at(1) == "class"):
                    self.p = save
                    out = self.type()
                    if self.at() == ".":
                        self.p += 2
                    return out
                self.p = save
            return self.name()
        raise Unparsable(f"line {t.line}: expression expected")

    def call_arguments(self) -> list[Node | None]:
        self.take("(")
        out = []
        while self.at() != ")":
            out.append(self.expression())
            if not self.maybe(","):
                break
        self.take(")")
        return out

    def creation(self) -> Node | None:
        start, parts = self.here(), []
        if self.at() == "<":
            parts.append(self.type_arguments())
        while self.at() == "@":
            parts.append(self.annotation())
        if self.at() in PRIMITIVES:
            self.p += 1
        else:
            at, inner = self.here(), []
            while True:
                inner.append(self.name())
                if self.at() == "<":
                    inner.append(self.type_arguments())
                if self.at() == "." and self.is_name(1):
                    self.p += 1
                    continue
                break
            parts.append(self.group(at, inner))
        if self.at() == "[":
            rest = []
            while self.at() == "[":
                self.p += 1
                if self.at() != "]":
                    rest.append(self.expression())
                self.take("]")
            if self.at() == "{":
                rest.append(self.array_initializer(self.initializer))
            parts.append(self.group(start, rest))
        else:
            at, rest = self.here(), [self.arguments()]
            if self.at() == "{":
                rest.append(self.class_body())
            parts.append(self.group(at, rest))
        return self.group(start, parts)


def tree(text: str) -> tuple[Node, list[tuple[int, str]], str | None]:
    """The tree, the declarations of variables as (line, text up to the first =), and why it doesn't parse, if so: it is then one
    node UNKNOWN, and the declarations are those before the error."""
    builder = Builder(tokens(text))
    try:
        return builder.compilation_unit(), builder.variables, None
    except (Unparsable, RecursionError) as e:
        return Node("UNKNOWN"), builder.variables, str(e)[:200] or "nesting"
