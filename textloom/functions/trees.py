"""Ordered labelled trees of source files and what is derived from them."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

# Kinds whose value an abstract fingerprint leaves out.
JAVA_ABSTRACT = frozenset(
    "IDENTIFIER CLASS_DECL INTERFACE_DECL ENUM_DECL RECORD_DECL FUNCTION_DECL CONSTRUCTOR_DECL VARIABLE_DECL PARAMETER STRING_LITERAL NUMBER_LITERAL BOOL_LITERAL NULL_LITERAL BINARY_EXPR UNARY_EXPR CALL_EXPR".split()
)
HASKELL_ABSTRACT = frozenset(
    "FUNCTION_DECL TYPE_DECL NEWTYPE_DECL DATA_DECL CLASS_DECL INSTANCE_DECL TYPE_SIG PATTERN_BIND VARID CONID MODID CHAR_LITERAL INTEGER_LITERAL FLOAT_LITERAL STRING_LITERAL".split()
)
ABSTRACT = {"java": JAVA_ABSTRACT, "haskell": HASKELL_ABSTRACT}


class Node:
    __slots__ = ("kind", "value", "children", "start", "end")

    def __init__(self, kind: str, value: str | None = None, children: Sequence["Node"] = (), start=(None, None), end=(None, None)):
        self.kind, self.value, self.children, self.start, self.end = kind, value, list(children), start, end


def gather(parts: Sequence[Node | None], start, end) -> Node | None:
    """What a rule without a kind of its own stands for: nothing, its only part, or a node that holds its parts."""
    parts = [p for p in parts if p is not None]
    if len(parts) < 2:
        return parts[0] if parts else None
    return Node("UNKNOWN", None, parts, start, end)


def rows(root: Node, lang: str) -> list[tuple]:
    """Preorder rows (node_id, parent_id, child_ix, kind, value, start_line, start_char, end_line, end_char, weight, height,
    bfs_ix, post_ix, fp_strict, fp_abstract). The nodes below one are those of the next weight - 1 rows.

    weight is 1 and the weights of the children, height 1 more than that of the highest child; a fingerprint is the md5 of kind
    and value (without the value, for kinds that are abstracted, in the abstract one) followed by those of the children.
    """
    abstract = ABSTRACT.get(lang, frozenset())
    order: list[tuple[Node, int, int]] = []
    stack = [(root, -1, 0)]
    while stack:
        node, parent, ix = stack.pop()
        me = len(order)
        order.append((node, parent, ix))
        for i in range(len(node.children) - 1, -1, -1):
            stack.append((node.children[i], me, i))
    n = len(order)
    weight, height, strict, loose = [1] * n, [1] * n, [""] * n, [""] * n
    below: list[list[int]] = [[] for _ in range(n)]
    for i, (_, parent, _) in enumerate(order):
        if parent >= 0:
            below[parent].append(i)
    md5 = lambda s: hashlib.md5(s.encode("utf-8", "surrogatepass")).hexdigest()
    for i in range(n - 1, -1, -1):
        node, kids = order[i][0], below[i]
        weight[i] = 1 + sum(weight[k] for k in kids)
        height[i] = 1 + max((height[k] for k in kids), default=0)
        value = node.value or ""
        strict[i] = md5(f"{node.kind}:{value}" + "".join(strict[k] for k in kids))
        loose[i] = md5(f"{node.kind}:{'' if node.kind in abstract else value}" + "".join(loose[k] for k in kids))
    bfs, level, at = [0] * n, [0] if n else [], 0
    while level:
        for i in level:
            bfs[i] = at
            at += 1
        level = [k for i in level for k in below[i]]
    post, at, walk = [0] * n, 0, [(0, False)] if n else []
    while walk:
        i, ready = walk.pop()
        if ready:
            post[i] = at
            at += 1
        else:
            walk.append((i, True))
            walk.extend((k, False) for k in reversed(below[i]))
    return [
        (i, parent if parent >= 0 else None, ix, node.kind, node.value, node.start[0], node.start[1], node.end[0], node.end[1], weight[i], height[i], bfs[i], post[i], strict[i], loose[i])
        for i, (node, parent, ix) in enumerate(order)
    ]
