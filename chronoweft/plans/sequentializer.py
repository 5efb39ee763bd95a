"""Rewriting of parallel parts of variants into other shapes, by a source and a target pattern.

    pattern := op '(' part, part, ... ')'      op: -> (sequence), + (parallel), x (choice)
    part    := 'a' | {'a', 'b'} | ... | pattern

``'a'`` is the first child with that label, ``{'a', 'b'}`` all children with one of them (at least one), and
``...`` all that's left. The source is one ``+``; the target has the same parts in any shape.
"""

from __future__ import annotations

import re

from chronoweft.plans import variant_tree as V

WILDCARD = ("...",)
Part = tuple
_TOKEN = re.compile(r"\s*(->|→|\+|∧|x|✕|\.\.\.|[(),{}]|'[^']*')")
_OPS = {"->": "follows", "→": "follows", "+": "parallel", "∧": "parallel", "x": "choice", "✕": "choice"}


def parse(raw: str) -> Part:
    """("op", parts), ("one", label), ("all", labels) or WILDCARD."""
    found, at = [], 0
    raw = raw.strip()
    while at < len(raw):
        m = _TOKEN.match(raw, at)
        if not m:
            raise ValueError(f"unexpected {raw[at:]!r}")
        found.append(m[1])
        at = m.end()
    made, rest = _parse(found)
    if rest:
        raise ValueError(f"unexpected {rest[0]!r}")
    return made


def _parse(found: list[str]) -> tuple[Part, list[str]]:
    if not found:
        raise ValueError("the pattern ends too early")
    head, rest = found[0], found[1:]
    if head == "...":
        return WILDCARD, rest
    if head.startswith("'"):
        return ("one", head[1:-1]), rest
    if head == "{":
        end = rest.index("}")
        return ("all", tuple(sorted(x[1:-1] for x in rest[:end] if x != ","))), rest[end + 1 :]
    if head in _OPS and rest[:1] == ["("]:
        rest, parts = rest[1:], []
        while True:
            part, rest = _parse(rest)
            parts.append(part)
            if rest[:1] == [","]:
                rest = rest[1:]
            elif rest[:1] == [")"]:
                return (_OPS[head], tuple(parts)), rest[1:]
            elif rest[:1] != ["..."]:  # a wildcard may stand without a comma before it
                raise ValueError("expected , or )")
    raise ValueError(f"unexpected {head!r}")


def _children(tree: V.Tree) -> list[V.Tree] | None:
    """Children that a pattern can match: those of parallels and choices, fall-throughs taken apart."""
    kind, parts = tree
    if kind == "leaf":
        return [V.leaf(x) for x in parts] if len(parts) > 1 else None
    if kind not in ("parallel", "choice", "fallthrough"):
        return None
    out: list[V.Tree] = []
    for c in parts:
        inner = _children(c) if c[0] in ("choice", "fallthrough") or c[0] == "leaf" and len(c[1]) > 1 else None
        out += inner if inner is not None else [c]
    return out


def match(source: Part, tree: V.Tree) -> dict[Part, list[V.Tree]] | None:
    """What each part of the source stands for at this node."""
    left = _children(tree)
    if left is None:
        return None
    out: dict[Part, list[V.Tree]] = {}
    for part in source[1]:
        if part == WILDCARD:
            continue
        wanted = (part[1],) if part[0] == "one" else part[1]
        found = [c for c in left if c[0] == "leaf" and len(c[1]) == 1 and c[1][0] in wanted]
        if not found:
            return None
        found = found[:1] if part[0] == "one" else found
        for c in found:
            left.remove(c)
        out[part] = found
    if WILDCARD in source[1]:
        out[WILDCARD] = left
    return None if left and WILDCARD not in out else out


def _has_sequence(tree: V.Tree) -> bool:
    return tree[0] == "follows" or tree[0] != "leaf" and any(map(_has_sequence, tree[1]))


def _wildcard_beside_sequence(target: Part) -> bool:
    if target[0] not in ("follows", "parallel", "choice"):
        return False
    if target[0] == "parallel" and WILDCARD in target[1] and any(p[0] == "follows" for p in target[1]):
        return True
    return any(map(_wildcard_beside_sequence, target[1]))


def _build(target: Part, found: dict[Part, list[V.Tree]]) -> V.Tree:
    if target == WILDCARD or target[0] in ("one", "all"):
        own = found[target]
        return own[0] if len(own) == 1 else ("parallel", tuple(own))
    return (target[0], tuple(_build(p, found) for p in target[1] if p != WILDCARD or found.get(WILDCARD)))


def flat(tree: V.Tree) -> V.Tree:
    """Without nodes of one child, and without a node below another of the same kind."""
    kind, parts = tree
    if kind == "leaf":
        return tree
    made: list[V.Tree] = []
    for c in map(flat, parts):
        made += c[1] if c[0] == kind and kind != "loop" else [c]
    return made[0] if len(made) == 1 and kind != "loop" else (kind, tuple(made))


def apply(tree: V.Tree, source: Part | str, target: Part | str) -> V.Tree:
    """The variant with the source rewritten to the target wherever it matches, from the top down. Where the
    result couldn't come from intervals (two sequences side by side), the node stays as it is."""
    source = parse(source) if isinstance(source, str) else source
    target = parse(target) if isinstance(target, str) else target
    if source[0] != "parallel":
        raise ValueError("a source is a parallel")
    guarded = _wildcard_beside_sequence(target)

    def run(t: V.Tree) -> V.Tree:
        if t[0] == "leaf" and len(t[1]) == 1:
            return t
        found = match(source, t)
        if found and not (guarded and any(_has_sequence(c) for own in found.values() for c in own)):
            return _build(target, {k: [run(c) for c in own] for k, own in found.items()})
        return t if t[0] == "leaf" else (t[0], tuple(run(c) for c in t[1]))

    return flat(run(tree))
