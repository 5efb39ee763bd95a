"""Process trees: block-structured models of sequences, choices, parallels and loops.

A tree is a tuple: ("act", label), ("tau",), or (kind, children) with kind "seq", "xor", "and" or "loop"; a
loop has two children, its body and what leads back to it. Nodes are addressed by their preorder number.
"""

from __future__ import annotations

from collections.abc import Iterator

Tree = tuple
TAU: Tree = ("tau",)
SIGNS = {"seq": "->", "xor": "X", "and": "+", "loop": "*"}
_KINDS = {"->": "seq", "→": "seq", "X": "xor", "✕": "xor", "×": "xor", "+": "and", "∧": "and", "*": "loop", "↺": "loop"}
_SILENT = ("tau", "τ")


def act(label: str) -> Tree:
    return ("act", label)


def op(kind: str, *children: Tree) -> Tree:
    return (kind, tuple(children))


def children(tree: Tree) -> tuple[Tree, ...]:
    return tree[1] if tree[0] in SIGNS else ()


def text(tree: Tree) -> str:
    """``->('a', X('b', tau))``."""
    if tree[0] == "act":
        return f"'{tree[1]}'"
    return "tau" if tree == TAU else f"{SIGNS[tree[0]]}({', '.join(map(text, tree[1]))})"


def parse(raw: str) -> Tree:
    tree, rest = _parse(raw.strip())
    if rest.strip():
        raise ValueError(f"unexpected {rest!r}")
    return tree


def _parse(s: str) -> tuple[Tree, str]:
    s = s.lstrip()
    if s.startswith("'"):
        end = s.index("'", 1)
        return act(s[1:end]), s[end + 1 :]
    for word in _SILENT:
        if s.startswith(word):
            return TAU, s[len(word) :]
    for sign, kind in _KINDS.items():
        if s.startswith(sign):
            rest = s[len(sign) :].lstrip()
            if not rest.startswith("("):
                raise ValueError(f"expected ( before {rest!r}")
            rest, made = rest[1:], []
            while True:
                child, rest = _parse(rest)
                made.append(child)
                rest = rest.lstrip()
                if rest[:1] == ",":
                    rest = rest[1:]
                elif rest[:1] == ")":
                    return (kind, tuple(made)), rest[1:]
                else:
                    raise ValueError(f"expected , or ) before {rest!r}")
    raise ValueError(f"not a tree: {s!r}")


def nodes(tree: Tree) -> list[Tree]:
    """All nodes in preorder; a node's place here is its number."""
    out = [tree]
    for c in children(tree):
        out += nodes(c)
    return out


def size(tree: Tree) -> int:
    return 1 + sum(map(size, children(tree)))


def height(tree: Tree) -> int:
    return 1 + max(map(height, children(tree)), default=0)


def labels(tree: Tree) -> list[str]:
    return [n[1] for n in nodes(tree) if n[0] == "act"]


def duplicate_labels(tree: Tree) -> set[str]:
    own = labels(tree)
    return {x for x in own if own.count(x) > 1}


def n_leaves(tree: Tree) -> int:
    return sum(not children(n) for n in nodes(tree))


def n_silent(tree: Tree) -> int:
    return sum(n == TAU for n in nodes(tree))


def accepts_nothing(tree: Tree) -> bool:
    """Whether the empty trace is in the language."""
    kind = tree[0]
    if kind in ("act", "tau"):
        return kind == "tau"
    inner = [accepts_nothing(c) for c in tree[1]]
    return any(inner) if kind == "xor" else inner[0] if kind == "loop" else all(inner)


def parents(tree: Tree) -> list[int]:
    """The parent's number of each node; -1 for the root."""
    out: list[int] = []

    def walk(t: Tree, up: int) -> None:
        me = len(out)
        out.append(up)
        for c in children(t):
            walk(c, me)

    walk(tree, -1)
    return out


def common_ancestor(tree: Tree, numbers: list[int]) -> int:
    """The lowest node above (or at) all the numbers."""
    up = parents(tree)

    def path(n: int) -> list[int]:
        out = [n]
        while up[n] >= 0:
            n = up[n]
            out.append(n)
        return out[::-1]

    paths = [path(n) for n in numbers]
    best = 0
    for level in zip(*paths, strict=False):
        if len(set(level)) > 1:
            break
        best = level[0]
    return best


def replaced(tree: Tree, number: int, new: Tree) -> Tree:
    """The tree with another subtree at a number."""
    if number == 0:
        return new
    at, made = 1, []
    for c in children(tree):
        n = size(c)
        made.append(replaced(c, number - at, new) if at <= number < at + n else c)
        at += n
    return (tree[0], tuple(made))


def reduced(tree: Tree, excluded: frozenset[Tree] = frozenset()) -> Tree:
    """The same language with fewer nodes: flat sequences, choices and parallels, no silent leaves where they
    do nothing, loops of exactly two children. Subtrees equal to one of ``excluded`` stay as they are."""
    if tree[0] in ("act", "tau") or tree in excluded:
        return tree
    kind = tree[0]
    made = [reduced(c, excluded) for c in tree[1]]
    if kind == "loop":
        body = made[0]
        back = made[1] if len(made) == 2 else reduced(("xor", tuple(made[1:])), excluded) if len(made) > 2 else TAU
        if body == TAU == back:
            return TAU
        if body[0] == "loop" and back == TAU and body[1][1] == TAU:
            return body
        if body == TAU and back[0] == "loop" and back[1][1] == TAU and back not in excluded:  # a silent body around a loop
            back = back[1][0]
        return ("loop", (body, back))
    flat: list[Tree] = []
    for c in made:
        flat += c[1] if c[0] == kind and c not in excluded else [c]
    if kind in ("seq", "and"):
        flat = [c for c in flat if c != TAU]
        if not flat:
            return TAU
    else:
        flat = list(dict.fromkeys(flat))
        if TAU in flat and any(c != TAU and accepts_nothing(c) for c in flat):
            flat.remove(TAU)
    return flat[0] if len(flat) == 1 else (kind, tuple(flat))


def canonical(tree: Tree) -> Tree:
    """Children of choices and parallels in order."""
    if not children(tree):
        return tree
    made = [canonical(c) for c in tree[1]]
    return (tree[0], tuple(sorted(made, key=text) if tree[0] in ("xor", "and") else made))


def with_borders(tree: Tree, start: str = "▶", end: str = "■") -> Tree:
    inner = tree[1] if tree[0] == "seq" else (tree,)
    return ("seq", (act(start), *inner, act(end)))


def without_borders(tree: Tree, start: str = "▶", end: str = "■") -> Tree:
    def run(t: Tree) -> Tree:
        if t in (act(start), act(end)):
            return TAU
        return (t[0], tuple(map(run, t[1]))) if children(t) else t

    return reduced(run(tree))


def language(tree: Tree, loops: int = 1) -> Iterator[tuple[str, ...]]:
    """Traces of the tree, loops run back at most ``loops`` times; for tests on small trees."""
    kind = tree[0]
    if kind == "act":
        yield (tree[1],)
    elif kind == "tau":
        yield ()
    elif kind == "xor":
        for c in tree[1]:
            yield from language(c, loops)
    elif kind == "loop":
        body, back = tree[1]
        todo = [tuple(x) for x in language(body, loops)]
        yield from todo
        for _ in range(loops):
            todo = [t + b + n for t in todo for b in language(back, loops) for n in language(body, loops)]
            yield from todo
    else:
        from chronoweft.plans.variant_tree import _shuffles

        done: list[tuple[str, ...]] = [()]
        for c in tree[1]:
            own = list(language(c, loops))
            done = [x + y for x in done for y in own] if kind == "seq" else [s for x in done for y in own for s in _shuffles(x, y)]
        yield from done
