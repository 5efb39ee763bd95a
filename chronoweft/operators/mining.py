"""Frequent patterns of variants: infixes (sub-trees whose sequences are contiguous), chains of infixes that
eventually follow one another, and the closed and maximal ones among them.

Mining goes level by level, one job a level: the frequent patterns so far travel with the tasks, each variant
gives the patterns of the next size that are made of those alone, each task adds them up, and one aggregation counts
them. Variants are read as JSON once; what variants share (children, and runs of them) is matched once a task. What a
pattern is made of (its children, and a sequence without its first or last child) is at least as frequent
as it is under every counting strategy, so nothing is enumerated before its parts have their support. More
frequent patterns than ``most_patterns``, which come to the driver, are an error rather than a silent cut.

An infix matches a node if its operator is the same and: under a sequence its children match adjacent
children; under a parallel or choice, any of them in order; and where a match goes on beyond a nested
sequence on the left or right, it has that sequence's first or last child.
"""

from __future__ import annotations

import json
import pickle
from collections import Counter
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import lru_cache
from itertools import combinations, product

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweft.plans import variant_tree as V

STRATEGIES = ("TraceTransaction", "TraceOccurrence", "VariantTransaction", "VariantOccurrence")
MOST_PATTERNS = 200_000
TASKS = 3
"""Tasks of a level for each that runs at once."""
HELD = 100_000
"""So many patterns a task remembers of what variants share, and so many it adds up before it passes them on."""
JOIN = "..."
Occurrence = tuple[tuple[int, ...], int, int]
"""Path to the root of a match (child numbers), and the first and last child of a matched run (-1: no run)."""


def n_nodes(tree: V.Tree) -> int:
    return 1 if tree[0] == "leaf" else 1 + sum(map(n_nodes, tree[1]))


def patterns_at(tree: V.Tree, size: int, labels: frozenset[str] | None = None, most: int = MOST_PATTERNS) -> set[V.Tree]:
    """The infixes of at most ``size`` nodes whose root matches the tree's root."""
    return set(Patterns(size, most=most).at(tree, False, False, labels))


class Patterns:
    """The infixes of up to ``size`` nodes of trees; with ``frequent``, those of them that have fewer nodes, and all
    parts of the others, must be among these."""

    def __init__(self, size: int, frequent: frozenset[V.Tree] | None = None, most: int = MOST_PATTERNS):
        self.size, self.frequent, self.most = size, frequent, most
        self.known: dict[tuple, frozenset[V.Tree]] = {}
        self.made: dict[tuple, tuple[frozenset[V.Tree], frozenset[V.Tree]]] = {}
        self.rooted: dict[V.Tree, frozenset[V.Tree]] = {}
        self.held = 0

    def of_size(self, tree: V.Tree) -> Counter:
        """Patterns of just ``size`` nodes, and the number of nodes of the tree at which each is rooted."""
        if self.held > HELD:
            self.known.clear()
            self.made.clear()
            self.rooted.clear()
            self.held = 0
        found: Counter = Counter()
        todo = [tree]
        while todo:
            t = todo.pop()
            if t[0] == "leaf":
                if self.size == 1:
                    found[t] += 1
                continue
            own = self.rooted.get(t)
            if own is None:
                own = self._union(1, t, False, False, None, self.size - 1)
                if t is not tree:
                    self.rooted[t] = own
                    self.held += len(own) + 1
            found.update(own)
            todo += t[1]
        return found

    def at(self, tree: V.Tree, from_first: bool, to_last: bool, labels: frozenset[str] | None, room: int | None = None) -> frozenset[V.Tree]:
        size = self.size if room is None else room
        key = (tree, size, from_first, to_last)
        if key not in self.known:
            self.known[key] = self._at(tree, size, from_first, to_last, labels)
            self.held += len(self.known[key]) + 1
        return self.known[key]

    def _frequent(self, p: V.Tree) -> bool:
        return self.frequent is None or p in self.frequent

    def _at(self, tree: V.Tree, size: int, from_first: bool, to_last: bool, labels: frozenset[str] | None) -> frozenset[V.Tree]:
        kind, parts = tree
        if size < 1:
            return frozenset()
        if kind == "leaf":
            return frozenset([tree] if (labels is None or set(parts) <= labels) and (self.size == 1 or self._frequent(tree)) else [])
        return self._union(0, tree, from_first, to_last, labels, size - 1)

    def _union(self, which: int, tree: V.Tree, from_first: bool, to_last: bool, labels: frozenset[str] | None, room: int) -> frozenset[V.Tree]:
        """Of all choices of children: patterns that fit (0), or those of them that have all ``size`` nodes (1)."""
        kind, parts = tree
        out: set[V.Tree] = set()
        n = len(parts)
        if kind in ("follows", "loop", "skip"):
            chosen = (parts[i:j] for i in range(1 if from_first else n) for j in range(i + 2, min(n, i + room) + 1) if not to_last or j == n)
        else:
            chosen = (c for k in range(2, min(n, room) + 1) for c in combinations(parts, k))
        for c in chosen:
            out |= self._made(kind, c, from_first, to_last, labels, room)[which]
            if len(out) > self.most:
                raise ValueError(f"a variant has more than {self.most} patterns")
        return frozenset(out)

    def _made(self, kind: str, chosen: tuple[V.Tree, ...], from_first: bool, to_last: bool, labels: frozenset[str] | None, room: int) -> tuple[frozenset[V.Tree], frozenset[V.Tree]]:
        """Patterns whose children match these, each one of them: those of up to ``room`` nodes below the root, and
        those of them that have all ``size`` nodes."""
        key = (kind, chosen, from_first, to_last, room)
        if key in self.made:
            return self.made[key]
        m, run = len(chosen), kind in ("follows", "loop", "skip")
        out: set[V.Tree] = set()
        full: set[V.Tree] = set()
        options = [self.at(c, from_first or run and k > 0, to_last or run and k < m - 1, labels, room - m + 1) for k, c in enumerate(chosen)]
        for made in product(*options) if all(options) else ():
            n = sum(map(n_nodes, made))
            if n > room or (n + 1 < self.size and not self._frequent((kind, made))):
                continue
            if n + 1 == self.size and len(made) > 2 and kind != "loop" and not all(self._frequent((kind, made[:k] + made[k + 1 :])) for k in (range(len(made)) if kind not in ("follows", "skip") else (0, len(made) - 1))):
                continue
            out.add((kind, made))
            if n + 1 == self.size:
                full.add((kind, made))
            if len(out) > self.most:
                raise ValueError(f"a variant has more than {self.most} patterns")
        self.made[key] = frozenset(out), frozenset(full)
        self.held += len(out) + 1
        return self.made[key]


def occurrences(tree: V.Tree, pattern: V.Tree) -> list[Occurrence]:
    """Where a pattern matches in a tree."""
    out: list[Occurrence] = []

    def match(t: V.Tree, p: V.Tree, from_first: bool, to_last: bool) -> Iterator[tuple[int, int]]:
        if t[0] != p[0]:
            return
        if t[0] == "leaf":
            if t == p:
                yield -1, -1
            return
        n, m = len(t[1]), len(p[1])
        if t[0] in ("follows", "loop", "skip"):
            for i in range(n - m + 1):
                if (from_first and i) or (to_last and i + m < n):
                    continue
                if all(any(match(t[1][i + k], p[1][k], k > 0 or from_first, k < m - 1 or to_last)) for k in range(m)):
                    yield i, i + m - 1
        else:
            @lru_cache(None)
            def rest(i: int, k: int) -> bool:
                if k == m:
                    return True
                return any(any(match(t[1][x], p[1][k], from_first, to_last)) and rest(x + 1, k + 1) for x in range(i, n))

            if rest(0, 0):
                yield -1, -1

    def walk(t: V.Tree, path: tuple[int, ...]) -> None:
        for i, j in match(t, pattern, False, False):
            out.append((path, i, j))
        if t[0] != "leaf":
            for k, c in enumerate(t[1]):
                walk(c, (*path, k))

    walk(tree, ())
    return out


def _kinds(tree: V.Tree, path: tuple[int, ...]) -> list[str]:
    out = [tree[0]]
    for k in path:
        tree = tree[1][k]
        out.append(tree[0])
    return out


def follows(tree: V.Tree, one: Occurrence, other: Occurrence, soft: bool = False) -> bool:
    """Whether a sequence has one match before the other, with something of its own between; ``soft``: or next
    to each other."""
    (p, _, end), (q, start, _) = one, other
    for depth, kind in enumerate(_kinds(tree, p if len(p) < len(q) else q)):
        if p[:depth] != q[:depth]:
            return False
        a = p[depth] if depth < len(p) else end
        b = q[depth] if depth < len(q) else start
        if kind == "follows" and a >= 0 and b >= 0 and a != b:
            return b - a >= (1 if soft else 2)
    return False


def _level(trees: DataFrame, strategy: str, least: int, counter: Callable[[], Callable[[V.Tree], dict]], most_patterns: int) -> dict:
    """What variants (of :func:`kept`) give to the function that ``counter`` makes for a task, with its support; only
    what has at least ``least``. Tasks have shares of what runs at once rather than a partition of some shuffle: they
    read variants one after another, and the larger the share, the more is added up and the less matched anew."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy}")
    by_case, by_root = strategy.startswith("Trace"), strategy.endswith("Occurrence")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter()
        sums: dict = {}

        def passed_on() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([encode(p) for p in sums], pa.string()), pa.array(sums.values(), pa.int64())], ["pattern", "n"])
            sums.clear()
            return out

        for b in batches:
            for raw, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                weight = n if by_case else 1
                for p, k in count(pickle.loads(raw)).items():
                    sums[p] = sums.get(p, 0) + (weight * k if by_root else weight)
                if len(sums) > HELD:
                    yield passed_on()
        if sums:
            yield passed_on()

    few = TASKS * trees.sparkSession.sparkContext.defaultParallelism
    counted = trees.select("tree", "n_cases").coalesce(few).mapInArrow(run, "pattern string, n long")
    rows = counted.groupBy("pattern").agg(F.sum("n").alias("support")).where(F.col("support") >= least).limit(most_patterns + 1).collect()
    if len(rows) > most_patterns:
        raise ValueError(f"more than {most_patterns} frequent patterns of one level")
    return {decode(r["pattern"]): r["support"] for r in rows}


Chain = tuple[V.Tree, ...]


def encode(pattern: V.Tree | Chain) -> str:
    """A pattern or a chain of them as JSON, which labels of any signs survive."""
    return V.to_json(pattern) if isinstance(pattern[0], str) else "[" + ",".join(map(V.to_json, pattern)) + "]"


def decode(raw: str) -> V.Tree | Chain:
    value = json.loads(raw)
    return tuple(map(V.from_json, value)) if isinstance(value, list) else V.from_json(value)


def chain_text(chain: Chain) -> str:
    return JOIN.join(map(V.text, chain))


_RESULT = "k int, pattern string, support long, pattern_json string"


def _found(trees: DataFrame, found: dict) -> DataFrame:
    rows = [(sum(map(n_nodes, c)), chain_text(c), n, encode(p)) for p, n in found.items() for c in [(p,) if isinstance(p[0], str) else p]]
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
    kinds = {"k": pa.int32(), "pattern": pa.string(), "support": pa.int64(), "pattern_json": pa.string()}
    return trees.sparkSession.createDataFrame(pa.table([pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)], list(kinds)), _RESULT)


@contextmanager
def kept(trees: DataFrame) -> Iterator[DataFrame]:
    """``trees`` (variant_json, n_cases) as tree (pickled, so that no level reads JSON) and n_cases, computed once
    for all levels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(V.canonical(V.from_json(raw)), 5) for raw in b.column(0).to_pylist()], pa.binary()), b.column(1)], ["tree", "n_cases"])

    own = trees.select("variant_json", F.col("n_cases").cast("long")).mapInArrow(run, "tree binary, n_cases long").persist()
    try:
        yield own
    finally:
        own.unpersist()


def frequent_trees(trees: DataFrame, strategy: str, least: int, size: int, most_patterns: int = MOST_PATTERNS) -> dict[V.Tree, int]:
    """The infixes of up to ``size`` nodes that have at least this support, with it."""
    with kept(trees) as own:
        return _frequent_trees(own, strategy, least, size, most_patterns)


def _frequent_trees(own: DataFrame, strategy: str, least: int, size: int, most_patterns: int) -> dict[V.Tree, int]:
    frequent: dict[V.Tree, int] = {}
    for k in (1, *range(3, size + 1)):
        if k > size or k > 1 and not frequent:
            break
        shipped = own.sparkSession.sparkContext.broadcast(frozenset(frequent) if k > 1 else None)
        frequent |= _level(own, strategy, least, lambda k=k, shipped=shipped: Patterns(k, shipped.value, most_patterns).of_size, most_patterns)
    return frequent


def frequent_patterns(trees: DataFrame, strategy: str = "TraceTransaction", least: int = 2, size: int = 6, strict: bool = False, most_patterns: int = MOST_PATTERNS) -> DataFrame:
    """k, pattern, support and pattern_json of the infixes of up to ``size`` nodes with a support of at least
    (``strict``: of more than) ``least``. ``trees``: variant_json and n_cases, a table that can be read again."""
    return _found(trees, frequent_trees(trees, strategy, least + 1 if strict else least, size, most_patterns))


def _alive(tree: V.Tree, chain: Chain, forward: list[list[Occurrence]]) -> int:
    """The least number of distinct roots that any part of a chain has in whole chains; ``forward``: for each
    part, where it ends a chain of the parts before it."""
    alive = forward[-1]
    roots = [len({x[0] for x in alive})]
    for k in range(len(chain) - 2, -1, -1):
        alive = [x for x in forward[k] if any(follows(tree, x, y) for y in alive)]
        roots.append(len({x[0] for x in alive}))
    return min(roots)


def chain_supports(tree: V.Tree, patterns: list[V.Tree], longest: int) -> dict[Chain, int]:
    """All chains of patterns that eventually follow one another in a tree, and the least number of distinct
    roots that any of their parts has in whole chains. It is what :func:`frequent_chains` counts, without levels."""
    places = {p: o for p in patterns if (o := occurrences(tree, p))}
    out: dict[Chain, int] = {(p,): len({x[0] for x in o}) for p, o in places.items()}
    level: dict[Chain, list[list[Occurrence]]] = {(p,): [o] for p, o in places.items()}
    for _ in range(longest - 1):
        level = {(*chain, p): [*forward, reached] for chain, forward in level.items() for p, o in places.items() if (reached := [y for y in o if any(follows(tree, x, y) for x in forward[-1])])}
        out |= {chain: _alive(tree, chain, forward) for chain, forward in level.items()}
    return out


class Chains:
    """The chains of one length that a tree has, of those that frequent shorter ones leave possible: without its
    first part and without its last, a chain is frequent; and in a chain of two, so is each label of the first
    part followed by each of the second."""

    def __init__(self, patterns: list[V.Tree], shorter: list[frozenset[Chain]], pairs: frozenset[tuple[str, str]] | None):
        self.patterns, self.shorter, self.pairs = patterns, shorter, pairs
        self.length = len(shorter) + 1

    def _possible(self, chain: Chain) -> bool:
        if len(chain) < self.length:
            return chain in self.shorter[len(chain) - 1]
        if len(chain) > 2:
            return chain[1:] in self.shorter[-1]
        return self.pairs is None or all((a, b) in self.pairs for a in V.labels(chain[0]) for b in V.labels(chain[1]))

    def of(self, tree: V.Tree) -> dict[Chain, int]:
        places = {p: o for p in self.patterns if (o := occurrences(tree, p))}
        level: dict[Chain, list[list[Occurrence]]] = {(p,): [o] for p, o in places.items()}
        for _ in range(self.length - 1):
            level = {
                (*chain, p): [*forward, reached]
                for chain, forward in level.items()
                for p, o in places.items()
                if self._possible((*chain, p)) and (reached := [y for y in o if any(follows(tree, x, y) for x in forward[-1])])
            }
        return {chain: _alive(tree, chain, forward) for chain, forward in level.items()}


def frequent_chains(trees: DataFrame, strategy: str = "TraceTransaction", least: int = 2, size: int = 4, longest: int = 3, most_patterns: int = 20_000) -> DataFrame:
    """k, pattern, support and pattern_json of chains ``p1...p2`` of up to ``longest`` infixes of up to ``size`` nodes.

    First the infixes; then pairs of labels, pairs of infixes whose labels make such pairs, and so on, each
    length in a job of its own over what the lengths before leave possible."""
    with kept(trees) as own:
        infixes = _frequent_trees(own, strategy, least, size, most_patterns)
        found: dict[Chain, int] = {(p,): n for p, n in infixes.items()}
        shorter = [frozenset(found)]
        pairs = None
        if longest > 1 and size > 1:
            leaves = [p for p in infixes if p[0] == "leaf"]
            of_labels = Chains(leaves, [frozenset((p,) for p in leaves)], None)
            pairs = frozenset((a, b) for x, y in _level(own, strategy, least, lambda: of_labels.of, most_patterns) for a in V.labels(x) for b in V.labels(y))
        for _ in range(longest - 1):
            shipped = trees.sparkSession.sparkContext.broadcast(Chains(list(infixes), list(shorter), pairs))
            new = _level(own, strategy, least, lambda shipped=shipped: shipped.value.of, most_patterns)
            if not new:
                break
            found |= new
            shorter.append(frozenset(new))
        return _found(trees, found)


def contains(larger: V.Tree, smaller: V.Tree) -> bool:
    return bool(occurrences(larger, smaller))


_GAP: V.Tree = ("leaf", ("\0",))


def contains_chain(larger: Chain, smaller: Chain) -> bool:
    """Whether a chain stands in another: matched in the sequence of the other's parts, with something between
    that nothing matches."""
    if len(larger) == len(smaller) == 1:
        return contains(larger[0], smaller[0])
    tree = larger[0] if len(larger) == 1 else ("follows", tuple(x for p in larger for x in (_GAP, p))[1:])
    reached = occurrences(tree, smaller[0])
    for p in smaller[1:]:
        reached = [y for y in occurrences(tree, p) if any(follows(tree, x, y) for x in reached)]
    return bool(reached)


def closed_and_maximal(patterns: DataFrame, most_patterns: int = 50_000) -> DataFrame:
    """``patterns`` (infixes or chains: k, support, pattern_json) with closed: no larger one with the same support
    contains it, and maximal: no larger one contains it.

    All patterns travel with the tasks, by the labels that they have; each pattern is only held against larger
    ones with its rarest label and no fewer of any."""
    rows = patterns.select("k", "support", "pattern_json").limit(most_patterns + 1).collect()
    if len(rows) > most_patterns:
        raise ValueError(f"more than {most_patterns} patterns")
    made = [(r["k"], r["support"], decode(r["pattern_json"])) for r in rows]
    chains = [(k, s, (p,) if isinstance(p[0], str) else p) for k, s, p in made]
    counts = [Counter(x for p in c for x in V.labels(p)) for _, _, c in chains]
    by_label: dict[str, list[int]] = {}
    for i, own in enumerate(counts):
        for x in own:
            by_label.setdefault(x, []).append(i)
    shipped = patterns.sparkSession.sparkContext.broadcast((chains, counts, by_label))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chains, counts, by_label = shipped.value
        for b in batches:
            out = []
            for k, s, raw in zip(*(b.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                p = decode(raw)
                own = (p,) if isinstance(p[0], str) else p
                labels = Counter(x for q in own for x in V.labels(q))
                near = min((by_label[x] for x in labels), key=len)
                above = [chains[i] for i in near if chains[i][0] > k and labels <= counts[i]]
                same = any(x[1] == s and contains_chain(x[2], own) for x in above)
                out.append((not same, not same and not any(x[1] != s and contains_chain(x[2], own) for x in above)))
            flags = list(zip(*out, strict=True)) if out else [[], []]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(flags[0], pa.bool_()), pa.array(flags[1], pa.bool_())], [*b.schema.names, "closed", "maximal"])

    return patterns.select("k", "pattern", "support", "pattern_json").mapInArrow(run, _RESULT + ", closed boolean, maximal boolean")


def confidences(patterns: DataFrame) -> DataFrame:
    """``patterns`` of chains with confidence: support as a share of the largest support of any of its parts,
    rounded to two places; null for patterns of one part."""
    parts = patterns.where(F.json_array_length("pattern_json") > 1)
    parts = parts.select("pattern_json", F.explode(F.from_json("pattern_json", "array<string>")).alias("part")).withColumn("part", F.concat(F.lit("["), "part", F.lit("]")))
    alone = patterns.select(F.col("pattern_json").alias("part"), F.col("support").alias("part_support"))
    best = parts.join(alone, "part").groupBy("pattern_json").agg(F.max("part_support").alias("best"))
    return patterns.join(best, "pattern_json", "left").withColumn("confidence", F.round(F.col("support") / F.col("best"), 2)).drop("best")


def repetitions(tree: V.Tree, size: int = 20) -> list[tuple[str, tuple[int, ...], tuple[int, ...]]]:
    """Maximal pairs of consecutive occurrences, not overlapping, of one pattern in a variant: its text and the
    paths to both."""
    tree = V.canonical(tree)
    found: set[V.Tree] = set()
    patterns = Patterns(size)

    def walk(t: V.Tree) -> None:
        found.update(patterns.at(t, False, False, None))
        if t[0] != "leaf":
            for c in t[1]:
                walk(c)

    walk(tree)
    pairs = []
    for p in found:
        own = sorted(occurrences(tree, p))
        for a, b in zip(own, own[1:], strict=False):
            apart = a[0][: len(b[0])] != b[0] and b[0][: len(a[0])] != a[0] or a[0] == b[0] and a[2] < b[1]
            if apart:
                pairs.append((p, a, b))
    kept = []
    for p, a, b in pairs:
        inside = any(q != p and contains(q, p) and _covers(x, a) and _covers(y, b) for q, x, y in pairs)
        if not inside:
            kept.append((V.text(p), a[0] if a[1] < 0 else (*a[0], a[1]), b[0] if b[1] < 0 else (*b[0], b[1])))
    return sorted(kept)


def _covers(outer: Occurrence, inner: Occurrence) -> bool:
    path, i, j = outer
    if inner[0][: len(path)] != path:
        return False
    if i < 0:
        return True
    at = inner[0][len(path) :]
    return i <= at[0] <= j if at else i <= inner[1] and inner[2] <= j


def matched_nodes(tree: V.Tree, pattern: V.Tree) -> list[set[int]]:
    """For each match of a pattern, depth-first numbers of the nodes that it matches (the first way in which
    it does)."""
    number = {p: i for i, p in enumerate(V.paths(tree))}
    out = []

    def pick(t: V.Tree, p: V.Tree, path: tuple[int, ...], start: int) -> set[int]:
        own = {number[path]}
        if t[0] == "leaf":
            return own
        if start >= 0:
            for k, c in enumerate(p[1]):
                inner = [o for o in occurrences(t[1][start + k], c) if o[0] == ()]
                own |= pick(t[1][start + k], c, (*path, start + k), inner[0][1] if inner else -1)
            return own
        k = 0
        for c in p[1]:
            while not (inner := [o for o in occurrences(t[1][k], c) if o[0] == ()]):
                k += 1
            own |= pick(t[1][k], c, (*path, k), inner[0][1])
            k += 1
        return own

    for path, start, _ in occurrences(tree, pattern):
        t = tree
        for k in path:
            t = t[1][k]
        out.append(pick(t, pattern, path, start))
    return out


def growth_confidences(patterns: DataFrame) -> DataFrame:
    """``patterns`` (k, pattern, support, pattern_json) of infixes with parent_json (the pattern without its last
    child, if that is one activity and what is left is one of them) and confidence: support as a share of the
    parent's, to two places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = []
            for raw in b.column(0).to_pylist():
                kind, parts = V.from_json(raw)
                cut = kind != "leaf" and len(parts) > 2 and parts[-1][0] == "leaf"
                made.append(V.to_json((kind, parts[:-1])) if cut else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.string())], ["pattern_json", "maybe"])

    parents = patterns.select("pattern_json").mapInArrow(run, "pattern_json string, maybe string")
    known = patterns.select(F.col("pattern_json").alias("parent_json"), F.col("support").alias("parent_support"))
    joined = patterns.join(parents, "pattern_json").join(known, F.col("maybe") == F.col("parent_json"), "left")
    return joined.select("k", "pattern", "support", "pattern_json", "parent_json", F.round(F.col("support") / F.col("parent_support"), 2).alias("confidence"))
