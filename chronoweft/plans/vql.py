"""A query language on cases: activities contained, at the start or end, directly or eventually followed, or
parallel. A query is parsed on the driver and becomes one boolean Column over numbers of instances, which
:func:`query_cases` counts for it alone, or :func:`case_graphs` keeps for any query.

    query    := expr ';'
    expr     := negated (AND negated)* | negated (OR negated)* | negated '->' negated
    negated  := NOT '(' expr ')' | '(' expr of several leaves ')' | leaf
    leaf     := group unary [op n] | group binary group [op n]
    group    := 'activity' | [~] (ANY | ALL) '{' 'a', 'b' '}'   (a group on one side only)

A mix of AND and OR needs parentheses.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEPARATOR = "\u0001"


class LexerError(ValueError):
    def __init__(self, text: str, column: int):
        super().__init__(f"unexpected character at column {column}: {text[column : column + 10]!r}")
        self.column = column


class ParseError(ValueError):
    def __init__(self, message: str, column: int):
        super().__init__(f"{message} at column {column}")
        self.column = column


@dataclass(frozen=True)
class Group:
    """Activities on one side of a relation; ``every``: ALL, else ANY; ``outside``: all but these."""

    names: tuple[str, ...]
    every: bool = False
    outside: bool = False

    def members(self, universe: frozenset[str] | None) -> tuple[str, ...]:
        if not self.outside:
            return self.names
        if universe is None:
            raise ValueError("a ~ group needs the activities of the log")
        return tuple(sorted(universe - set(self.names)))


@dataclass(frozen=True)
class Leaf:
    """A predicate; ``right`` is None for unary ones; ``op`` and ``n`` count occurrences."""

    relation: str
    left: Group
    right: Group | None = None
    op: str | None = None
    n: int = 0


@dataclass(frozen=True)
class Node:
    """AND, OR, NOT."""

    kind: str
    parts: tuple


# The language's words.
KEYWORDS = {
    "isEF": "ef", "isEventuallyFollowed": "ef", "isDF": "df", "isDirectlyFollowed": "df", "isP": "par",
    "isParallel": "par", "isS": "starts", "isStart": "starts", "isE": "ends", "isEnd": "ends", "isC": "acts",
    "isContained": "acts", "ANY": "ANY", "ALL": "ALL", "AND": "AND", "OR": "OR", "NOT": "NOT",
}
UNARY, BINARY = ("acts", "starts", "ends"), ("df", "ef", "par")
_TOKEN = re.compile(r"\s+|(?P<name>'[^']*')|(?P<word>[A-Za-z]+)|(?P<number>\d+)|(?P<sign>->|[{}(),~=<>;])")


def tokens(text: str) -> list[tuple[str, str, int]]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m or m.lastgroup == "word" and m[0] not in KEYWORDS or m.lastgroup == "name" and len(m[0]) < 3:
            raise LexerError(text, at)
        if m.lastgroup:
            kind = {"name": "name", "number": "number", "word": KEYWORDS.get(m[0], ""), "sign": m[0]}[m.lastgroup]
            out.append((kind, m[0], at))
        at = m.end()
    return [*out, ("end", "", len(text))]


class _Parser:
    def __init__(self, text: str):
        self.tokens = tokens(text)
        self.at = 0

    @property
    def kind(self) -> str:
        return self.tokens[self.at][0]

    def take(self, *kinds: str) -> str:
        kind, text, column = self.tokens[self.at]
        if kind not in kinds:
            raise ParseError(f"expected {' or '.join(kinds)}, found {text or 'the end'}", column)
        self.at += 1
        return text

    def query(self):
        out = self.expression()
        self.take(";")
        return out

    def expression(self):
        parts = [self.negated()]
        if self.kind == "->":
            self.take("->")
            return Node("OR", (Node("NOT", (parts[0],)), self.negated()))
        word = self.kind if self.kind in ("AND", "OR") else None
        while word and self.kind == word:
            self.take(word)
            parts.append(self.negated())
        return Node(word, tuple(parts)) if word else parts[0]

    def negated(self):
        negative = self.kind == "NOT"
        if negative:
            self.take("NOT")
        if not negative and self.kind != "(":
            return self.leaf()
        self.take("(")
        column = self.tokens[self.at][2]
        out = self.expression()
        self.take(")")
        if not negative and isinstance(out, Leaf):
            raise ParseError("a lone predicate in parentheses", column)
        return Node("NOT", (out,)) if negative else out

    def group(self) -> tuple[Group, bool]:
        if self.kind == "name":
            return Group((self.take("name")[1:-1],)), False
        outside = self.kind == "~"
        if outside:
            self.take("~")
        every = self.take("ANY", "ALL") == "ALL"
        self.take("{")
        names = [self.take("name")[1:-1]]
        while self.kind == ",":
            self.take(",")
            names.append(self.take("name")[1:-1])
        self.take("}")
        return Group(tuple(dict.fromkeys(names)), every, outside), True

    def leaf(self) -> Leaf:
        left, grouped = self.group()
        relation, column = self.kind, self.tokens[self.at][2]
        self.take(*UNARY, *BINARY)
        right = None
        if relation in BINARY:
            right, both = self.group()
            if grouped and both:
                raise ParseError("groups on both sides", column)
        if self.kind in ("=", "<", ">"):
            op = self.take("=", "<", ">")
            return Leaf(relation, left, right, op, int(self.take("number")))
        return Leaf(relation, left, right)


def parse(text: str):
    """The tree of the first query of a script, all of which must be well formed."""
    parser = _Parser(text)
    out = [parser.query()]
    while parser.kind != "end":
        out.append(parser.query())
    return out[0]


def needs_universe(tree) -> bool:
    if isinstance(tree, Node):
        return any(map(needs_universe, tree.parts))
    return tree.left.outside or tree.right is not None and tree.right.outside


def _any(parts: list[Column]) -> Column:
    return reduce(lambda x, y: x | y, parts) if parts else F.lit(False)


def _all(parts: list[Column]) -> Column:
    return reduce(lambda x, y: x & y, parts) if parts else F.lit(True)


def _compare(count: Column, op: str, n: int) -> Column:
    return {"=": count == n, "<": count < n, ">": count > n}[op]


Count = Callable[[str, tuple[str, ...], tuple[str, ...], bool], Column]
"""(relation, (a,), (b, ...), every): a case's number of ``a`` that are in the relation, for a binary one to some
instance of any, or of every, ``b``."""


def compile_with(tree, count: Count, universe: frozenset[str] | None = None) -> Column:
    """A boolean Column from the numbers of instances that ``count`` gives."""
    if isinstance(tree, Node):
        parts = [compile_with(p, count, universe) for p in tree.parts]
        return ~parts[0] if tree.kind == "NOT" else _all(parts) if tree.kind == "AND" else _any(parts)
    left = tree.left.members(universe)
    if tree.right is None:
        found = [count(tree.relation, (a,), (), False) for a in left]
        tests = [_compare(x, tree.op, tree.n) if tree.op else x > 0 for x in found]
        return _all(tests) if tree.left.every else _any(tests)
    right = tree.right.members(universe)
    every = tree.left.every or tree.right.every
    own = lambda a: count("acts", (a,), (), False)
    met = lambda a, *b, all_=False: count(tree.relation, (a,), b, all_)
    if tree.op:
        if len(right) > 1:  # how often the left activity meets any, or all, of the group
            return _all([_compare(met(a, *right, all_=tree.right.every), tree.op, tree.n) for a in left])
        tests = [_compare(met(a, b), tree.op, tree.n) for a in left for b in right]
        return _all(tests) if every else _any(tests)
    if not every and len(right) > 1:  # each instance on the left meets one of the group
        return _any([(own(a) > 0) & (met(a, *right) == own(a)) for a in left])
    tests = [(own(a) > 0) & (own(b) > 0) & (met(a, b) == own(a)) for a in left for b in right]
    return _all(tests) if every else _any(tests)


def compile_query(tree, universe: frozenset[str] | None = None) -> Column:
    """A boolean Column over the columns of ``case_graphs``."""

    def count(relation: str, a: tuple[str, ...], b: tuple[str, ...], every: bool) -> Column:
        places = lambda key: F.coalesce(F.try_element_at(F.col(relation), F.lit(key)), F.array().cast("array<int>"))
        if not b:
            return F.size(places(a[0]))
        return F.size(reduce(F.array_intersect if every else F.array_union, [places(f"{a[0]}{SEPARATOR}{x}") for x in b]))

    return compile_with(tree, count, universe)


MOST_ACTIVITIES = 10_000


def universe_of(log: DataFrame) -> frozenset[str]:
    """The activities of a log, of which there may be at most MOST_ACTIVITIES."""
    rows = log.select("activity").distinct().limit(MOST_ACTIVITIES + 1).collect()
    if len(rows) > MOST_ACTIVITIES:
        raise ValueError("too many activities for a ~ group")
    return frozenset(r["activity"] for r in rows)


def matching(graphs: DataFrame, query: str, universe: frozenset[str] | None = None) -> DataFrame:
    """The rows of ``graphs`` (one a case or variant) that satisfy a query."""
    return graphs.where(compile_query(parse(query), universe))


def query_cases(log: DataFrame, query: str, granularity: str = "ms") -> DataFrame:
    """case_id of the cases that satisfy a query.

    A query is one aggregation by case over the log's instances: of the relations and labels that it names, and
    no others, each instance gets a mark, and the marks are counted. So a query on contained activities has
    neither a window nor a join, and no query makes pairs of instances."""
    from chronoweft.operators.relations import borders, follows_some

    tree = parse(query)
    universe = universe_of(log) if needs_universe(tree) else None
    counts: dict[tuple, str] = {}

    def count(relation: str, a: tuple[str, ...], b: tuple[str, ...], every: bool) -> Column:
        return F.col(counts.setdefault((relation, a[0], tuple(sorted(b)), every and len(b) > 1), f"c{len(counts)}"))

    test = compile_with(tree, count, universe)
    wanted: dict[str, set[str]] = {}
    for relation, _, b, _ in counts:
        if b:
            wanted.setdefault(relation, set()).update(b)
    rows = follows_some(log, wanted, granularity) if wanted else log.select("case_id", "pos", "activity")
    if any(relation in ("starts", "ends") for relation, *_ in counts):
        marks = borders(log, granularity).select("case_id", "pos", "is_start", "is_end")
        rows = rows.join(marks, ["case_id", "pos"]) if wanted else borders(log, granularity)
    number = {x: i for i, x in enumerate(sorted(set().union(*wanted.values())))} if wanted else {}

    def marked(relation: str, a: str, b: tuple[str, ...], every: bool) -> Column:
        own = F.col("activity") == a
        if relation in ("starts", "ends"):
            return own & F.col({"starts": "is_start", "ends": "is_end"}[relation])
        return own & (_all if every else _any)([F.col(f"`{relation}:{number[x]}`") for x in b]) if b else own

    sums = [F.sum(F.when(marked(*key), 1).otherwise(0)).alias(name) for key, name in counts.items()]
    grouped = rows.groupBy("case_id").agg(*sums) if sums else rows.select("case_id").distinct()
    return grouped.where(test).select("case_id")
