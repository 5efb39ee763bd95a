"""Optimal alignments of traces, and of prefixes, infixes and suffixes of traces, with a process tree.

One best-first search serves all four: it begins in the initial marking, or for infixes and suffixes in any
reachable one, and ends when the trace is used up, for whole traces and suffixes in the final marking. A
trace fits if its cost is below that of one deviation.

On tables the search runs once for each distinct sequence, on the executors; the model is small and travels
with the tasks.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoweft.operators.projection import sequences
from chronoweft.plans import process_tree as P
from chronoweft.plans.petri_net import Net, net_of

DEVIATION = 10_000
SILENT = 1
MODES = ("full", "prefix", "infix", "suffix")
MOST_MARKINGS = 20_000
MOST_STATES = 500_000
SYNC, LOG, MODEL, TAU = "sync", "log", "model", "tau"


@dataclass(frozen=True)
class Move:
    kind: str
    activity: str | None
    node: int
    phase: str


@dataclass(frozen=True)
class Alignment:
    cost: int
    moves: tuple[Move, ...]
    visited: int
    fitness: float
    bwc: int
    start: frozenset = frozenset()
    end: frozenset = frozenset()

    @property
    def fits(self) -> bool:
        return self.cost < DEVIATION

    def first_deviation(self) -> int | None:
        return next((i for i, m in enumerate(self.moves) if m.kind in (LOG, MODEL)), None)


class Aligner:
    """Aligns traces with one tree."""

    def __init__(self, tree: P.Tree, mode: str = "full", most_states: int = MOST_STATES, most_markings: int = MOST_MARKINGS, log_cost: int = DEVIATION, model_cost: int = DEVIATION):
        if mode not in MODES:
            raise ValueError(f"unknown mode {mode}")
        self.tree = tree
        self.net: Net = net_of(tree)
        self.mode, self.most_states = mode, most_states
        self.log_cost, self.model_cost = log_cost, model_cost
        self.labels = set(P.labels(tree))
        self.starts = [self.net.initial] if mode in ("full", "prefix") else self.net.reachable(most_markings)
        self.ends_anywhere = mode in ("prefix", "infix")
        self._least_empty: int | None = None

    def align(self, trace: list[str] | tuple[str, ...]) -> Alignment | None:
        """The best alignment; None if the search would look at more states than allowed."""
        n = len(trace)
        # what remains of the trace needs a deviation for each label that the model doesn't have
        rest = [0] * (n + 1)
        for i in range(n - 1, -1, -1):
            rest[i] = rest[i + 1] + (self.log_cost if trace[i] not in self.labels else 0)
        queue: list[tuple] = []
        best: dict[tuple, int] = {}
        back: dict[tuple, tuple] = {}
        for order, m in enumerate(self.starts):
            best[0, m] = 0
            heapq.heappush(queue, (rest[0], 0, order, 0, 0, m))
        pushed, visited, closed = len(queue), 0, set()
        while queue:
            _, _, _, cost, i, m = heapq.heappop(queue)
            state = (i, m)
            if state in closed or cost > best[state]:
                continue
            closed.add(state)
            visited += 1
            if i == n and (self.ends_anywhere or m == self.net.final):
                return self._made(trace, cost, state, back, visited)
            if visited > self.most_states:
                return None
            steps = []
            for t in self.net.enabled(m):
                to = (m - t.pre) | t.post
                if t.label is None:
                    steps.append((SILENT, (i, to), Move(TAU, None, t.node, t.phase)))
                    continue
                if i < n and t.label == trace[i]:
                    steps.append((0, (i + 1, to), Move(SYNC, t.label, t.node, t.phase)))
                steps.append((self.model_cost, (i, to), Move(MODEL, t.label, t.node, t.phase)))
            if i < n:
                steps.append((self.log_cost, (i + 1, m), Move(LOG, trace[i], -1, "")))
            for extra, new, move in steps:
                total = cost + extra
                if new not in closed and total < best.get(new, total + 1):
                    best[new] = total
                    back[new] = (state, move)
                    pushed += 1
                    heapq.heappush(queue, (total + rest[new[0]], -new[0], pushed, total, *new))
        return None

    def _made(self, trace, cost: int, state: tuple, back: dict, visited: int) -> Alignment:
        moves, end = [], state[1]
        while state in back:
            state, move = back[state]
            moves.append(move)
        empty = 0 if self.mode != "full" or not trace else self._empty_cost()
        bwc = len(trace) * DEVIATION + empty
        deviations = cost // DEVIATION
        whole = bwc // DEVIATION
        return Alignment(cost, tuple(moves[::-1]), visited, 1 - deviations / whole if whole else float(not deviations), bwc, state[1], end)

    def _empty_cost(self) -> int:
        if self._least_empty is None:
            self._least_empty = 0
            found = self.align(())
            self._least_empty = found.cost // DEVIATION * DEVIATION if found else 0
        return self._least_empty


class InfixAligner:
    """Aligns infixes each with the part of the tree that it can lie in: the lowest node above all leaves with its
    labels, or the highest loop around that. Searches then begin in the markings of that part alone."""

    def __init__(self, tree: P.Tree, most_states: int = MOST_STATES, most_markings: int = MOST_MARKINGS):
        self.tree, self.how = tree, (most_states, most_markings)
        self.nodes, self.up = P.nodes(tree), P.parents(tree)
        self.by_label: dict[str, list[int]] = {}
        for n, t in enumerate(self.nodes):
            if t[0] == "act":
                self.by_label.setdefault(t[1], []).append(n)
        self.parts: dict[int, Aligner] = {}

    def scope(self, labels: set[str]) -> int:
        """The number of the node that an infix with these labels can lie in."""
        leaves = [n for x in labels for n in self.by_label.get(x, ())]
        if not leaves:
            return max(range(len(self.nodes)), key=lambda n: (not P.children(self.nodes[n]), -n))  # no move is synchronous
        number = at = P.common_ancestor(self.tree, leaves)
        while at >= 0:
            number = at if self.nodes[at][0] == "loop" else number
            at = self.up[at]
        return number

    def align(self, trace: list[str] | tuple[str, ...]) -> Alignment | None:
        number = self.scope(set(trace))
        if number not in self.parts:
            self.parts[number] = Aligner(self.nodes[number], "infix", *self.how)
        found = self.parts[number].align(trace)
        if found is None or number == 0:
            return found
        return replace(found, moves=tuple(replace(m, node=m.node + number) if m.node >= 0 else m for m in found.moves))


def shortest_run(net: Net, start: frozenset, end: frozenset) -> tuple[str, ...] | None:
    """The labels of a shortest run from one marking to another."""
    queue: list[tuple] = [(0, 0, start, ())]
    seen, pushed = set(), 0
    while queue:
        cost, _, m, done = heapq.heappop(queue)
        if m == end:
            return done
        if m in seen:
            continue
        seen.add(m)
        for t in net.enabled(m):
            pushed += 1
            heapq.heappush(queue, (cost + (SILENT if t.label is None else DEVIATION), pushed, (m - t.pre) | t.post, done if t.label is None else (*done, t.label)))
    return None


def completed(aligner: Aligner, fragment: tuple[str, ...]) -> tuple[str, ...] | None:
    """A whole trace of the model around a fragment: its best alignment with shortest runs before and after."""
    found = aligner.align(fragment)
    if found is None:
        return None
    before, after = shortest_run(aligner.net, aligner.net.initial, found.start), shortest_run(aligner.net, found.end, aligner.net.final)
    if before is None or after is None:
        return None
    return (*before, *(m.activity for m in found.moves if m.kind in (SYNC, MODEL)), *after)


# Tags of trace fragments, and the mode that each is aligned in.
FRAGMENT_MODES = {"NOT_AN_INFIX": "full", "PREFIX": "prefix", "PROPER_INFIX": "infix", "POSTFIX": "suffix"}

MOVE = "struct<kind: string, activity: string, node: int, phase: string>"
COLUMNS = f"cost long, fitness double, bwc long, visited long, moves array<{MOVE}>"
_KINDS = [pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("kind", pa.string()), ("activity", pa.string()), ("node", pa.int32()), ("phase", pa.string())]))]


def align_sequences(rows: DataFrame, tree: P.Tree, mode: str = "full", most_states: int = MOST_STATES) -> DataFrame:
    """``rows`` (acts: array of labels, and others) with cost, fitness, bwc, visited and moves. Cost is null
    where the search was given up."""
    types = [f"{n} {k}" for n, k in rows.dtypes]
    names = [*rows.columns, *(c.split()[0] for c in ("cost", "fitness", "bwc", "visited", "moves"))]
    at = rows.columns.index("acts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = InfixAligner(tree, most_states) if mode == "infix" else Aligner(tree, mode, most_states)
        known: dict[tuple, Alignment | None] = {}
        for b in batches:
            out = []
            for acts in b.column(at).to_pylist():
                key = tuple(acts)
                if key not in known:
                    if len(known) > 50_000:
                        known.clear()
                    known[key] = aligner.align(key)
                a = known[key]
                out.append((None,) * 5 if a is None else (a.cost, a.fitness, a.bwc, a.visited, [m.__dict__ for m in a.moves]))
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c, k) for c, k in zip(columns, _KINDS, strict=True))], names)

    return rows.mapInArrow(run, ", ".join([*types, COLUMNS]))


def align_typed(rows: DataFrame, tree: P.Tree, most_states: int = MOST_STATES) -> DataFrame:
    """As :func:`align_sequences`, each row in the mode of its ``infix_type``."""
    out = None
    for tag, mode in FRAGMENT_MODES.items():
        part = align_sequences(rows.where(F.col("infix_type") == tag), tree, mode, most_states)
        out = part if out is None else out.unionByName(part)
    return out


def align_log(log: DataFrame, tree: P.Tree, mode: str = "full", most_states: int = MOST_STATES) -> DataFrame:
    """acts, n_cases and the alignment of each distinct sequence of a log."""
    counted = sequences(log).groupBy("acts").agg(F.count("*").alias("n_cases"))
    return align_sequences(counted, tree, mode, most_states)


def distinct_alignments(aligned: DataFrame) -> DataFrame:
    """visible (the moves that aren't silent), n_cases and n_sequences: alignments that differ in silent moves alone
    are one."""
    visible = F.filter("moves", lambda m: m["kind"] != TAU)
    return aligned.where("cost IS NOT NULL").groupBy(visible.alias("visible")).agg(F.sum("n_cases").alias("n_cases"), F.count("*").alias("n_sequences"))


def fits(cost: str = "cost"):
    return F.col(cost) < DEVIATION


def node_counts(aligned: DataFrame) -> DataFrame:
    """node, kind, n: how often each move happens, weighted by n_cases."""
    m = aligned.select("n_cases", F.explode("moves").alias("m"))
    return m.groupBy("m.node", "m.kind").agg(F.sum("n_cases").alias("n"))


def deviation_costs(aligned: DataFrame) -> DataFrame:
    """activity, kind, n and cost: log and model moves by label, and what such a move costs where frequent ones
    are to be cheap, the number of the most frequent one's as a share of this one's and one more."""
    m = aligned.select("n_cases", F.explode("moves").alias("m")).where(F.col("m.kind").isin(LOG, MODEL))
    counted = m.groupBy("m.activity", "m.kind").agg(F.sum("n_cases").alias("n"))
    most = F.max("n").over(Window.partitionBy(F.lit(1)))  # a row a label and kind
    return counted.select("activity", "kind", "n", (most / (F.col("n") + 1)).alias("cost"))


def moves_of_kind(*kinds: str, moves: str = "moves") -> Column:
    """The moves of these kinds, of a column of moves."""
    return F.filter(moves, lambda m: m["kind"].isin(*kinds))


def first_deviation(moves: str = "moves") -> Column:
    """The place, from 1, of the first move of the log or the model alone; 0 without any."""
    return F.array_position(F.transform(moves, lambda m: m["kind"].isin(LOG, MODEL)), F.lit(True)).cast("int")


def runs_of_node(alignment: Alignment, tree: P.Tree, number: int) -> list[tuple[str, ...]]:
    """The activities that a trace does in each run of a node, deviations from the model left out."""
    inside = set(range(number, number + P.size(P.nodes(tree)[number])))
    leaf = not P.children(P.nodes(tree)[number])
    out, now = [], None
    for m in alignment.moves:
        if m.node == number and m.phase == "active":
            now = []
        if m.node in inside and m.kind == SYNC:
            if leaf:
                out.append((m.activity,))
            elif now is not None:
                now.append(m.activity)
        elif leaf and m.node == number and m.kind == TAU:
            out.append(())
        if m.node == number and m.phase == "closed" and now is not None:
            out.append(tuple(now))
            now = None
    return out


def precision(aligned: DataFrame, tree: P.Tree) -> float:
    """Escaping-edges precision over the prefixes of fitting sequences: what the log does next, as a share of
    what the model allows next. The distinct prefixes are counted in the cluster."""
    rows = aligned.where(fits()).select("acts", "n_cases")
    prefixes = rows.select(F.explode(F.sequence(F.lit(0), F.size("acts"))).alias("k"), "acts", "n_cases")
    seen = prefixes.select(F.slice("acts", 1, F.col("k")).alias("acts"), F.get("acts", F.col("k")).alias("next"), "n_cases")
    states = seen.groupBy("acts").agg(F.collect_set("next").alias("done"), F.sum("n_cases").alias("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = net_of(tree)
        for b in batches:
            allowed = [len(_next_labels(net, acts)) for acts in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(allowed, pa.int64()), pa.array([len(x) for x in b.column(1).to_pylist()], pa.int64()), b.column(2)], ["allowed", "done", "n"])

    got = states.mapInArrow(run, "allowed long, done long, n long").agg(F.sum(F.col("allowed") * F.col("n")).alias("a"), F.sum(F.least("done", "allowed") * F.col("n")).alias("d")).first()
    return got["d"] / got["a"] if got["a"] else 1.0


def _next_labels(net: Net, acts: list[str]) -> set[str]:
    """Labels that some run of the net allows after these."""
    now = _silent_closure(net, {net.initial})
    for a in acts:
        now = _silent_closure(net, {(m - t.pre) | t.post for m in now for t in net.enabled(m) if t.label == a})
    return {t.label for m in now for t in net.enabled(m) if t.label is not None}


def _silent_closure(net: Net, markings: set) -> set:
    todo, out = list(markings), set(markings)
    while todo:
        m = todo.pop()
        for t in net.enabled(m):
            if t.label is None:
                new = (m - t.pre) | t.post
                if new not in out:
                    out.add(new)
                    todo.append(new)
    return out


def given_up(aligned: DataFrame) -> int:
    """How many cases have no alignment because the search for it was given up."""
    return aligned.where("cost IS NULL").agg(F.sum("n_cases").alias("n")).first()["n"] or 0


def mean_fitness(aligned: DataFrame) -> float:
    """Fitness over cases; cases whose alignment was given up raise an error rather than count as anything."""
    if lost := given_up(aligned):
        raise ValueError(f"the alignments of {lost} cases were given up; allow more states")
    return aligned.agg((F.sum(F.col("fitness") * F.col("n_cases")) / F.sum("n_cases")).alias("f")).first()["f"] or 0.0


def f_measure(log: DataFrame, tree: P.Tree, most_states: int = MOST_STATES) -> float:
    """The harmonic mean of fitness (over cases) and precision."""
    aligned = align_log(log, tree, most_states=most_states)
    fit = mean_fitness(aligned)
    p = precision(aligned, tree)
    return 2 * fit * p / (fit + p) if fit + p else 0.0



def f_measure_of(counts: dict[tuple[str, ...], int], tree: P.Tree, most_states: int = MOST_STATES) -> float:
    """:func:`f_measure` of counted sequences that are at hand, as within a task."""
    aligner, total = Aligner(tree, most_states=most_states), sum(counts.values())
    fit, done, n_states = 0.0, {}, {}
    for acts, n in counts.items():
        found = aligner.align(acts)
        if found is None:
            raise ValueError("an alignment was given up; allow more states")
        fit += found.fitness * n
        for k in range(len(acts) + 1) if found.fits else ():
            done.setdefault(acts[:k], set()).update(acts[k : k + 1])
            n_states[acts[:k]] = n_states.get(acts[:k], 0) + n
    allowed = {p: len(_next_labels(aligner.net, p)) for p in done}
    a = sum(allowed[p] * n_states[p] for p in done)
    d = sum(min(len(done[p]), allowed[p]) * n_states[p] for p in done)
    fit, exact = fit / total if total else 0.0, d / a if a else 1.0
    return 2 * fit * exact / (fit + exact) if fit + exact else 0.0
