"""Service, idle, waiting and cycle intervals of the nodes of a process tree, from aligned cases.

The tree is refined so that each activity has a start and a completion; each distinct sequence of lifecycle
events is aligned once a task, and the times of each case are replayed along its alignment.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweft.functions.stats import AGGREGATES
from chronoweft.operators.alignment import MODEL, MOST_STATES, SYNC, Aligner, Alignment
from chronoweft.plans import process_tree as P
from chronoweft.sources.logs import to_lifecycle

START, COMPLETE = "_start", "_complete"
KINDS = ("service", "idle", "waiting", "cycle")
Span = tuple[int | None, int | None]


def refined(tree: P.Tree) -> tuple[P.Tree, dict[int, int]]:
    """The tree with starts and completions, and the number here of each of its operators' and activities'
    numbers there."""
    numbers: dict[int, int] = {}
    old = new = -1

    def run(t: P.Tree) -> P.Tree:
        nonlocal old, new
        old, new = old + 1, new + 1
        numbers[new] = old
        if t[0] == "act":
            new += 2
            return P.op("seq", P.act(t[1] + START), P.act(t[1] + COMPLETE))
        return (t[0], tuple(run(c) for c in t[1])) if P.children(t) else t

    return run(tree), numbers


def merged(spans: list[Span]) -> list[Span]:
    """Overlapping and touching spans together; those with a side missing stay as they are."""
    whole = sorted(s for s in spans if None not in s)
    out: list[Span] = []
    for a, b in whole:
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out + [s for s in spans if None in s]


def gaps(spans: list[Span]) -> list[Span]:
    own = [s for s in merged(spans) if None not in s]
    return [(a[1], b[0]) for a, b in zip(own, own[1:], strict=False)]


class _Run:
    def __init__(self, enabled: int | None):
        self.enabled, self.last_end = enabled, enabled
        self.spans: list[Span] = []
        self.start: int | None = None
        self.end: int | None = None


def replay(alignment: Alignment, times: list[int], tree: P.Tree, numbers: dict[int, int]) -> list[tuple[int, int, str, int | None, int | None]]:
    """(node, run, kind, start, end) of one case."""
    up, kinds = P.parents(tree), [n[0] for n in P.nodes(tree)]
    now: dict[int, _Run] = {}
    done: dict[int, int] = {}
    out = []
    at = 0

    def close(k: int) -> None:
        run = now.pop(k)
        n = done[k] = done.get(k, -1) + 1
        starts = [s[0] for s in run.spans if s[0] is not None]
        ends = [s[1] for s in run.spans if s[1] is not None]
        first, last = min(starts, default=None), max(ends, default=None)
        out.extend((k, n, "service", *s) for s in merged(run.spans))
        out.extend((k, n, "idle", *s) for s in gaps(run.spans))
        if run.spans:
            out.append((k, n, "waiting", run.enabled, first))
            out.append((k, n, "cycle", run.enabled, last))
        parent = now.get(up[k])
        if parent:
            parent.spans += run.spans
            if last is not None:
                parent.last_end = last if parent.last_end is None else max(parent.last_end, last)

    for m in alignment.moves:
        k = numbers.get(m.node)
        if m.phase == "active":
            parent = now.get(up[k]) if up[k] >= 0 else None
            enabled = (times[0] if times else None) if parent is None else parent.last_end if kinds[up[k]] in ("seq", "loop") else parent.enabled
            now[k] = _Run(enabled)
        elif m.phase == "closed":
            if kinds[k] == "act":
                now[k].spans.append((now[k].start, now[k].end))
            close(k)
        elif m.activity is not None and m.kind in (SYNC, MODEL):
            owner = numbers[max(x for x in numbers if x <= m.node)]
            if m.kind == SYNC and owner in now:
                if m.activity.endswith(START):
                    now[owner].start = times[at]
                else:
                    now[owner].end = times[at]
        if m.kind in (SYNC, "log"):
            at += 1
    return out


def tree_intervals(log: DataFrame, tree: P.Tree, most_states: int = MOST_STATES) -> DataFrame:
    """case_id, node, run, kind, start_ts, end_ts for an interval log; a side is null where the model did
    something that the log didn't. A case whose alignment is given up has one row of kind ``given up``, without
    a node."""
    fine, numbers = refined(tree)
    name = F.concat("activity", F.when(F.lower("lifecycle") == "start", START).otherwise(COMPLETE))
    events = to_lifecycle(log).select("case_id", F.struct("event_idx", name.alias("a"), F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("ts")).alias("us")).alias("e"))
    cases = events.groupBy("case_id").agg(F.array_sort(F.collect_list("e")).alias("e")).select("case_id", F.col("e.a").alias("acts"), F.col("e.us").alias("us"))
    kind = dict(cases.dtypes)["case_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(fine, most_states=most_states)
        known: dict[tuple, Alignment | None] = {}
        for b in batches:
            index, rows = [], []
            for i, (acts, us) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)):
                key = tuple(acts)
                if key not in known:
                    if len(known) > 20_000:
                        known.clear()
                    known[key] = aligner.align(key)
                found = [(None, None, "given up", None, None)] if known[key] is None else replay(known[key], us, tree, numbers)
                index += [i] * len(found)
                rows += found
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = [pa.int32(), pa.int32(), pa.string(), pa.timestamp("us"), pa.timestamp("us")]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(index, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["case_id", "node", "run", "kind", "start_ts", "end_ts"])

    return cases.mapInArrow(run, f"case_id {kind}, node int, run int, kind string, start_ts timestamp_ntz, end_ts timestamp_ntz")


def overlap(one: Span, other: Span) -> int:
    """How long both of two whole spans go on."""
    return max(0, min(one[1], other[1]) - max(one[0], other[0]))


def node_totals(intervals: DataFrame, of_run: str = "sum", of_case: str = "avg", of_node: tuple[str, ...] = ("avg", "min", "max", "count")) -> DataFrame:
    """node, kind and aggregates over cases of an aggregate over a case's runs of an aggregate over a run's
    seconds: three aggregations, one inside the other, by the names in ``stats.AGGREGATES``. Columns are named for
    the last (avg: mean, count: n_cases)."""
    names = {"avg": "mean", "count": "n_cases"}
    seconds = F.timestamp_diff("MICROSECOND", F.col("start_ts"), F.col("end_ts")) / 1e6
    flat = intervals.select("node", "kind", "case_id", "run", "start_ts", seconds.alias("x"))
    per_run = flat.groupBy("node", "kind", "case_id", "run").agg(AGGREGATES[of_run]("x", "start_ts").alias("x"))
    per_case = per_run.groupBy("node", "kind", "case_id").agg(AGGREGATES[of_case]("x", "run").alias("x"))
    return per_case.groupBy("node", "kind").agg(*(AGGREGATES[f]("x", "case_id").alias(names.get(f, f)) for f in of_node))
