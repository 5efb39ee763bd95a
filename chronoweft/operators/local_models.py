"""Local process models: small models of clusters of patterns, their measures on a log, and their likeness."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import combinations, product

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweft.operators import projection
from chronoweft.operators.alignment import DEVIATION, LOG, MOST_MARKINGS, MOST_STATES, SYNC, Aligner, _silent_closure, precision
from chronoweft.operators.alignment import TAU as SILENT_MOVE
from chronoweft.operators.discovery import mine
from chronoweft.operators.mining import JOIN
from chronoweft.plans import process_tree as P
from chronoweft.plans import variant_tree as V
from chronoweft.plans.petri_net import net_of

FORBIDDEN = 1_000 * DEVIATION


def pattern_sequences(pattern: str, most: int = 10_000) -> list[tuple[str, ...]]:
    """Sequences of a chain of patterns, with ``...`` where its parts meet; an error if there are more than ``most``."""
    made = [V.bounded_sequentialisations(V.parse(p), most) for p in pattern.split(JOIN)]
    parts = [own for own, _ in made]
    if not all(whole for _, whole in made) or math.prod(map(len, parts)) > most:
        raise ValueError(f"a pattern has more than {most} sequences")
    out = []
    for chosen in product(*parts):
        flat: list[str] = []
        for i, own in enumerate(chosen):
            flat += [JOIN] * (i > 0) + list(own)
        out.append(tuple(flat))
    return out


def model_of(patterns: list[str]) -> P.Tree:
    """The model mined from the sequences of patterns, without the gaps between their parts."""
    return mine(Counter(tuple(a for a in s if a != JOIN) for p in patterns for s in pattern_sequences(p)))


def discover_models(clusters: DataFrame) -> DataFrame:
    """cluster, tree from (cluster, pattern); a cluster's patterns are few and meet in one task."""

    def run(pdf):
        return pdf[["cluster"]].head(1).assign(tree=P.text(model_of(sorted(pdf["pattern"]))))

    kind = dict(clusters.dtypes)["cluster"]
    return clusters.groupBy("cluster").applyInPandas(run, f"cluster {kind}, tree string")


RUN = "struct<first: int, last: int, acts: array<string>>"


def fragments(log: DataFrame, tree: P.Tree, most_states: int = MOST_STATES) -> DataFrame:
    """case_id, runs and used: the whole runs of the model in each case, with the places of their first and last
    events in the case and their activities; and the labels of the events that take part. The model may run
    any number of times; nothing may be missing from a run. Both are null where an alignment is given up."""
    labels = sorted(set(P.labels(tree)))
    looped = P.op("loop", P.op("xor", P.TAU, tree), P.TAU)
    number = 3  # loop, choice, silent, then the tree
    kept = projection.project(log, labels).groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("pos", "activity", "orig_pos"))).alias("x"))
    seqs = kept.select("case_id", F.col("x.activity").alias("acts"), F.col("x.orig_pos").alias("at"))
    kind = dict(seqs.dtypes)["case_id"]
    inner = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("acts", pa.list_(pa.string()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(looped, most_states=most_states, model_cost=FORBIDDEN)
        known: dict[tuple, tuple | None] = {}
        for b in batches:
            out = []
            for acts, at in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                key = tuple(acts)
                if key not in known:
                    if len(known) > 50_000:
                        known.clear()
                    a = aligner.align(key)
                    known[key] = None if a is None else (_runs(a, looped, number), [m.activity for m in a.moves if m.kind == SYNC])
                found = known[key]
                out.append((None, None) if found is None else ([{"first": at[i], "last": at[j], "acts": own} for i, j, own in found[0]], found[1]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([o[0] for o in out], inner), pa.array([o[1] for o in out], pa.list_(pa.string()))], ["case_id", "runs", "used"])

    found = seqs.mapInArrow(run, f"case_id {kind}, runs array<{RUN}>, used array<string>")
    everyone = log.select("case_id").distinct()
    return everyone.join(found.withColumn("seen", F.lit(True)), "case_id", "left").select(
        "case_id", F.when(F.col("seen"), F.col("runs")).otherwise(F.array().cast(f"array<{RUN}>")).alias("runs"), F.when(F.col("seen"), F.col("used")).otherwise(F.array().cast("array<string>")).alias("used")
    )


def _runs(own, tree: P.Tree, number: int) -> list[tuple[int, int, list[str]]]:
    """First and last event, and activities, of each run of a node that does something."""
    inside = set(range(number, number + P.size(P.nodes(tree)[number])))
    leaf = not P.children(P.nodes(tree)[number])
    out: list[tuple[int, int, list[str]]] = []
    now: list[tuple[int, str]] = []
    at = 0
    for m in own.moves:
        if m.node == number and m.phase == "active":
            now = []
        if m.node in inside and m.kind == SYNC:
            now.append((at, m.activity))
        if now and m.node == number and (m.phase == "closed" or leaf):
            out.append((now[0][0], now[-1][0], [a for _, a in now]))
            now = []
        at += m.kind in (SYNC, LOG)
    return out


def simplicity(tree: P.Tree, most: float = 2.0) -> float:
    """By inverse arc degree of the model's net: 1 where places and transitions have ``most`` arcs on average, or
    fewer, and less the more they have."""
    net = net_of(tree)
    arcs = sum(len(t.pre) + len(t.post) for t in net.transitions)
    return 1 / (1 + max(2 * arcs / (net.n_places + len(net.transitions)) - most, 0))


def skip_precision(log: DataFrame, tree: P.Tree, artificial: bool = False, most_states: int = MOST_STATES) -> float | None:
    """How rarely the model leaves out a skip (an activity ``...``) that it could make, over cases that do one of
    its activities: 1 less the share of steps before which a skip was possible and wasn't made. Cases are
    projected on the model's activities, with skips. ``artificial``: a model without skips can make one at any time. None without
    such a case."""
    labels = sorted(set(P.labels(tree)) - {JOIN})
    looped = P.op("loop", P.op("xor", P.TAU, tree), P.TAU)
    has_skip = JOIN in P.labels(tree)
    counted = projection.sequences(projection.project_with_skips(log, labels)).groupBy("acts").agg(F.count("*").alias("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(looped, most_states=most_states, model_cost=FORBIDDEN)
        for b in batches:
            made = [_skips(aligner, acts, has_skip, artificial) for acts in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.float64()), b.column(1)], ["share", "n"])

    got = counted.mapInArrow(run, "share double, n long").where("share IS NOT NULL").agg((F.sum(F.col("share") * F.col("n")) / F.sum("n")).alias("p")).first()
    return got["p"]


def _skips(aligner: Aligner, acts: list[str], has_skip: bool, artificial: bool) -> float | None:
    found = aligner.align(acts)
    if found is None:
        return None
    now, steps, missed, active = aligner.net.initial, 0, 0, False
    for m in found.moves:
        if m.kind == LOG:
            continue
        step = next(t for t in aligner.net.enabled(now) if (t.node, t.phase, t.label) == (m.node, m.phase, m.activity))
        if m.kind != SILENT_MOVE:
            steps += 1
            possible = artificial if not has_skip else any(t.label == JOIN for x in _silent_closure(aligner.net, {now}) for t in aligner.net.enabled(x))
            missed += possible and m.activity != JOIN
            active |= m.activity != JOIN
        now = (now - step.pre) | step.post
    return 1 - missed / steps if active else None


def measures(log: DataFrame, tree: P.Tree, skips: bool = False, most_states: int = MOST_STATES) -> DataFrame:
    """One row: support_tax, support_trans, support_occ, confidence, precision, coverage, simplicity, n_transitions,
    mean_range, min_range and max_range (from the first to the last event of each run) of the model, and with
    ``skips`` skip_precision."""
    labels = sorted(set(P.labels(tree)) - {JOIN})
    f = fragments(log, tree, most_states).persist()
    try:
        if lost := f.where("runs IS NULL").count():
            raise ValueError(f"the alignments of {lost} cases were given up; allow more states")
        support = projection.support_measures(f.select("case_id", F.size("runs").alias("occurrences"))).first()
        sure = projection.confidence(log, f.select(F.explode("used").alias("activity")), labels).first()
        covered = projection.coverage(log, labels).first()
        runs = f.select(F.explode("runs").alias("r"))
        spread = runs.agg(*(F.coalesce(how(F.col("r.last") - F.col("r.first")).cast("double"), F.lit(0.0)).alias(f"{name}_range") for how, name in ((F.avg, "mean"), (F.min, "min"), (F.max, "max")))).first()
        distinct = runs.select(F.col("r.acts").alias("acts")).distinct().withColumns({"n_cases": F.lit(1).cast("long"), "cost": F.lit(0).cast("long")})
        exact = precision(distinct, tree)
    finally:
        f.unpersist()
    row = {**support.asDict(), **sure.asDict(), "precision": exact, **covered.asDict(), "simplicity": simplicity(tree), "n_transitions": P.n_leaves(tree), **spread.asDict()}
    if skips:
        row["skip_precision"] = skip_precision(log, tree, True, most_states)
    kinds = {"n_transitions": "int"}
    return log.sparkSession.createDataFrame([tuple(row.values())], ", ".join(f"{k} {kinds.get(k, 'double')}" for k in row))


MOST_LABELS = 12
"""A footprint has links to all sets of a model's activities, so it is of small models only."""


def footprint(tree: P.Tree) -> dict[tuple, float]:
    """Weights of the activities (1), and of look-ahead and look-back links: after (before) an activity, one
    of a set always comes (came); a link to a set of n weighs 1/2^n.

    A set is linked just if no run of the net goes on to the end (came from the beginning) without any of it,
    however often loops run."""
    labels = sorted(set(P.labels(tree)))
    if len(labels) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} activities")
    net = net_of(tree)
    markings = net.reachable(MOST_MARKINGS)
    arcs = [(m, t.label, (m - t.pre) | t.post) for m in markings for t in net.enabled(m)]
    forth: dict[frozenset, list] = {}
    back: dict[frozenset, list] = {}
    for a, label, b in arcs:
        forth.setdefault(b, []).append((label, a))
        back.setdefault(a, []).append((label, b))
    out: dict[tuple, float] = {("activity", a): 1.0 for a in labels}
    for n in range(1, len(labels) + 1):
        for group in combinations(labels, n):
            ends = _reached(net.final, forth, set(group))  # from where the end is reached without any of them
            begins = _reached(net.initial, back, set(group))
            for x in labels:
                if not any(b in ends for a, label, b in arcs if label == x):
                    out["ahead", x, group] = 0.5**n
                if not any(a in begins for a, label, b in arcs if label == x):
                    out["back", x, group] = 0.5**n
    return out


def _reached(start: frozenset, arcs: dict[frozenset, list], without: set[str]) -> set[frozenset]:
    seen, todo = {start}, [start]
    while todo:
        for label, m in arcs.get(todo.pop(), ()):
            if label not in without and m not in seen:
                seen.add(m)
                todo.append(m)
    return seen


def similarity(one: P.Tree, other: P.Tree) -> float:
    """Cosine of two footprints: 1 for the same behaviour, 0 for no common activity."""
    a, b = footprint(one), footprint(other)
    dot = sum(w * b[k] for k, w in a.items() if k in b)
    size = math.sqrt(sum(w * w for w in a.values()) * sum(w * w for w in b.values()))
    return dot / size if size else 0.0
