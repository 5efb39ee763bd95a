"""Rewriting of parallel parts, clusters, and the stream of pairs."""

import random

import numpy as np
import pytest

from chronoweft.operators import clustering as C
from chronoweft.operators import variants
from chronoweft.plans import sequentializer as S
from chronoweft.plans import variant_tree as V
from tests.core.helpers import ODD_LABELS, log_of, random_cases

WHOLE, TO = "+('mix', 'heat')", "->('heat', 'mix')"
OPEN, OPEN_TO = "+('mix', 'heat', ...)", "->('heat', 'mix', ...)"
RULES = [
    # the pattern is the whole parallel: it becomes a sequence, which joins the sequence around it
    ("->('start', +('heat', 'mix'), 'stop')", WHOLE, TO, "→(start, heat, mix, stop)"),
    # one activity more: a pattern without ... doesn't match
    ("->('start', +('heat', 'mix', 'stir'), 'stop')", WHOLE, TO, "→(start, ∧(heat, mix, stir), stop)"),
    # with ..., what else is parallel stays together where the target has its ...
    ("+('heat', 'mix', 'stir', 'taste')", OPEN, OPEN_TO, "→(heat, mix, ∧(stir, taste))"),
    ("+('heat', 'mix', 'stir', 'taste')", OPEN, "->(..., 'mix', 'heat')", "→(∧(stir, taste), mix, heat)"),
    ("+('heat', 'mix', 'stir')", OPEN, "+(->('mix', 'heat'), ...)", "∧(→(mix, heat), stir)"),
    # inside of a nested part
    ("+('boil', ->('wash', +('heat', 'mix')))", WHOLE, TO, "∧(boil, →(wash, heat, mix))"),
    # an activity is missing
    ("+('heat', 'stir')", OPEN, OPEN_TO, "∧(heat, stir)"),
    # groups: what is in the second waits for all of the first
    ("+('heat', 'mix', 'stir')", "+({'mix', 'stir'}, {'heat'})", "->({'mix', 'stir'}, {'heat'})", "→(∧(mix, stir), heat)"),
]


@pytest.mark.parametrize(("tree", "source", "target", "want"), RULES)
def test_rewrites(tree, source, target, want):
    assert V.text(S.apply(V.parse(tree), source, target)) == want


def test_rewriting_keeps_activities_and_orders():
    """On random variants: no activity is lost or made, and what was in sequence stays so."""
    for events in random_cases(80, 12, "mhs", 6).values():
        e = sorted(events, key=lambda x: x[1])
        tree = V.variant_of([x[0] for x in e], [x[1] for x in e], [x[2] for x in e])
        made = S.apply(tree, "+('m', 'h', ...)", "->('m', 'h', ...)")
        assert sorted(V.labels(made)) == sorted(V.labels(tree))
        # a leaf of several labels, whose order is unknown, counts as parallel
        both = any({"m", "h"} <= (set(t[1]) if t[0] == "leaf" else {x[1][0] for x in t[1] if x[0] == "leaf" and len(x[1]) == 1}) for t in nodes(tree) if t[0] in ("leaf", "parallel"))
        assert (made != tree) == both and V.n_sequentialisations(made) <= V.n_sequentialisations(tree)


def nodes(tree):
    return [tree] if tree[0] == "leaf" else [tree, *(x for c in tree[1] for x in nodes(c))]


def test_rewritten_variants_are_counted_together(spark):
    cases = {1: [("mix", 0, 5), ("heat", 1, 3)], 2: [("heat", 0, 1), ("mix", 2, 3)], 3: [("heat", 0, 1), ("mix", 1, 3)], 4: [("mix", 0, 1)]}
    rewritten = variants.variants(log_of(spark, cases), change=lambda t: S.apply(t, WHOLE, TO))
    assert {r.variant: r.n_cases for r in rewritten.collect()} == {"→(heat, mix)": 3, "mix": 1}


def test_agglomerative_and_medoids():
    d = np.array([[0, 1, 9, 9], [1, 0, 9, 9], [9, 9, 0, 2], [9, 9, 2, 0]], float)
    assert C.agglomerative(d, 2) == [0, 0, 1, 1] and C.agglomerative(d, 1) == [0, 0, 1, 2] and len(set(C.agglomerative(d, 9))) == 1
    a = C.medoids(d, 2)
    assert a[0] == a[1] != a[2] == a[3]


def test_clusters_of_variants(spark):
    """Clusters of complete linkage have no two trees further apart than asked, and can't be joined."""
    rows = variants.variants(log_of(spark, random_cases(40, 2, ODD_LABELS, 4)))
    found = {}
    for r in C.cluster_by_distance(rows, 2).collect():
        found.setdefault(r.cluster, []).append(V.from_json(r.variant_json))
    assert sum(map(len, found.values())) == rows.count()
    apart = lambda xs, ys: max(V.edit_distance(x, y) for x in xs for y in ys)
    clusters = list(found.values())
    assert all(apart(c, c) <= 2 for c in clusters)
    assert all(apart(c, d) > 2 for i, c in enumerate(clusters) for d in clusters[:i])
    assert C.cluster_by_labels(rows, 3).select("cluster").distinct().count() == 3


def test_labels_of_any_signs(spark):
    """Counts of labels, and first labels, where labels have brackets, quotation marks and commas."""
    cases = random_cases(40, 6, ODD_LABELS, 5)
    rows = variants.variants(log_of(spark, cases))
    trees = {r.variant_json: V.from_json(r.variant_json) for r in rows.collect()}
    want = {(raw, x, V.labels(t).count(x)) for raw, t in trees.items() for x in V.labels(t)}
    assert {(r.variant_json, r.label, r.n) for r in C.label_counts(rows).collect()} == want
    by_start = {r.variant_json: r.cluster for r in C.cluster_by_start(rows).collect()}
    assert by_start == {raw: V.labels(t)[0] for raw, t in trees.items()}
    sizes = {}
    for x in by_start.values():
        sizes[x] = sizes.get(x, 0) + 1
    kept = {r.cluster for r in C.largest_clusters(C.cluster_by_start(rows), 1).select("cluster").distinct().collect()}
    assert len(kept) == 1 and sizes[kept.pop()] == max(sizes.values())


def test_stream(spark, tmp_path):
    import datetime

    from chronoweft.streaming.relations import directly_follows_stream

    t0 = datetime.datetime(2024, 1, 1)
    rows = [("1", a, t0 + datetime.timedelta(hours=h)) for a, h in (("x", 0), ("z", 2), ("y", 1))] + [("2", "q", t0 + datetime.timedelta(days=9))]
    schema = "case_id string, activity string, ts timestamp"
    for i, r in enumerate(rows):
        spark.createDataFrame([r], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(str(tmp_path / "in"))
    q = directly_follows_stream(stream, "1 minute").writeStream.format("memory").queryName("df_pairs").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.processAllAvailable()
    q.stop()
    got = [(r.a, r.b) for r in spark.sql("SELECT * FROM df_pairs WHERE case_id = '1' ORDER BY ts").collect()]
    assert got == [("x", "y"), ("y", "z")]
