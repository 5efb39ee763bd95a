"""Times of model nodes, local models and their measures, footprints, scores by a model."""

import datetime
import itertools
import random

import numpy as np
import pytest

from chronoweft.functions import stats
from chronoweft.operators import clustering as C
from chronoweft.operators import local_models as L
from chronoweft.operators import ordering as O
from chronoweft.operators import tree_performance as T
from chronoweft.operators.alignment import f_measure, f_measure_of
from chronoweft.plans import process_tree as P
from chronoweft.plans import variant_tree as V
from tests.core.helpers import ORIGIN, instant, log_of

# wash, then dry and iron side by side, the two of them once more, and fold at the end
MODEL = P.parse("->('wash', *(+('dry', 'iron'), tau), 'fold')")
CASE = [("wash", 0, 4), ("dry", 6, 9), ("iron", 7, 12), ("iron", 15, 16), ("dry", 18, 21), ("fold", 30, 31)]


def hours(ts):
    return None if ts is None else int((ts - ORIGIN) / datetime.timedelta(hours=1))


def number_of(label):
    return next(i for i, n in enumerate(P.nodes(MODEL)) if n == P.act(label))


def test_intervals_by_hand(spark):
    rows = T.tree_intervals(log_of(spark, {0: CASE}), MODEL).collect()
    of = lambda node, kind: sorted((r.run, hours(r.start_ts), hours(r.end_ts)) for r in rows if r.node == node and r.kind == kind)
    assert of(0, "service") == [(0, 0, 4), (0, 6, 12), (0, 15, 16), (0, 18, 21), (0, 30, 31)]
    assert of(0, "idle") == [(0, 4, 6), (0, 12, 15), (0, 16, 18), (0, 21, 30)]
    assert of(0, "waiting") == [(0, 0, 0)] and of(0, "cycle") == [(0, 0, 31)]
    beside = next(i for i, n in enumerate(P.nodes(MODEL)) if n[0] == "and")
    assert of(beside, "service") == [(0, 6, 12), (1, 15, 16), (1, 18, 21)] and of(beside, "idle") == [(1, 16, 18)]
    assert of(number_of("dry"), "service") == [(0, 6, 9), (1, 18, 21)] and of(number_of("fold"), "service") == [(0, 30, 31)]
    assert of(number_of("fold"), "waiting") == [(0, 21, 30)] and of(beside, "waiting") == [(0, 4, 6), (1, 12, 15)]


def test_totals_by_the_aggregates_asked_for(spark):
    rows = T.tree_intervals(log_of(spark, {0: CASE, 1: [("wash", 0, 2), ("dry", 3, 5), ("iron", 3, 4), ("fold", 6, 7)]}), MODEL)
    beside, hour = 2 + 1, 3600.0
    assert P.nodes(MODEL)[beside][0] == "and"
    mean = {(r.node, r.kind): r.mean for r in T.node_totals(rows).collect()}
    assert mean[0, "service"] == (15 + 5) / 2 * hour and mean[beside, "service"] == ((6 + 4) / 2 + 2) / 2 * hour
    most = {(r.node, r.kind): (r.max, r.n_cases) for r in T.node_totals(rows, "max", "sum", ("max", "count")).collect()}
    assert most[beside, "service"] == ((6 + 3) * hour, 2)
    listed = {(r.node, r.kind): r.noop for r in T.node_totals(rows, "sum", "index", ("noop",)).collect()}
    assert listed[beside, "service"] == [{0: 6 * hour, 1: 4 * hour}, {0: 2 * hour}]


def test_missing_events_and_overlap(spark):
    rows = T.tree_intervals(log_of(spark, {0: [("p", 0, 1), ("r", 2, 3)]}), P.parse("->('p','q','r')")).collect()
    assert {(r.node, hours(r.start_ts), hours(r.end_ts)) for r in rows if r.kind == "service" and r.node} == {(1, 0, 1), (2, None, None), (3, 2, 3)}
    assert (T.overlap((0, 5), (3, 9)), T.overlap((0, 5), (5, 9)), T.overlap((0, 2), (4, 9)), T.overlap((0, 9), (3, 4))) == (2, 0, 0, 1)
    lost = T.tree_intervals(log_of(spark, {0: [("p", 0, 1), ("r", 2, 3)]}), P.parse("->('p','q','r')"), most_states=2).collect()
    assert [(r.case_id, r.node, r.kind) for r in lost] == [(0, None, "given up")]


def test_statistics_of_statistics(spark):
    """Against numpy, with a missing value and one group of one."""
    rows = [("x", 1.0, 4.0), ("x", 3.0, None), ("x", 8.0, 5.0), ("y", 2.0, 2.0)]
    got = {(r.g, r.key): r for r in stats.statistics_of(spark.createDataFrame(rows, "g string, mean double, max double"), ["g"], ("mean", "max")).collect()}
    for (g, key), r in got.items():
        own = [x[1 + ("mean", "max").index(key)] for x in rows if x[0] == g]
        known = [v for v in own if v is not None]
        assert (r.n, r.n_not_none, r.min, r.max) == (len(own), len(known), min(known), max(known))
        assert np.allclose([r.mean, r.median, r.p95, r.stdev], [np.mean(known), np.median(known), np.percentile(known, 95), np.std(known, ddof=1) if len(known) > 1 else 0])
    assert set(got) == {(g, k) for g in "xy" for k in ("mean", "max")}


def test_percentiles_of_large_groups(spark):
    """Against numpy: a large group, one with few values, one of one, one of nulls, a null key, and no key at all."""
    rng = np.random.default_rng(4)
    rows = [("large", float(x)) for x in rng.lognormal(3, 2, 6000)] + [("few", float(x)) for x in rng.integers(0, 3, 500)] + [("one", 7.0), ("none", None), ("none", None), (None, 1.0), (None, 2.0)]
    table = spark.createDataFrame(rows, "g string, x double").repartition(5)
    points = [0.0, 0.1, 0.5, 0.95, 0.9995, 1.0]
    for accuracy in (100, 10_000):
        got = {r.g: r for r in stats.exact_percentiles(table, ["g"], "x", points, accuracy).collect()}
        assert set(got) == {"large", "few", "one", "none", None}
        for g, r in got.items():
            own = [x for k, x in rows if k == g and x is not None]
            assert r.n == len(own) and (np.allclose(r.p, np.percentile(own, [100 * p for p in points])) if own else r.p == [None] * len(points)), g
    (every,) = stats.exact_percentiles(table, [], "x", points).collect()
    assert np.allclose(every.p, np.percentile([x for _, x in rows if x is not None], [100 * p for p in points]))


def test_scores_of_sequences_for_their_variants(spark):
    rows = spark.createDataFrame([("v", 1.0), ("v", 4.0), ("w", 2.0)], "candidate string, score double")
    assert {r.candidate: r.score for r in O.adapted(rows).collect()} == {"v": 2.5, "w": 2.0}
    from pyspark.sql import functions as F

    assert {r.candidate: r.score for r in O.adapted(rows, F.max).collect()} == {"v": 4.0, "w": 2.0}


def test_borders_and_numbers_of_leaves():
    tree = P.parse("->('k', X('l', tau))")
    assert P.labels(P.with_borders(tree)) == ["▶", "k", "l", "■"] and P.without_borders(P.with_borders(tree)) == tree
    assert P.without_borders(P.with_borders(P.parse("+('k', 'l')"))) == P.parse("+('k', 'l')")
    assert V.labels(V.number_labels(V.parse("→(k, ∧(l, k), k)"))) == ["k0", "l0", "k1", "k2"]


def after_and_before(tree, loops):
    """Links of a footprint from enumerated words."""
    traces = set(P.language(tree, loops))
    labels = sorted(set(P.labels(tree)))
    out = {("activity", a): 1.0 for a in labels}
    for a in labels:
        after = [set(t[i + 1 :]) for t in traces for i, x in enumerate(t) if x == a]
        before = [set(t[:i]) for t in traces for i, x in enumerate(t) if x == a]
        for n in range(1, len(labels) + 1):
            for group in itertools.combinations(labels, n):
                for name, seen in (("ahead", after), ("back", before)):
                    if all(s & set(group) for s in seen):
                        out[name, a, group] = 0.5**n
    return out


@pytest.mark.parametrize("raw", ["->('k', X('l', tau), 'm')", "+('k', ->('l', 'm'))", "->('k', *('l', 'm'), 'n')", "X('k', ->('l', 'k'))", "*(->('k', X('l', 'm')), 'n')"])
def test_footprints_by_enumeration(raw):
    tree = P.parse(raw)
    assert L.footprint(tree) == after_and_before(tree, 3)


def test_similarity():
    p, q, r = P.parse("->('k', +('l', 'm'))"), P.parse("->('k', 'l', 'n')"), P.parse("X('u', 'v')")
    assert abs(L.similarity(p, p) - 1) < 1e-9 and L.similarity(p, r) == 0 and 0.1 < L.similarity(p, q) < 0.9
    assert L.similarity(p, P.parse("->('k', 'l', 'm')")) > L.similarity(p, q) and L.similarity(p, q) == L.similarity(q, p)


def test_local_models(spark):
    assert P.canonical(L.model_of(["→(k, ∧(l, m))"])) == P.parse("->('k', +('l', 'm'))")
    assert ("k", "...", "l", "m") in L.pattern_sequences("k...→(l, m)")
    clusters = spark.createDataFrame([(0, "→(k, l)"), (0, "→(k, m)"), (1, "x")], "cluster int, pattern string")
    assert {r.cluster: r.tree for r in L.discover_models(clusters).collect()} == {0: "->('k', X('l', 'm'))", 1: "'x'"}


TRACES = ["kol", "klkl", "lk", "oo", "kkoml", "koookl", "kmlxkl"]


def test_measures(spark):
    """Runs of k then l by hand; ranges are places in the whole case."""
    log = log_of(spark, {i: instant(t) for i, t in enumerate(TRACES)})
    tree = P.parse("->('k','l')")
    # of several places where a run could begin, the alignment may take any
    runs = {r.case_id: len(r.runs) for r in L.fragments(log, tree).collect()}
    assert runs == {0: 1, 1: 2, 2: 0, 3: 0, 4: 1, 5: 1, 6: 2}
    m = L.measures(log, tree).first()
    assert (m.support_tax, m.support_trans, m.support_occ) == (7 / 8, 5 / 7, 1.0)
    assert m.n_transitions == 2 and m.precision == 1 and abs(m.coverage - sum(t.count("k") + t.count("l") for t in TRACES) / sum(map(len, TRACES))) < 1e-9
    sure = log_of(spark, {0: instant("kol"), 1: instant("klkl"), 2: instant("kxxl")})
    own = L.measures(sure, tree).first()
    assert (own.mean_range, own.min_range, own.max_range) == ((2 + 1 + 1 + 3) / 4, 1, 3) and own.confidence == 1
    assert {(r.first, r.last, "".join(r.acts)) for x in L.fragments(sure, tree).collect() for r in x.runs} == {(1, 3, "kl"), (1, 2, "kl"), (3, 4, "kl"), (1, 4, "kl")}
    assert L.measures(log, P.parse("->('zz', 'l')")).first().mean_range == 0
    wide = L.measures(sure, P.parse("->('k', X('l', 'q', 's', 'u'))")).first()
    assert wide.precision < 1 and wide.simplicity <= own.simplicity <= 1
    with pytest.raises(ValueError, match="given up"):
        L.measures(log, tree, most_states=2)


def test_simplicity_by_counting():
    # a parallel of three: 2 + 3 + 3 places and 3 + 2 transitions; 4 + 4 arcs at its ends and 2 at each leaf
    assert abs(L.simplicity(P.parse("+('k', 'l', 'm')")) - 1 / (1 + max(2 * (4 + 4 + 6) / (8 + 5) - 2, 0))) < 1e-9
    assert L.simplicity(P.act("k")) == 1


def test_skip_precision(spark):
    """Of a model that goes on from k to l, or skips first: who never skips leaves out one skip in two steps."""
    tree = P.parse("->('k', X('l', ->('...', 'l')))")
    some = log_of(spark, {0: instant("kl"), 1: instant("kxl"), 2: instant("yy")})
    assert abs(L.skip_precision(some, tree) - (1 / 2 + 1) / 2) < 1e-9
    assert L.skip_precision(log_of(spark, {0: instant("kl"), 1: instant("k")}), P.parse("->('k', 'l')")) == 1
    assert L.skip_precision(log_of(spark, {0: instant("kl")}), P.parse("->('k', 'l')"), artificial=True) == 0
    assert L.skip_precision(log_of(spark, {0: instant("yy")}), tree) is None


def test_patterns_of_too_many_sequences_raise():
    assert len(L.pattern_sequences("∧(u, v, w)...∧(x, y)", 12)) == 12
    for pattern in ("∧(u, v, w)...∧(x, y)", "∧(u, v, w, x)"):
        with pytest.raises(ValueError, match="more than 11 sequences"):
            L.pattern_sequences(pattern, 11)


def test_chain_distances():
    chain = lambda raw: tuple(V.parse(x) for x in raw.split("..."))
    assert C.chain_distance(chain("k...l"), chain("k...l")) == 0
    assert C.chain_distance(chain("k"), chain("k...l")) == 0 + 0 + 1  # l is one away from k
    assert C.chain_distance(chain("→(k, m)...l"), chain("k...l")) == (2 + 0) + (2 + 0)
    assert C.chain_distance(chain("k...l"), chain("→(k, m)...l")) == (1 + 0) + (2 + 0)  # k is nearer to the later l


def test_clusters_within_groups(spark):
    from chronoweft.operators import variants

    rows = variants.variants(log_of(spark, {i: instant(t) for i, t in enumerate(["kl", "km", "klmno", "xy", "xz"])}))
    got = {}
    for r in C.cluster_in_groups(C.cluster_by_start(rows), 1).collect():
        got.setdefault(r.cluster, set()).add("".join(V.labels(V.from_json(r.variant_json))))
    assert sorted(map(sorted, got.values())) == [["kl", "km"], ["klmno"], ["xy", "xz"]] and all(k[0] in "kx" for k in got)


def table_of(spark, traces):
    return spark.createDataFrame([(t, list(t), n) for t, n in traces], "variant string, acts array<string>, n_cases long")


def test_scores_by_a_model(spark):
    v = table_of(spark, [("kl", 3), ("k", 2), ("xkl", 1)])
    tree = P.parse("->('k','l')")
    assert [r.candidate for r in O.ranked(O.alignment_scores(v, tree)).orderBy("rank").collect()] == ["kl", "k", "xkl"]
    assert {r.candidate: r.score for r in O.deviation_height_scores(v, tree).collect()}["kl"] == float("inf")
    assert {r.score for r in O.duplicate_scores(v, tree).collect()} == {0.0}
    assert O.choose(v, [(lambda x: O.alignment_scores(x, tree), 0.5), (lambda x: O.missing_activity_scores(x, ["k"]), None)]) == "k"


def test_brute_force_scores(spark):
    """The score is the F-measure of the model with the variant, as computed on the table."""
    traces = {"kl": 3, "km": 2, "klm": 1, "mk": 1}
    tree, counts = P.parse("->('k', 'l')"), {tuple(t): n for t, n in traces.items()}
    log = log_of(spark, {i: instant(t) for i, t in enumerate(t for t, n in traces.items() for _ in range(n))})
    for raw in ("->('k', 'l')", "->('k', X('l', 'm'))", "+('k', *('l', 'm'))"):
        assert abs(f_measure_of(counts, P.parse(raw)) - f_measure(log, P.parse(raw))) < 1e-9
    got = {r.candidate: r.score for r in O.brute_force_scores(table_of(spark, traces.items()), tree, [tuple("kl")], counts).collect()}
    assert abs(got["kl"] - f_measure_of(counts, tree)) < 1e-9 and max(got, key=got.get) == "km"


def test_levenshtein_of_many_labels(spark):
    """Over 300 labels, some with commas, every distance is exact."""
    rng = random.Random(3)
    names = [f"label {i}, {i % 7}" for i in range(320)]
    variants = [[n] for n in names] + [rng.sample(names, 5) for _ in range(10)]
    rows = spark.createDataFrame([(f"v{i}", acts, 1 + i % 3) for i, acts in enumerate(variants)], "variant string, acts array<string>, n_cases long")

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    got = {r.candidate: r.score for r in O.levenshtein_scores(rows).collect()}
    for i in [*range(0, 320, 40), *range(320, 330)]:
        assert got[f"v{i}"] == sum(distance(variants[i], b) * (1 + j % 3) for j, b in enumerate(variants))
    missing = {r.candidate: r.score for r in O.missing_activity_scores(rows, names[:100]).collect()}
    assert missing["v5"] == 0 and missing["v200"] == 1


def test_parts_of_groups_and_typed_borders():
    group = V.parse("∧(k, k, l, l, l, m)")
    assert V.n_times_part(V.parse("∧(k, l)"), group) == 2 and V.n_times_part(V.parse("∧(m, x)"), group) == 1 and V.n_times_part(V.parse("∧(x, y)"), group) == 0
    tree = V.parse("→(k, l)")
    assert [V.labels(V.with_borders(tree, tag=tag)) for tag in ("NOT_AN_INFIX", "PREFIX", "POSTFIX", "PROPER_INFIX")] == [["▶", "k", "l", "■"], ["▶", "k", "l"], ["k", "l", "■"], ["k", "l"]]
