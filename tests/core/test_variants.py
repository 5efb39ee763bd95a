"""Variants: their cut, codecs, rewriting, counting, distances and times."""

import math
import random

import pytest

from chronoweft.operators import performance, variants
from chronoweft.plans import variant_tree as V
from tests.core.helpers import ODD_LABELS, in_order, instant, log_of, random_cases, relations_of

TEXTS = {
    "→(pick, ship)": [("pick", 0, 1), ("ship", 3, 4)],
    "→(pick, ∧(label, pack), ship)": [("pick", 0, 2), ("pack", 3, 6), ("label", 4, 5), ("ship", 8, 9)],
    "∧(return, →(pick, ship))": [("return", 0, 20), ("pick", 1, 2), ("ship", 5, 6)],
    "∧(audit, →(pick, ∧(pack, →(label, label)), ship))": [("audit", 0, 30), ("pick", 1, 2), ("pack", 4, 12), ("label", 5, 6), ("label", 8, 9), ("ship", 15, 16)],
    "cancel": [("cancel", 0, 1)],
    # p before r, q before r and s, but p beside s: no cut, so the order stays unknown
    "|(p, q, r, s)": [("p", 0, 6), ("q", 0, 2), ("s", 4, 9), ("r", 7, 9)],
}


@pytest.mark.parametrize("text", TEXTS)
def test_variants_by_hand(spark, text):
    assert [r.variant for r in variants.case_variants(log_of(spark, {1: TEXTS[text]})).collect()] == [text]


def related_pairs(tree, base=0):
    """Pairs of leaves of a tree, numbered from ``base``, that stand in sequence; and its number of leaves."""
    if tree[0] == "leaf":
        return set(), len(tree[1])
    out, sizes = set(), []
    for c in tree[1]:
        own, n = related_pairs(c, base + sum(sizes))
        out |= own
        sizes.append(n)
    if tree[0] == "follows":
        edges = [base + sum(sizes[:k]) for k in range(len(sizes) + 1)]
        out |= {(i, j) for k in range(len(sizes)) for i in range(edges[k], edges[k + 1]) for j in range(edges[k + 1], base + sum(sizes))}
    return out, sum(sizes)


def test_cuts_by_definition():
    """A tree without a leaf of several labels says of any two instances just what the case says of them."""
    whole = 0
    for events in random_cases(300, 40, "uvw", 8).values():
        e = in_order(events)
        tree = V.variant_of([f"{i:02d}" for i in range(len(e))], [x[1] for x in e], [x[2] for x in e])
        order = [int(x) for x in V.labels(tree)]
        assert sorted(order) == list(range(len(e)))
        ef, _, _ = relations_of(events)
        in_sequence = {(order[i], order[j]) for i, j in related_pairs(tree)[0]}
        if all(len(t[1]) == 1 for t in leaves(tree)):
            whole += 1
            assert in_sequence == ef
        else:
            assert in_sequence <= ef
    assert whole > 200


def test_grouping(spark):
    """Cases have one variant just if an order-preserving renumbering of equal labels turns one into the other;
    here by comparing each case's canonical tree, made apart."""
    cases = random_cases(120, 5, ODD_LABELS, 4)
    want = {}
    for events in cases.values():
        e = in_order(events)
        raw = V.to_json(V.variant_of([x[0] for x in e], [x[1] for x in e], [x[2] for x in e]))
        want[raw] = want.get(raw, 0) + 1
    log = log_of(spark, cases)
    assert {r.variant_json: r.n_cases for r in variants.variants(log).collect()} == want
    ordered = variants.treebank(log).collect()
    assert [r.n_cases for r in ordered] == sorted(want.values(), reverse=True)
    bordered = variants.treebank(log, borders=True).collect()
    assert sum(r.n_cases for r in bordered) == len(cases) and all(V.labels(V.from_json(r.variant_json))[0] == "▶" for r in bordered)
    assert {V.to_json(V.without_borders(V.from_json(r.variant_json))) for r in bordered} == set(want)
    by_case = variants.treebank(log, by_case=True).collect()
    assert len(by_case) == len(cases) and {r.n_cases for r in by_case} == {1}


def test_sequences_are_told_apart_by_labels_not_text(spark):
    log = log_of(spark, {1: instant(["a,b"]), 2: instant(["a", "b"]), 3: instant(["a", "b"]), 4: instant(["a*", "b"]), 5: instant(["a", "a", "b"])})
    assert sorted((tuple(r.acts), r.n_cases) for r in variants.sequence_variants(log).collect()) == [(("a", "a", "b"), 1), (("a", "b"), 2), (("a*", "b"), 1), (("a,b",), 1)]
    assert sorted((tuple((x.a, x.again) for x in r.runs), r.n_cases) for r in variants.collapsed_sequences(log).collect()) == [((("a", False), ("b", False)), 2), ((("a", True), ("b", False)), 1), ((("a*", False), ("b", False)), 1), ((("a,b", False),), 1)]
    odd = log_of(spark, {1: [("x#0s+y", 0, 0)], 2: [("x", 0, 1), ("y", 0, 1)], 3: [("y", 0, 1), ("x", 0, 1)]})
    assert sorted(r.n_cases for r in variants.subvariants(odd).collect()) == [1, 2]


def leaves(tree):
    return [tree] if tree[0] == "leaf" else [x for c in tree[1] for x in leaves(c)]


def test_every_sequentialisation_respects_the_case():
    for events in random_cases(40).values():
        e = in_order(events)
        tree = V.variant_of([x[0] + str(i) for i, x in enumerate(e)], [x[1] for x in e], [x[2] for x in e])
        if V.n_sequentialisations(tree) <= 200 and all(len(t[1]) == 1 for t in leaves(tree)):
            for seq in V.sequentialisations(tree):
                at = {a: k for k, a in enumerate(seq)}
                for i, j in relations_of(events)[0]:
                    assert at[e[i][0] + str(i)] < at[e[j][0] + str(j)]


@pytest.mark.parametrize("raw", ["→('k', ∧('l', 'm'), 'n')", "∧('k', →('l', 'm'), 'n')", "✕('k', →('l', ∧('m', 'n')))", "->('k', +('l', ->('m', 'n'), 'o'))"])
def test_counts_match_enumeration(raw):
    tree = V.parse(raw)
    made = list(V.sequentialisations(tree))
    assert len(made) == len(set(made)) == V.n_sequentialisations(tree)
    assert V.from_json(V.to_json(tree)) == tree and V.parse(V.text(tree)) == tree


def test_bounded_sequentialisations(spark):
    """All of them where they are few; else a random sample without repeats, the same on every run, and said
    not to be all."""
    tree = V.parse("∧(k, l, m, →(n, o))")
    every = set(V.sequentialisations(tree))
    made, whole = V.bounded_sequentialisations(tree, 60)
    assert whole and set(made) == every and len(made) == 60
    seen = set()
    for seed in range(40):
        some, whole = V.bounded_sequentialisations(tree, 5, seed)
        assert not whole and len(set(some)) == 5 and set(some) <= every and some == V.bounded_sequentialisations(tree, 5, seed)[0]
        seen |= set(some)
    assert len(seen) > 50
    rows = spark.createDataFrame([(V.to_json(tree),), (V.to_json(V.parse("→(k, l)")),)], "variant_json string")
    got = variants.with_sequentialisations(rows, 7).collect()
    assert sorted((len(r.sequence), r.whole) for r in got) == [(2, True)] + [(5, False)] * 7


def test_unknown_order_and_length():
    tree = V.node("follows", V.leaf("q", "p"), V.leaf("r"))
    assert V.n_sequentialisations(tree) == 2 and V.length(tree) == 2 and V.n_activities(tree) == 3
    assert math.factorial(4) == V.n_sequentialisations(V.leaf("w", "x", "y", "z"))


def test_collapse_and_fold():
    assert V.text(V.collapse(V.parse("→(p, q, q, q, p)"))) == "→(p, *(q), p)"
    assert V.text(V.collapse(V.parse("→(q, q, q)"))) == "*(q)"
    assert V.text(V.fold_runs(V.parse("→(p, q, q, q, p, p)"), 2)) == "→(p, q_LOOP, p_LOOP)"
    assert V.text(V.fold_runs(V.parse("→(p, q, q, q, p, p)"), 3)) == "→(p, q_LOOP, p, p)"
    assert V.text(V.fold_runs(V.parse("→(p, p, q)"), 4)) == "→(p, p, q)"


def test_fragment_counts():
    rng = random.Random(1)
    for _ in range(50):
        values, part = [rng.choice("pqr") for _ in range(rng.randrange(12))], [rng.choice("pqr") for _ in range(rng.randrange(1, 3))]
        assert V.ordered_count(values, part) == sum(1 for i in range(len(values)) if values[i : i + len(part)] == part)
        assert V.unordered_count(values, part) == min(values.count(x) for x in part)
    tree = V.parse("→(m, n, ∧(o, →(m, n)), p, m, n)")
    assert V.count_fragment(tree, V.parse("→(m, n)")) == 3
    assert V.count_fragment(tree, V.parse("→(m, n)"), "PREFIX") == 1 and V.count_fragment(tree, V.parse("→(p, m)"), "POSTFIX") == 0 and V.count_fragment(tree, V.parse("→(m, n)"), "POSTFIX") == 1


def test_edit_distance():
    x, y = V.parse("→(k, ∧(l, m))"), V.parse("→(k, l, m)")
    assert V.edit_distance(x, x) == 0 and V.edit_distance(x, y) == 1 == V.edit_distance(y, x)
    assert V.edit_distance(V.parse("→(k, l)"), V.parse("→(k, n, o)")) == 2


def test_edit_distance_is_a_metric():
    rng = random.Random(2)

    def tree(depth):
        if depth == 0 or rng.random() < 0.4:
            return V.leaf(rng.choice("xyz"))
        return V.node(rng.choice(["follows", "parallel"]), *(tree(depth - 1) for _ in range(rng.randrange(2, 4))))

    trees = [tree(3) for _ in range(8)]
    for x in trees:
        for y in trees:
            assert V.edit_distance(x, y) == V.edit_distance(y, x) and (V.edit_distance(x, y) == 0) == (x == y)
            for z in trees:
                assert V.edit_distance(x, z) <= V.edit_distance(x, y) + V.edit_distance(y, z)


def test_node_times(spark):
    log = log_of(spark, {7: TEXTS["→(pick, ∧(label, pack), ship)"]})
    nodes = performance.node_times(log)
    assert {(r.label, r.start_ts.hour, r.end_ts.hour) for r in nodes.collect()} == {("→", 0, 9), ("pick", 0, 2), ("∧", 3, 6), ("label", 4, 5), ("pack", 3, 6), ("ship", 8, 9)}
    hour = 3600.0
    assert sorted(r.wait for r in performance.sequence_waits(nodes).collect()) == [1 * hour, 2 * hour]
    assert {(r.wait_start, r.wait_end) for r in performance.parallel_waits(nodes).collect()} == {(0.0, 0.0), (1 * hour, 1 * hour)}


def test_waits_by_brute_force(spark):
    """Waits in sequences and parallels, from each case's tree and times, over random cases."""
    cases = random_cases(60, 21, "uvw", 6)
    log = log_of(spark, cases)
    nodes = performance.node_times(log)
    waits, beside = [], []
    for case, events in cases.items():
        e = in_order(events)
        tree = V.variant_of([f"{i:02d}" for i in range(len(e))], [x[1] for x in e], [x[2] for x in e])

        def span(t, e=e):
            at = [int(x) for x in V.labels(t)]
            return min(e[i][1] for i in at), max(e[i][2] for i in at)

        def walk(t, case=case, span=span):
            if t[0] == "leaf":
                return
            own = span(t)
            for k, c in enumerate(t[1]):
                if t[0] == "follows" and k:
                    waits.append((case, 3600.0 * (span(c)[0] - span(t[1][k - 1])[1])))
                if t[0] == "parallel":
                    beside.append((case, 3600.0 * (span(c)[0] - own[0]), 3600.0 * (own[1] - span(c)[1])))
                walk(c)

        walk(tree)
    assert sorted((r.case_id, r.wait) for r in performance.sequence_waits(nodes).collect()) == sorted(waits)
    assert sorted((r.case_id, r.wait_start, r.wait_end) for r in performance.parallel_waits(nodes).collect()) == sorted(beside)


def test_synthetic_intervals_give_the_variant_again():
    for raw in ("→(p, ∧(q, r))", "∧(o, →(p, ∧(q, r)))", "→(n, ∧(m, →(q, r)), k)", "p", "∧(p, q, r)"):
        tree = V.canonical(V.parse(raw))
        rows = V.intervals(tree)
        assert V.variant_of([r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows]) == tree


def test_queries_on_variants(spark):
    from chronoweft.plans import vql

    trees = variants.variants(log_of(spark, dict(enumerate(TEXTS.values()))))
    got = {r.case_id for r in vql.query_cases(variants.as_log(trees), "'pack' isP ANY {'label', 'audit'} AND 'ship' isC;").collect()}
    assert {V.text(V.from_json(x)) for x in got} == {"→(pick, ∧(label, pack), ship)", "∧(audit, →(pick, ∧(pack, →(label, label)), ship))"}
