"""Frequent patterns and chains, against matching and enumeration without levels."""

import itertools
import random
from collections import Counter

import pytest

from chronoweft.operators import mining as M
from chronoweft.operators import variants
from chronoweft.plans import variant_tree as V
from tests.core.helpers import ODD_LABELS, log_of, random_cases


@pytest.fixture(scope="module")
def trees(spark):
    return variants.variants(log_of(spark, random_cases(70, 31, [*"uvw", *ODD_LABELS[3:5]], 8, 20, 3))).cache()


def trees_of(spark, raw, n):
    return spark.createDataFrame([(V.to_json(V.canonical(V.parse(raw))), n)], "variant_json string, n_cases long")


def weighed(strategy, counts, n):
    """A variant's share of supports, from numbers of roots."""
    return {p: (n if strategy.startswith("Trace") else 1) * (k if strategy.endswith("Occurrence") else 1) for p, k in counts.items()}


def inner(tree):
    return [tree] if tree[0] == "leaf" else [tree, *(x for c in tree[1] for x in inner(c))]


@pytest.mark.parametrize("strategy", M.STRATEGIES)
def test_levels_lose_nothing(trees, strategy):
    """What levels find is what enumeration of every pattern and chain finds, with the same supports."""
    rows = [(V.from_json(r.variant_json), r.n_cases) for r in trees.collect()]
    total = Counter()
    for t, n in rows:
        total.update(weighed(strategy, Counter(p for x in inner(t) for p in M.patterns_at(x, 5)), n))
    got = {M.decode(r.pattern_json): r.support for r in M.frequent_patterns(trees, strategy, 3, 5).collect()}
    assert got == {p: n for p, n in total.items() if n >= 3}
    assert {M.decode(r.pattern_json) for r in M.frequent_patterns(trees, strategy, 3, 5, strict=True).collect()} == {p for p, n in total.items() if n > 3}
    infixes = [p for p, n in total.items() if n >= 4 and M.n_nodes(p) <= 3]
    chains = Counter()
    for t, n in rows:
        chains.update(weighed(strategy, M.chain_supports(t, infixes, 3), n))
    found = {M.decode(r.pattern_json): r.support for r in M.frequent_chains(trees, strategy, 4, 3, 3).collect()}
    assert found == {c: n for c, n in chains.items() if n >= 4} and max(map(len, found)) >= 2


def test_enumeration_agrees_with_matching(trees):
    rows = M.frequent_patterns(trees, "VariantOccurrence", 1, 6).collect()
    all_ = [V.from_json(r.variant_json) for r in trees.collect()]
    for r in rows[::7]:
        p = M.decode(r.pattern_json)
        assert r.support == sum(len({o[0] for o in M.occurrences(t, p)}) for t in all_), r.pattern


def test_patterns_by_hand(spark):
    t = trees_of(spark, "→(p, ∧(q, r), s)", 5)
    got = {r.pattern: (r.k, r.support) for r in M.frequent_patterns(t, least=1, size=7).collect()}
    assert got == {p: (k, 5) for p, k in {"p": 1, "q": 1, "r": 1, "s": 1, "∧(q, r)": 3, "→(p, ∧(q, r))": 5, "→(∧(q, r), s)": 5, "→(p, ∧(q, r), s)": 6}.items()}


def test_chains_of_one_label(spark):
    """In a sequence of five, of occurrences that follow one another with one between: pairs (1,3) (1,4) (1,5)
    (2,4) (2,5) (3,5), so three can begin and three can end; and one chain of three."""
    t = trees_of(spark, "→(z, z, z, z, z)", 3)
    got = {r.pattern: r.support for r in M.frequent_chains(t, "TraceOccurrence", 1, 1, 3).collect()}
    assert got == {"z": 15, "z...z": 9, "z...z...z": 3}
    once = {r.pattern: r.support for r in M.frequent_chains(t, "VariantTransaction", 1, 1, 3).collect()}
    assert once == dict.fromkeys(got, 1)
    beside = {r.pattern: r.support for r in M.frequent_chains(trees_of(spark, "∧(z, z, z)", 3), "TraceOccurrence", 1, 4, 2).collect()}
    assert beside == {"z": 9, "∧(z, z)": 3, "∧(z, z, z)": 3}


def test_too_many_patterns_are_an_error(spark):
    with pytest.raises(ValueError, match="more than 3 frequent"):
        M.frequent_patterns(trees_of(spark, "→(p, q, r, s)", 2), least=1, size=4, most_patterns=3)


def test_closed_and_maximal_by_brute_force(trees):
    """Of infixes and of chains: each against all larger ones."""
    for rows in (M.frequent_patterns(trees, least=4, size=6), M.frequent_chains(trees, least=6, size=3, longest=3)):
        got = M.closed_and_maximal(rows).collect()
        all_ = [(r.k, r.support, M.decode(r.pattern_json)) for r in got]
        all_ = [(k, s, (p,) if isinstance(p[0], str) else p) for k, s, p in all_]
        assert len(got) == rows.count()
        for r, (k, s, p) in zip(got, all_, strict=True):
            above = [x for x in all_ if x[0] > k and M.contains_chain(x[2], p)]
            assert (r.closed, r.maximal) == (not any(x[1] == s for x in above), not above), r.pattern
            assert all(x[1] <= s for x in above)


def test_contained_chains():
    parse = lambda raw: tuple(V.parse(x) for x in raw.split("..."))
    for larger, smaller, want in [
        ("→(p, q)...r", "p...r", True), ("→(p, q)...r", "q...r", True), ("→(p, q)...r", "r...p", False), ("→(p, q, r)", "p...r", True),
        ("→(p, q)", "p...q", False), ("p...q...r", "p...r", True), ("p...q...r", "→(p, q)", False), ("∧(p, q)...r", "q...r", True), ("∧(p, q)", "p...q", False),
    ]:
        assert M.contains_chain(parse(larger), parse(smaller)) == want, (larger, smaller)


def test_completeness_of_nested_sequences():
    tree = V.parse("→(k, ∧(→(l, m, n), o), p)")
    has = lambda raw: bool(M.occurrences(tree, V.parse(raw)))
    assert has("→(k, ∧(→(l, m, n), o), p)") and has("∧(→(m, n), o)") and has("→(l, m)") and has("→(k, ∧(→(l, m), o))")
    assert not has("→(k, p)") and not has("→(k, ∧(→(m, n), o))") and not has("→(∧(→(l, m), o), p)") and has("→(∧(→(m, n), o), p)")


def test_repetitions():
    found = M.repetitions(V.parse("→(m, n, o, m, n, x)"))
    assert ("→(m, n)", (0,), (3,)) in found and not any(p == "m" for p, _, _ in found)
    assert M.repetitions(V.parse("→(m, n, o)")) == []


def test_chains_by_paths():
    """Pairs of labels in a tree by their paths: they follow if the lowest sequence above both has something of
    its own between them."""
    rng = random.Random(3)
    for _ in range(12):
        tree = V.canonical(random_tree(rng, 3))
        names = sorted(set(V.labels(tree)))
        got = M.chain_supports(tree, [V.leaf(x) for x in names], 2)
        paths = {}

        def walk(t, path, paths=paths):
            if t[0] == "leaf":
                paths[path] = t[1][0]
            else:
                for k, c in enumerate(t[1]):
                    walk(c, (*path, k))

        walk(tree, ())
        pairs = {}
        for p, q in itertools.permutations(paths, 2):
            d = next(i for i in range(9) if p[i] != q[i])
            node = tree
            for k in p[:d]:
                node = node[1][k]
            if node[0] == "follows" and q[d] - p[d] >= 2:
                pairs.setdefault((paths[p], paths[q]), []).append((p, q))
        want = {xy: min(len({p for p, _ in own}), len({q for _, q in own})) for xy, own in pairs.items()}
        assert {tuple(c[1][0] for c in chain): n for chain, n in got.items() if len(chain) == 2} == want


def random_tree(rng, depth):
    if depth == 0 or rng.random() < 0.3:
        return V.leaf(rng.choice("ghij"))
    return V.node(rng.choice(["follows", "follows", "parallel"]), *(random_tree(rng, depth - 1) for _ in range(rng.randrange(2, 5))))


def test_matched_nodes():
    tree = V.parse("→(m, n, ∧(p, o), m, n, n)")
    assert M.matched_nodes(tree, V.parse("→(m, n)")) == [{0, 1, 2}, {0, 6, 7}]
    assert M.matched_nodes(tree, V.parse("∧(o, p)")) == [] and M.matched_nodes(tree, V.parse("∧(p, o)")) == [{3, 4, 5}]
    assert M.matched_nodes(tree, V.parse("→(n, n)")) == [{0, 7, 8}]


def test_confidences(spark):
    names = ['x "1"', "y, [2]", "z"]
    leaf = [V.leaf(x) for x in names]
    rows = [((leaf[0],), 9), ((leaf[1],), 6), ((leaf[0], leaf[1]), 3)]
    table = spark.createDataFrame([(len(c), M.chain_text(c), n, M.encode(c)) for c, n in rows], "k int, pattern string, support long, pattern_json string")
    assert {r.k: r.confidence for r in M.confidences(table).where("k = 2 OR support = 9").collect()} == {1: None, 2: 0.33}
    grown = [(V.node("follows", *leaf[:2]), 8), (V.node("follows", *leaf), 4), (leaf[0], 9)]
    table = spark.createDataFrame([(M.n_nodes(p), V.text(p), n, M.encode(p)) for p, n in grown], "k int, pattern string, support long, pattern_json string")
    got = {M.decode(r.pattern_json): (r.parent_json and M.decode(r.parent_json), r.confidence) for r in M.growth_confidences(table).collect()}
    assert got == {grown[0][0]: (None, None), grown[1][0]: (grown[0][0], 0.5), leaf[0]: (None, None)}
