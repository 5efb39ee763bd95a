"""Discovery, incremental discovery with its deviation kinds, freezing and repair."""

import random
from collections import Counter

import pytest

from chronoweft.operators import discovery as D
from chronoweft.operators.alignment import Aligner
from chronoweft.plans import process_tree as P
from tests.core.helpers import instant, log_of


@pytest.mark.parametrize(
    ("traces", "tree"),
    [
        (["klm"], "->('k','l','m')"),
        (["klm", "kml"], "->('k',+('l','m'))"),
        (["kl", "km"], "->('k',X('l','m'))"),
        (["k", "klk", "klklk"], "*('k','l')"),
        (["kl", "l"], "->(X('k',tau),'l')"),
        (["kk", "k"], "*('k',tau)"),
    ],
)
def test_simple_models(traces, tree):
    assert P.canonical(D.mine(Counter(map(tuple, traces)))) == P.canonical(P.reduced(P.parse(tree)))


def random_traces(seed, n, labels="uvwxyz"):
    rng = random.Random(seed)
    return [tuple(rng.choice(labels) for _ in range(rng.randrange(1, 9))) for _ in range(n)]


def all_fit(tree, traces):
    aligner = Aligner(tree)
    return all(aligner.align(t).fits for t in traces)


@pytest.mark.parametrize("seed", range(6))
def test_mined_trees_fit_their_log(seed):
    traces = random_traces(seed, 10)
    assert all_fit(D.mine(Counter(traces)), traces)


@pytest.mark.parametrize("pull_down", [False, True])
@pytest.mark.parametrize("seed", range(3))
def test_incremental_discovery_keeps_earlier_traces(seed, pull_down):
    traces = random_traces(77 + seed, 8)
    tree, added = D.mine(Counter(traces[:1])), traces[:1]
    for t in traces[1:]:
        tree = D.add_trace(tree, added, t, pull_down=pull_down)
        added.append(t)
        assert all_fit(tree, added)


def test_a_deviation_changes_only_what_encloses_it():
    """Parts of the tree that a deviation doesn't touch stay as they are."""
    tree = P.parse("->('k', X('l', 'm'), +('n', 'o'), *('p', 'q'))")
    new = D.add_trace(tree, [tuple("klnop"), tuple("kmonpqp")], tuple("klnxop"))
    assert P.parse("X('l', 'm')") in P.nodes(new) and P.parse("*('p', 'q')") in P.nodes(new) and all_fit(new, [tuple("klnxop"), tuple("kmonpqp")])


def test_pulling_down_keeps_siblings():
    """Between two of five children of a sequence: without pulling down all five are discovered anew."""
    tree = P.parse("->('k', X('l', *('m', 'n')), 'o', 'p', X('q', 'r'))")
    added = [tuple("klopq"), tuple("kmnmopr")]
    new = D.add_trace(tree, added, tuple("kloxpq"), pull_down=True)
    assert all_fit(new, [*added, tuple("kloxpq"), tuple("kmopr"), tuple("kmnmnmopq")])
    assert P.parse("X('l', *('m', 'n'))") in P.nodes(new) and P.parse("X('q', 'r')") in P.nodes(new)


@pytest.mark.parametrize("trace", ["xklm", "klmx", "x", "", "lm", "kl", "mlk"])
def test_deviations_at_the_ends(trace):
    """Before the first activity, after the last, all of the trace, or none of it."""
    tree, added = P.parse("->('k', 'l', 'm')"), [tuple("klm")]
    new = D.add_trace(tree, added, tuple(trace))
    assert all_fit(new, [*added, tuple(trace)])
    assert not {"▶", "■"} & set(P.labels(new))


@pytest.mark.parametrize(("tag", "fragment"), [("PREFIX", "kx"), ("PREFIX", "kl"), ("POSTFIX", "xn"), ("POSTFIX", "mn"), ("PROPER_INFIX", "lxm"), ("PROPER_INFIX", "xy"), ("NOT_AN_INFIX", "kn")])
def test_typed_fragments_are_added(tag, fragment):
    """What was only seen in part fits in part, and earlier traces as before."""
    tree, added = P.parse("->('k', 'l', X('m', 'o'), 'n')"), [("NOT_AN_INFIX", tuple("klmn")), ("PROPER_INFIX", tuple("lo"))]
    new = D.add_typed(tree, added, (tag, tuple(fragment)))
    for own, t in [*added, (tag, tuple(fragment))]:
        assert Aligner(new, D.FRAGMENT_MODES[own]).align(t).fits, (own, t, P.text(new))


def test_naive_repair():
    tree = P.parse("->('k', 'l', 'm')")
    for trace in ("km", "klxm", "xklm", "klmy", ""):
        assert Aligner(D.repair_naively(tree, tuple(trace))).align(tuple(trace)).fits


def test_from_a_table(spark):
    log = log_of(spark, {0: instant("klm"), 1: instant("kml")})
    assert P.canonical(D.discover(log)) == P.parse("->('k', +('l', 'm'))")
    assert {(r.a, r.b, r.n) for r in D.directly_follows(log).collect()} == {(None, "k", 2), ("k", "l", 1), ("k", "m", 1), ("l", "m", 1), ("m", "l", 1), ("l", None, 1), ("m", None, 1)}
    empty = log.limit(0)
    assert D.discover(empty) == P.TAU and D.rebuild(empty) == P.TAU and D.directly_follows(empty).count() == 0


FROZEN = [
    ("->('k', X('l', 'm'), 'n')", [2], "kn", ["kln", "kmn"]),
    ("->('k', X('l', 'm'), 'n')", [2], "klmn", ["kln"]),
    ("->('k', +('l', 'm'), *('o', 'p'))", [2, 5], "kolmpo", ["klmo", "kmlopo"]),
    ("->('k', +('l', 'm'), 'n')", [2], "xy", ["klmn"]),
    ("->('k', *(->('l', 'm'), tau), 'n')", [2], "nlmk", ["klmn", "klmlmn"]),
    ("X(->('k', 'l'), ->('m', 'n'))", [1, 4], "klmn", ["kl", "mn"]),
]


@pytest.mark.parametrize(("raw", "frozen", "trace", "added"), FROZEN)
def test_frozen_parts_stay(raw, frozen, trace, added):
    """Every frozen part stands in the result just once, and all traces fit."""
    tree, added = P.parse(raw), [tuple(t) for t in added]
    new = D.add_trace_frozen(tree, added, tuple(trace), frozen)
    for n in frozen:
        assert P.nodes(new).count(P.nodes(tree)[n]) == 1, P.text(new)
    assert all_fit(new, [*added, tuple(trace)]), P.text(new)
    assert not any("⟨" in x for x in P.labels(new))


@pytest.mark.parametrize("seed", range(6))
def test_frozen_parts_stay_over_random_traces(seed):
    tree = P.parse("->('u', X('v', ->('w', 'x')), +('y', 'z'))")
    kept = [P.nodes(tree)[2], P.nodes(tree)[7]]
    added = [tuple("uvyz"), tuple("uwxzy")]
    for t in random_traces(200 + seed, 4):
        numbers = [P.nodes(tree).index(k) for k in kept]
        tree = D.add_trace_frozen(tree, added, t, numbers)
        added.append(t)
        assert all_fit(tree, added) and all(P.nodes(tree).count(k) == 1 for k in kept), P.text(tree)


@pytest.mark.parametrize(("counts", "want"), [((1, 1), "%s"), ((0, 1), "X(tau, %s)"), ((1, 3), "*(%s, tau)"), ((0, 2), "X(tau, *(%s, tau))")])
def test_put_back_by_how_often_it_ran(counts, want):
    part = P.parse("X('l', 'm')")
    assert D.by_cardinality(part, Counter(counts)) == P.parse(want % P.text(part))


@pytest.mark.parametrize("seed", range(5))
def test_repaired_trees_fit(seed):
    tree = P.parse("->('u', X('v', 'w'), +('x', 'y'))")
    log = Counter(random_traces(40 + seed, 8))
    assert all_fit(D.repair(tree, log), log)


def test_repair_groups_and_drops():
    """Sub-traces meet whose labels overlap by half, also through others."""
    groups = D.similar_groups(Counter({tuple(t): 1 for t in ("pqrs", "rs", "st", "xy", "yx", "z")}))
    assert {frozenset("".join(t) for t in g) for g in groups} == {frozenset(["pqrs", "rs"]), frozenset(["st"]), frozenset(["xy", "yx"]), frozenset(["z"])}
    tree = P.parse("->('k', +('l', X('m', 'n')))")
    small = D.repair(tree, Counter({tuple("klm"): 9, tuple("kln"): 1}), drop_at_most=1)
    assert "n" not in P.labels(small) and all_fit(small, ["klm", "kml"])
