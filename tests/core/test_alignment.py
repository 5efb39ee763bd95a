"""Alignments against enumerated languages of small models, and what is computed from them."""

import itertools

import pytest
from pyspark.sql import functions as F

from chronoweft.operators import alignment as A
from chronoweft.plans import process_tree as P
from tests.core.helpers import instant, log_of

MODELS = ["->('k', X('l', tau), +('m', 'k'))", "*(->('k', 'l'), 'm')", "X(->('k', 'l', 'm'), +('l', 'm'))", "->('k', *(X('l', 'm'), tau))", "+('k', *('l', 'm'))"]


def words(raw, loops=3):
    return {"".join(t) for t in P.language(P.parse(raw), loops)}


@pytest.mark.parametrize("mode", A.MODES)
@pytest.mark.parametrize("raw", MODELS)
def test_fits_by_enumeration(raw, mode):
    """All traces of up to four activities: they fit just if they are, begin, lie in or end a word of the model."""
    language = words(raw)
    part_of = {"full": lambda t: t in language, "prefix": lambda t: any(w.startswith(t) for w in language), "infix": lambda t: any(t in w for w in language), "suffix": lambda t: any(w.endswith(t) for w in language)}[mode]
    aligner = A.Aligner(P.parse(raw), mode)
    for n in range(5):
        for trace in map("".join, itertools.product("klm", repeat=n)):
            assert aligner.align(trace).fits == part_of(trace), trace


@pytest.mark.parametrize("raw", [*MODELS, "->('m', *(->('k', X('l', tau)), tau), +('m', 'l'))"])
def test_infixes_in_their_part_of_the_tree(raw):
    """What an infix costs in its part of the tree is what it costs in the whole; moves name the whole's nodes."""
    tree = P.parse(raw)
    scoped, whole = A.InfixAligner(tree), A.Aligner(tree, "infix")
    for n in range(5):
        for trace in map("".join, itertools.product("klmx", repeat=n)):
            found = scoped.align(trace)
            assert found.cost // A.DEVIATION == whole.align(trace).cost // A.DEVIATION, trace
            assert all(P.nodes(tree)[m.node] == P.act(m.activity) for m in found.moves if m.kind in (A.SYNC, A.MODEL))
    tree = P.parse("->('a', +('b', 'c'), *('d', X('e', 'f')), 'g')")
    assert [P.text(P.nodes(tree)[A.InfixAligner(tree).scope(set(x))]) for x in ("b", "bc", "e", "cg")] == ["'b'", "+('b', 'c')", "*('d', X('e', 'f'))", P.text(tree)]


def least_changes(tree, trace):
    """Least number of insertions and deletions to a trace of the language."""

    def distance(x, y):
        row = list(range(len(y) + 1))
        for i, a in enumerate(x, 1):
            new = [i]
            for j, b in enumerate(y, 1):
                new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] if a == b else 99))
            row = new
        return row[-1]

    return min(distance(trace, t) for t in P.language(tree, 2))


@pytest.mark.parametrize("raw", MODELS)
def test_costs_by_enumeration(raw):
    t = P.parse(raw)
    aligner = A.Aligner(t)
    for n in range(4):
        for trace in itertools.product("klx", repeat=n):
            assert aligner.align(trace).cost // A.DEVIATION == least_changes(t, trace)


def test_alignments_without_silent_moves(spark):
    """The two ways through a choice of one activity or none look alike once silent moves are left out."""
    rows = [(["k"], 3), (["k", "x"], 2), (["x", "k"], 1)]
    aligned = A.align_sequences(spark.createDataFrame(rows, "acts array<string>, n_cases long"), P.parse("->('k', X(tau, *('l', tau)))"))
    got = {tuple((m.kind, m.activity) for m in r.visible): (r.n_cases, r.n_sequences) for r in A.distinct_alignments(aligned).collect()}
    assert got == {(("sync", "k"),): (3, 1), (("sync", "k"), ("log", "x")): (2, 1), (("log", "x"), ("sync", "k")): (1, 1)}


def test_table(spark):
    log = log_of(spark, {0: instant("pq"), 1: instant("pq"), 2: instant("q")})
    rows = {tuple(r.acts): r for r in A.align_log(log, P.parse("->('p','q')")).collect()}
    assert rows["p", "q"].cost < A.DEVIATION and rows["p", "q"].n_cases == 2 and rows["p", "q"].fitness == 1
    assert rows["q",].cost // A.DEVIATION == 1 and abs(rows["q",].fitness - (1 - 1 / 3)) < 1e-9
    assert A.f_measure(log, P.parse("->('p','q')")) > 0.8
    assert abs(A.mean_fitness(A.align_log(log, P.parse("->('p','q')"))) - (2 + 2 / 3) / 3) < 1e-9


def test_moves_on_tables(spark):
    rows = [(["k", "m"], 3), (["x", "k", "l", "m"], 2), (["k", "l"], 1)]
    aligned = A.align_sequences(spark.createDataFrame(rows, "acts array<string>, n_cases long"), P.parse("->('k', 'l', 'm')")).select("*", A.first_deviation().alias("at"), F.transform(A.moves_of_kind(A.SYNC), lambda m: m["activity"]).alias("sync"))
    visible = {"".join(r.acts): [m.kind for m in r.moves] for r in aligned.collect()}
    for r in aligned.collect():
        kinds = visible["".join(r.acts)]
        assert r["at"] == 1 + min(i for i, k in enumerate(kinds) if k in (A.LOG, A.MODEL))
        assert r.sync == [a for a in "klm" if a in r.acts]
    assert {(r.activity, r.kind): (r.n, r.cost) for r in A.deviation_costs(aligned).collect()} == {("l", "model"): (3, 3 / 4), ("x", "log"): (2, 1.0), ("m", "model"): (1, 3 / 2)}


def test_searches_given_up_are_reported(spark):
    log = log_of(spark, {0: instant("pq"), 1: instant("qpqpqp"), 2: instant("qpqpqp")})
    tree = P.parse("+(*('p', tau), *('q', tau))")
    enough = A.Aligner(tree).align("pq").visited
    rows = A.align_log(log, tree, most_states=enough)
    assert A.given_up(rows) == 2
    with pytest.raises(ValueError, match="given up"):
        A.f_measure(log, tree, most_states=enough)


def test_reduction_keeps_the_language():
    for raw in ("->('k', ->('l', tau), X(tau, *(tau, 'm')))", "X('k', X('l', 'k'), tau)", "*(*('k', tau), tau)", "+(tau, +('k', 'l'))", "->(tau, tau)"):
        t = P.parse(raw)
        assert set(P.language(P.reduced(t), 4)) >= set(P.language(t, 1))
        assert P.size(P.reduced(t)) <= P.size(t)
        assert P.parse(P.text(t)) == t
    kept = P.parse("->('l', 'm')")
    assert P.reduced(P.parse("->('k', ->('l', 'm'), ->('n', tau))"), frozenset([kept])) == P.parse("->('k', ->('l', 'm'), 'n')")
    assert P.reduced(P.parse("->('k', ->('l', 'm'))")) == P.parse("->('k', 'l', 'm')")
    assert P.common_ancestor(P.parse("->('k', +('l', 'm'), 'n')"), [3, 4]) == 2


def test_completed_fragments():
    tree = P.parse("->('k', X('l', +('m', 'n')), 'o', 'p')")
    aligner = A.Aligner(tree, "infix")
    language = words("->('k', X('l', +('m', 'n')), 'o', 'p')")
    for fragment in ("l", "no", "mno", "", "klop", "lo"):
        whole = A.completed(aligner, tuple(fragment))
        assert "".join(whole) in language and fragment in "".join(whole)


def test_typed_fragments(spark):
    model = "->('k', X('l', 'm'), 'n')"
    language = words(model)
    checks = {"NOT_AN_INFIX": lambda t: t in language, "PREFIX": lambda t: any(w.startswith(t) for w in language), "PROPER_INFIX": lambda t: any(t in w for w in language), "POSTFIX": lambda t: any(w.endswith(t) for w in language)}
    rows = [(tag, list(t)) for tag in checks for t in ("kln", "k", "kl", "ln", "m", "n", "lm")]
    got = A.align_typed(spark.createDataFrame(rows, "infix_type string, acts array<string>"), P.parse(model)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.cost < A.DEVIATION) == checks[r.infix_type]("".join(r.acts)), r


def test_projection_with_time_skips(spark):
    from chronoweft.operators import projection

    log = log_of(spark, {0: [("p", 0, 1), ("x", 2, 3), ("q", 4, 5), ("y", 4, 9), ("r", 6, 7), ("z", 8, 9)]})
    assert [r.activity for r in projection.project_with_time_skips(log, ["p", "q", "r"]).orderBy("pos").collect()] == ["p", "...", "q", "r"]
    assert [r.activity for r in projection.project_with_skips(log, ["p", "q", "r"]).orderBy("pos").collect()] == ["p", "...", "q", "...", "r"]


def test_nets():
    """A net's places, transitions and language survive PNML; sizes and kinds are those of the tree."""
    from chronoweft.plans import petri_net as N

    for raw in MODELS:
        net = N.net_of(P.parse(raw))
        again = N.from_pnml(N.to_pnml(net))
        assert again.n_places == net.n_places and len(again.transitions) == len(net.transitions)
        assert {m for m in N.words(again, 4)} == {m for m in N.words(net, 4)} == {t for t in map("".join, P.language(P.parse(raw), 3)) if len(t) <= 4}
    net = N.net_of(P.parse(MODELS[0]))
    silent = [t for t in net.transitions if t.label is None]
    assert N.labels(net) == {"k", "l", "m"} and len(silent) == len(net.transitions) - 4
    assert N.by_label(net, "k") == [i for i, t in enumerate(net.transitions) if t.label == "k"] and N.by_label(net, "zz") == []
    (source,), (sink,) = net.initial, net.final
    paths = list(N.simple_paths(net, source, sink))
    assert N.distances(net, source)[sink] == min(map(len, paths)) and all(len(set(x)) == len(x) for x in paths)
    assert source not in N.distances(net, sink)
    pruned = N.without_dead_parts(N.from_pnml(N.to_pnml(net, extra_place=True)))
    assert pruned.n_places == net.n_places


def test_pnml_files(spark, tmp_path):
    from chronoweft.plans import petri_net as N
    from chronoweft.sources import logs

    for i, raw in enumerate(MODELS):
        (tmp_path / f"m{i}.pnml").write_text(N.to_pnml(N.net_of(P.parse(raw))))
    (tmp_path / "notes.txt").write_text("not a net")
    rows = {r.path.rsplit("/", 1)[1]: r for r in logs.read_pnml(spark, str(tmp_path)).collect()}
    assert sorted(rows) == [f"m{i}.pnml" for i in range(len(MODELS))]
    for i, raw in enumerate(MODELS):
        net, r = N.net_of(P.parse(raw)), rows[f"m{i}.pnml"]
        assert (r.n_places, len(r.transitions)) == (net.n_places, len(net.transitions))
        assert sorted(t.label or "" for t in r.transitions) == sorted(t.label or "" for t in net.transitions)
        assert {m for m in N.words(N.from_row(r), 3)} == {m for m in N.words(net, 3)}
