"""Relations, borders and the query language: on a few cases by hand, and on random ones against brute force.

Random queries are made together with a function that says which cases they hold for; it knows nothing of the
parser or of Spark."""

import random

import pytest

from chronoweft.operators import relations as R
from chronoweft.plans import vql
from tests.core.helpers import ODD_LABELS, borders_of, in_order, instant, log_of, random_cases, relations_of

SHOP = {
    # pick, then pack and label at once, then ship
    1: [("pick", 0, 2), ("pack", 3, 6), ("label", 4, 5), ("ship", 8, 9)],
    # two picks that overlap, and no label
    2: [("pick", 0, 3), ("pick", 1, 4), ("pack", 6, 7), ("ship", 9, 9)],
    # a return in parallel to everything else
    3: [("return", 0, 20), ("pick", 1, 2), ("ship", 5, 6)],
    # one activity only
    4: [("cancel", 0, 1)],
    # shipped twice
    5: [("pick", 0, 1), ("ship", 2, 3), ("pack", 4, 5), ("ship", 6, 7)],
}
BY_HAND = {
    "'pick' isDF 'pack';": {1, 2},
    "'pick' isEF 'ship';": {1, 2, 3, 5},
    "'pack' isDF 'ship';": {1, 2, 5},
    "'pack' isP 'label';": {1},
    "'pick' isP 'pick';": {2},  # parallel holds both ways, so both picks are met
    "'return' isP ALL {'pick', 'ship'};": {3},
    "'ship' isC = 2;": {5},
    "'ship' isEnd AND NOT ('return' isC);": {1, 2, 5},
    "'cancel' isStart -> 'pick' isC;": {1, 2, 3, 5},
    "ANY {'cancel', 'return'} isS;": {3, 4},
    "~ ANY {'pick', 'pack', 'label', 'ship'} isC;": {3, 4},
    "'pick' isDF 'ship' = 1;": {3, 5},
}


@pytest.mark.parametrize("text", BY_HAND)
def test_queries_by_hand(spark, text):
    got = {r.case_id for r in vql.query_cases(log_of(spark, SHOP), text).collect()}
    assert got == BY_HAND[text]


def graph_of(events):
    e = in_order(events)
    ef, df, par = relations_of(events)
    starts, ends = borders_of(events)
    met = {"isEF": ef, "isDF": df, "isP": par | {(j, i) for i, j in par}}
    own = {"isC": set(range(len(e))), "isS": starts, "isE": ends}
    return [x[0] for x in e], own, met


class Asked:
    """A random query: its text, and whether it holds for a case."""

    OPS = {"=": lambda a, b: a == b, "<": lambda a, b: a < b, ">": lambda a, b: a > b}

    def __init__(self, seed, labels):
        self.rng, self.labels = random.Random(seed), labels

    def gap(self):
        return self.rng.choice(["", " ", "  "])

    def group(self, single):
        if single or self.rng.random() < 0.5:
            name = self.rng.choice(self.labels)
            return f"'{name}'", [name], False
        names = self.rng.sample(self.labels, self.rng.randrange(1, 4))
        word, outside = self.rng.choice(["ANY", "ALL"]), self.rng.random() < 0.2
        inner = f",{self.gap()}".join(f"'{x}'" for x in names)
        return f"{'~ ' if outside else ''}{word} {{{inner}}}", [x for x in self.labels if x not in names] if outside else names, word == "ALL"

    def leaf(self):
        op, n = (self.rng.choice("=<>"), self.rng.randrange(3)) if self.rng.random() < 0.4 else (None, 0)
        tail = f" {op} {n}" if op else ""
        if self.rng.random() < 0.4:
            text, names, every = self.group(False)
            kind = self.rng.choice(["isC", "isS", "isE"])

            def unary(graph):
                acts, own, _ = graph
                counts = [sum(acts[i] == a for i in own[kind]) for a in names]
                return (all if every else any)([self.OPS[op](c, n) if op else c > 0 for c in counts])

            return f"{text} {kind}{tail}", unary
        grouped = self.rng.random() < 0.6
        on_left = grouped and self.rng.random() < 0.5
        left_text, left, left_all = self.group(not on_left)
        right_text, right, right_all = self.group(not grouped or on_left)
        kind = self.rng.choice(["isEF", "isDF", "isP"])

        def binary(graph):
            acts, _, met = graph
            covered = lambda a, b: {i for i, j in met[kind] if acts[i] == a and acts[j] == b}
            own = lambda a: acts.count(a)
            every = left_all or right_all
            if op and len(right) > 1:
                join = set.intersection if right_all else set.union
                return all(self.OPS[op](len(join(*(covered(a, b) for b in right))), n) for a in left)
            if op:
                return (all if every else any)([self.OPS[op](len(covered(a, b)), n) for a in left for b in right])
            if len(right) > 1 and not every:
                return any(own(a) and len(set.union(*(covered(a, b) for b in right))) == own(a) for a in left)
            return (all if every else any)([bool(own(a) and own(b)) and len(covered(a, b)) == own(a) for a in left for b in right])

        return f"{left_text} {kind} {right_text}{tail}", binary

    def expression(self, depth):
        kind = self.rng.choice(["leaf", "AND", "OR", "->"]) if depth else "leaf"
        if kind == "leaf":
            return self.leaf()
        parts = [self.negated(depth - 1) for _ in range(2 if kind == "->" else self.rng.randrange(2, 4))]
        text = f" {kind} ".join(p[0] for p in parts)
        if kind == "->":
            return text, lambda g: not parts[0][1](g) or parts[1][1](g)
        return text, lambda g: (all if kind == "AND" else any)([f(g) for _, f in parts])

    def negated(self, depth):
        if self.rng.random() < 0.25:
            text, f = self.expression(depth)
            return f"NOT{self.gap()}({text})", lambda g: not f(g)
        if depth and self.rng.random() < 0.5:
            text, f = self.expression(depth)
            if " AND " in text or " OR " in text or "->" in text:
                return f"({text})", f
        return self.leaf()

    def query(self):
        text, f = self.expression(2)
        return f"{self.gap()}{text}{self.gap()};", f


def test_random_queries_by_brute_force(spark):
    """Over stored graphs for many queries at once, and each by its own aggregation for some."""
    cases = random_cases(50, 7, ODD_LABELS, 8)
    log = log_of(spark, cases)
    graphs = {c: graph_of(e) for c, e in cases.items()}
    universe = vql.universe_of(log)
    assert universe == set(ODD_LABELS)
    asked = [Asked(seed, ODD_LABELS).query() for seed in range(150)]
    columns = [vql.compile_query(vql.parse(text), universe).alias(f"q{i}") for i, (text, _) in enumerate(asked)]
    for row in R.case_graphs(log).select("case_id", *columns).collect():
        for i, (text, holds) in enumerate(asked):
            assert row[f"q{i}"] == holds(graphs[row.case_id]), (text, cases[row.case_id])
    log.cache()
    for text, holds in asked[:30]:
        assert {r.case_id for r in vql.query_cases(log, text).collect()} == {c for c, g in graphs.items() if holds(g)}, text


def test_a_query_computes_what_it_names(spark):
    plan = lambda text: vql.query_cases(log_of(spark, SHOP), text)._jdf.queryExecution().optimizedPlan().toString()
    contained = plan("'pick' isC AND NOT (ANY {'ship', 'pack'} isC > 1);")
    assert "Join" not in contained and "Window" not in contained and contained.count("Aggregate") == 1
    for text in ("'pick' isEF 'ship';", "'pick' isDF ANY {'ship', 'pack'};", "'pick' isP 'pack' > 1;"):
        assert "Join" not in plan(text)


def test_parser_takes_what_the_grammar_gives():
    for seed in range(300):
        vql.parse(Asked(seed, ODD_LABELS).query()[0])
    vql.parse("'p' isContained; 'q' isEventuallyFollowed 'r';")


def test_parser_refuses():
    rng = random.Random(5)
    for seed in range(100):
        text = Asked(seed, ["k", "l", "m", "n"]).query()[0]
        at = rng.choice([i for i, c in enumerate(text) if c in " ;"])
        for sign in ("#", "&&", "%", "?", "isBefore", "''"):
            with pytest.raises(vql.LexerError):
                vql.parse(f"{text[:at]} {sign} {text[at:]}")
        for broken in (text.replace(";", ""), "NOT " + text, text + " AND", "(" + text, text.replace(";", ");"), text.replace(";", " 'k';")):
            with pytest.raises(vql.ParseError):
                vql.parse(broken if broken != "NOT " + text else "NOT NOT (" + text.replace(";", "") + ");")
    for text in ("ANY {'k', 'l'} isP ANY {'m', 'n'};", "ANY {} isS;", "('k' isE);", "'k' isS AND 'l' isS OR 'm' isS;", "'k' isC -> 'l' isC -> 'm' isC;", "'k' = 2;", "'k' isC > ;", "~'k' isC;"):
        with pytest.raises(vql.ParseError):
            vql.parse(text)


def test_relations_by_brute_force(spark):
    cases = random_cases(80, 3)
    log = log_of(spark, cases)
    got = {(r.case_id, r.a_pos, r.b_pos): (r.ef, r.df, r.a, r.b) for r in R.pairs(log).collect()}
    marks = {(r.case_id, r.pos): (r.is_start, r.is_end) for r in R.borders(log).collect()}
    strict = {(r.case_id, r.pos): r.is_start for r in R.borders(log, strict_start=True).collect()}
    rows = {kind: {(r.case_id, *sorted((r.a_pos, r.b_pos))) for r in R.related(log, kind).collect()} for kind in R.RELATIONS}
    for case, events in cases.items():
        e = in_order(events)
        ef, df, par = relations_of(events)
        starts, ends = borders_of(events)
        for i in range(len(e)):
            for j in range(i + 1, len(e)):
                assert got.pop((case, i + 1, j + 1)) == ((i, j) in ef, (i, j) in df, e[i][0], e[j][0])
            assert marks[case, i + 1] == (i in starts, i in ends)
            assert strict[case, i + 1] == (not any(b == i for _, b in ef))
        for kind, want in (("EF", ef), ("DF", df), ("P", par)):
            assert {x[1:] for x in rows[kind] if x[0] == case} == {(i + 1, j + 1) for i, j in want}
    assert not got


def test_counts_with_weights(spark):
    cases = random_cases(30, 9)
    log = log_of(spark, cases)
    weights = spark.createDataFrame([(c, 1 + c % 3) for c in cases], "case_id int, weight int")
    for occurrences in (True, False):
        want = {}
        for c, events in cases.items():
            e = in_order(events)
            own = [(e[i][0], e[j][0]) for i, j in relations_of(events)[0]]
            for pair in own if occurrences else set(own):
                want[pair] = want.get(pair, 0) + 1 + c % 3
        assert {(r.a, r.b): r.support for r in R.relation_counts(log, "EF", occurrences=occurrences, weights=weights).collect()} == want


def test_a_long_case(spark):
    """One case of 100,000 events: what follows directly is found without pairing them."""
    from pyspark.sql import functions as F

    n = 100_000
    at = F.timestamp_seconds(F.col("id")).cast("timestamp_ntz")
    log = spark.range(n).select(F.lit(1).alias("case_id"), (F.col("id") + 1).cast("int").alias("pos"), F.concat(F.lit("x"), F.col("id") % 5).alias("activity"), at.alias("start_ts"), at.alias("end_ts"))
    assert {(r.a, r.b): r.support for r in R.relation_counts(log, "DF").collect()} == {(f"x{k}", f"x{(k + 1) % 5}"): n // 5 - (k == 4) for k in range(5)}
    assert R.borders(log).where("is_start OR is_end").count() == 2
    assert vql.query_cases(log, "'x1' isDF 'x2' AND NOT ('x1' isP 'x2') AND 'x0' isEF 'x4';").count() == 1


def test_instants_at_one_time_are_parallel(spark):
    log = log_of(spark, {1: [("u", 0, 0), ("v", 0, 0), ("w", 1, 1)], 2: instant("uvw")})
    assert {(r.case_id, r.a, r.b) for r in R.related(log, "P").collect()} == {(1, "u", "v")}
    assert {(r.case_id, r.a, r.b) for r in R.related(log, "DF").collect()} == {(1, "u", "w"), (1, "v", "w"), (2, "u", "v"), (2, "v", "w")}


def test_no_pair_of_rows_meets_on_the_case_alone(spark):
    plan = R.relation_counts(log_of(spark, SHOP), "DF")._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "b_pos" in plan.split("Join", 1)[1].split("\n", 1)[0]
