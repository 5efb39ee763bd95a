"""Trees of whole logs cut in arrays, against those of each case's signature, and what mining remembers."""

import itertools
import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F

from chronoweft import session
from chronoweft.operators import mining as M
from chronoweft.operators import variants
from chronoweft.plans import variant_tree as V
from tests.core.helpers import LOG, ODD_LABELS, ORIGIN, instant, log_of, random_cases


def _counts(df):
    return sorted(map(tuple, df.select("variant_json", "n_cases").collect()))


@pytest.fixture(scope="module")
def log(spark):
    cases = random_cases(400, 8, ["u", "v", *ODD_LABELS], 12, 25, 5)
    cases |= {1000 + i: e for i, e in random_cases(200, 9, "uv", 9, 6, 6).items()}
    cases |= {2000: instant("uvw" * 300), 2001: [("u", 0, 500), *instant("vw" * 200)]}
    return log_of(spark, cases).cache()


@pytest.mark.parametrize("granularity", ["ms", "day"])
def test_trees_cut_at_once_are_those_of_signatures(log, granularity):
    assert _counts(variants.trees(log, granularity)) == _counts(variants.variants(log, granularity))


def test_cases_stay_whole_in_any_batches(monkeypatch):
    rng = random.Random(2)
    rows = [(k, rng.choice("uvw"), s, s + rng.randrange(4)) for _, e in random_cases(60).items() for k, (_, s, _) in enumerate(sorted(e, key=lambda x: x[1]), 1)]
    known = variants.parts_known()
    expected = Counter()
    for i, j in itertools.pairwise([*(i for i, r in enumerate(rows) if r[0] == 1), len(rows)]):
        own = sorted(rows[i:j], key=lambda r: (r[2], rng.random()))
        expected[V.to_json(V.variant_of([r[1] for r in own], [r[2] for r in own], [r[3] for r in own]))] += 1
        rows[i:j] = [(k, *r[1:]) for k, r in enumerate(own, 1)]
    table = pa.table(list(zip(*rows, strict=True)), ["k", "activity", "s", "t"])
    for together, size in ((1, 1), (1, 7), (10, 3), (10, 50), (50_000, 7)):
        monkeypatch.setattr(variants, "TOGETHER", together)
        chunks = list(variants._whole_cases(iter(table.to_batches(max_chunksize=size))))
        assert pa.concat_tables(chunks).equals(table) and all(c.num_rows and c.column(0)[0].as_py() == 1 for c in chunks)
        got = Counter()
        for c in chunks:
            for raw, n in variants._cut_chunk(c, known):
                got[raw] += n
        assert got == expected, (together, size)
        assert together > 10 or len(chunks) > 10 or size == 50


def test_cases_named_by_texts(log):
    named = log.withColumn("case_id", F.concat(F.lit("c"), "case_id"))
    assert _counts(variants.trees(named)) == _counts(variants.variants(named))


def test_what_was_dealt_by_cases_stays_where_it_is(log):
    for df, more in ((log, 1), (log.repartition(5, "case_id"), 0), (log.repartition(5, "activity"), 1), (log.repartition(5, "case_id").withColumn("case_id", F.col("case_id") + 1), 1)):
        near = session.together(df, "case_id")
        assert (near is df) == (more == 0)
        assert near.select("case_id", F.spark_partition_id().alias("p")).distinct().count() == df.select("case_id").distinct().count()
    null = log.withColumn("case_id", F.when(F.col("case_id") % 50 != 0, F.col("case_id"))).withColumn("pos", F.row_number().over(variants.Window.partitionBy("case_id").orderBy("start_ts", "pos")))
    assert _counts(variants.trees(null)) == _counts(variants.variants(null))


def test_cases_with_ends_before_starts(spark, log):
    """There the order of equal starts counts, which is the log's."""
    hour = lambda k: ORIGIN.replace(hour=k)
    rows = [(None, 1, "u", hour(5), hour(3)), (None, 2, "v", hour(5), hour(6)), (-2, 1, "v", hour(5), hour(6)), (-2, 2, "u", hour(5), hour(3)), (-3, 1, "v", hour(5), hour(6)), (-3, 2, "u", hour(5), hour(6))]
    more = log.unionByName(spark.createDataFrame(rows, LOG))
    got = _counts(variants.trees(more))
    assert got == _counts(variants.variants(more))
    assert sum(n for _, n in got) == log.select("case_id").distinct().count() + 3
    assert _counts(variants.trees(log.where("false"))) == []


def test_a_level_has_tasks_by_what_runs_at_once(spark):
    """However many partitions the variants have."""
    tree = V.node("follows", V.leaf("u"), V.leaf("v"))
    trees = spark.createDataFrame([(V.to_json(tree), n) for n in range(1, 101)], "variant_json string, n_cases long").repartition(90)
    with M.kept(trees) as own:
        tasks = M._level(own, "TraceTransaction", 1, lambda: lambda t: {V.leaf(str(TaskContext.get().partitionId())): 1}, 100)
        assert len(tasks) == M.TASKS * spark.sparkContext.defaultParallelism < 90
        assert M._level(own, "TraceTransaction", 1, lambda: M.Patterns(1).of_size, 10) == {V.leaf("u"): 5050, V.leaf("v"): 5050}


def test_json_of_parts():
    tree = V.node("parallel", V.leaf('a "b"', "c\\d"), V.node("follows", V.leaf("é"), V.node("parallel", V.leaf("x"), V.leaf("y, [1]"))))
    assert variants._json(tree) == V.to_json(tree)


def test_distinct_rows_of_many_columns():
    rng = random.Random(1)
    rows = variants.np.array([[rng.randrange(1 + 40_000 * (k % 3 == 0)) for k in range(9)] for _ in range(40)] * 3)
    first, number = variants._numbered(rows)
    assert len(first) == len({tuple(r) for r in rows.tolist()}) and (rows[first][number] == rows).all()


def test_what_orders_places_is_not_read(log):
    more = log.withColumn("extra", F.rand()).withColumn("pos", F.row_number().over(variants.Window.partitionBy("case_id").orderBy("start_ts", "extra")))
    plan = variants.trees(more)._jdf.queryExecution().optimizedPlan().toString()
    assert "extra" not in plan and "collect_list" not in plan


def test_what_variants_share_is_matched_once(monkeypatch):
    """Variants of the same parts cost a task no new products; what it remembers is bounded and alters nothing."""
    parts = [V.parse(x) for x in ("u", "v", "∧(u, v)", "∧(→(u, v), w)")]
    trees = [V.node("follows", *x) for x in itertools.product(parts, repeat=5)]
    calls = []
    monkeypatch.setattr(M, "product", lambda *a: calls.append(1) or itertools.product(*a))
    shared = M.Patterns(5)
    got = [shared.of_size(t) for t in trees]
    assert len(calls) < len(trees) / 2
    inner = lambda t: [t] if t[0] == "leaf" else [t, *(x for c in t[1] for x in inner(c))]
    expected = [Counter(p for x in inner(t) for p in M.patterns_at(x, 5) if M.n_nodes(p) == 5) for t in trees[::37]]
    assert got[::37] == expected
    monkeypatch.setattr(M, "HELD", 20)
    small = M.Patterns(5)
    assert [small.of_size(t) for t in trees[:200]] == got[:200]


def test_a_task_adds_up_its_variants(spark, monkeypatch):
    """A pattern of many variants leaves a task once; passing sums on early alters nothing."""
    raw = [V.to_json(V.node("follows", *map(V.leaf, x))) for x in itertools.product("uvw", repeat=4)]
    trees = spark.createDataFrame([(r, 2) for r in raw], "variant_json string, n_cases long").coalesce(1)
    expected = {"u": 2 * (81 - 16), "→(u, v)": 2 * (3 * 9 - 1)}
    made = []
    monkeypatch.setattr(M, "_found", lambda trees, found: made.append(found))
    M.frequent_patterns(trees, least=1, size=3)
    with M.kept(trees) as own:
        for held in (1, M.HELD):
            monkeypatch.setattr(M, "HELD", held)
            level = M._level(own, "TraceTransaction", 1, lambda: M.Patterns(3, frozenset(map(V.leaf, "uvw"))).of_size, 100)
            assert level == {p: n for p, n in made[0].items() if p[0] != "leaf"}
    assert {V.text(p): n for p, n in made[0].items() if V.text(p) in expected} == expected
