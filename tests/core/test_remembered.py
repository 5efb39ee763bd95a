"""What Python remembers of signatures, and the trees that it makes of them."""

import random

from chronoweft.operators import performance, variants
from chronoweft.plans import variant_tree as V
from tests.core.helpers import log_of, random_cases


def _rows(df):
    return sorted(map(tuple, df.collect()))


def test_what_is_remembered_of_signatures_is_bounded(monkeypatch):
    monkeypatch.setattr(variants, "CACHED", 40)
    known = variants.Known(lambda acts, s, t: (V.variant_of(acts, s, t), len(acts)))
    for n in (*range(1, 60), *range(1, 60)):
        names = [f"x{i}" for i in range(n)]
        assert V.labels(known.get(names, list(range(n)), list(range(n)))) == names
        assert sum(len(acts) for acts, _, _ in known.of) == known.held <= 40


def test_nodes_of_many_slices(spark, monkeypatch):
    """Cases of several slices and of caches that are emptied have the same nodes."""
    log = log_of(spark, random_cases(120, seed=3))
    expected = _rows(performance.node_times(log).select("case_id", "node", "label", "variant", "start_ts", "end_ts"))
    slices = variants.in_slices

    def small(batches):
        for b in slices(batches):
            yield from (b.slice(i, 7) for i in range(0, b.num_rows, 7))

    monkeypatch.setattr(performance, "in_slices", small)
    assert _rows(performance.node_times(log).select("case_id", "node", "label", "variant", "start_ts", "end_ts")) == expected


def _tree(names, s, t):
    ef, par = V.relations(s, t)
    return V.canonical(V.cut(list(range(len(names))), names, ef, par))


def test_trees_from_times_are_those_from_relations():
    rng = random.Random(5)
    for k in range(3000):
        n, width = rng.randrange(1, 12), rng.choice([3, 8, 30])
        s = [rng.randrange(width) for _ in range(n)]
        s = s if k % 9 == 0 else sorted(s)
        t = [x + rng.randrange(-1 if k % 11 == 0 else 0, rng.choice([2, width])) for x in s]
        names = [rng.choice("uvw") for _ in s]
        assert V.variant_of(names, s, t) == _tree(names, s, t)


def test_a_tree_of_a_long_case_needs_no_pairs():
    n = 200_000
    tree = V.variant_of(["x"] * n, list(range(1, n + 1)), [i + i % 2 for i in range(1, n + 1)])
    assert tree[0] == "follows" and len(tree[1]) == n // 2
