import random
import re

import numpy as np
import pytest

from chronoweft.llm import ngram_join as N
from tests.llm.helpers import docs_of, prose, some_corpus, with_clashes


def sets_of(texts):
    out = {}
    for i, t in texts.items():
        low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        w = [x for x in re.split("[\x20\x09-\x0d]+", low) if x]
        out[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    return out


def brute(texts):
    sets = sets_of(texts)
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 80 * len(sets[a] | sets[b]):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def check(spark, texts, **how):
    docs = with_clashes(docs_of(spark, texts))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in N.join_documents(docs, **how).collect()}
    assert got == brute(dict(enumerate(texts)))


@pytest.mark.parametrize("seed", [1, 2])
def test_small_corpora(spark, seed):
    check(spark, some_corpus(seed))


@pytest.mark.parametrize("how", [{"most_coarse": 5}, {"bits": 4}])
def test_two_levels_of_blocks_and_clashing_names(spark, how):
    check(spark, some_corpus(3), **how)


def test_spanning_forest():
    """Few links are left, and they join just what all links join."""
    rng = np.random.default_rng(2)
    for n in (1, 2, 9, 40):
        for share in (0.0, 0.05, 0.5):
            group = rng.integers(0, max(1, n // 2), n)
            group = np.unique(group, return_inverse=True)[1]
            linked = np.triu(rng.random((n, n)) < share, 1)
            linked = (linked | linked.T) & (group[:, None] != group[None, :])
            forest = N.spanning_forest(linked, group)
            assert all(linked[u, v] for u, v in forest)

            def joined(pairs, group=group):
                root = list(range(group.max() + 1))
                for u, v in pairs:
                    a, b = root[group[u]], root[group[v]]
                    root = [min(a, b) if r in (a, b) else r for r in root]
                return root

            assert joined(forest) == joined(zip(*np.nonzero(linked), strict=True))
            assert len(forest) == len(set(range(group.max() + 1))) - len(set(joined(forest)))


def test_components_of_a_hub(spark, monkeypatch):
    """A node with most of the edges, chains and rings, against union by hand."""
    from chronoweft.llm import components as K

    monkeypatch.setattr(K, "LEAST_HOT", 3)
    monkeypatch.setattr(K, "HOT_SHARE", 20)
    rng = random.Random(8)
    edges = [(900, k) for k in range(300)] + [(k, k + 1) for k in range(1000, 1060)] + [(rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(60)] + [(5, 5), (-7, 1000)]
    root = {}
    for u, v in edges:
        if u != v:
            a, b = root.setdefault(u, u), root.setdefault(v, v)
            root = {k: min(a, b) if r in (a, b) else r for k, r in root.items()}
    got = K.components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert len(got) == len(root) and {r.node: r.root for r in got} == root
    assert K.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_hot_keys(spark, monkeypatch):
    """Keys with many rows, with few, without a row in the table, and null: as an inner join has them."""
    from chronoweft.llm import common

    monkeypatch.setattr(common, "LEAST_HOT", 3)
    rows = [(k, i) for i, k in enumerate([7] * 50 + [8] * 20 + [1, 2, 3, None, 9, 9, 9, 9, 9])]
    left, table = spark.createDataFrame(rows, "k long, i int"), spark.createDataFrame([(7, "a", 1), (8, "b", 2), (1, "c", None), (2, None, 4), (5, "e", 5)], "k long, x string, y int")
    got = common.hot_join(left, table, "k", len(rows))
    assert sorted(map(str, got.select("k", "i", "x", "y").collect())) == sorted(map(str, left.join(table, "k").select("k", "i", "x", "y").collect()))
    texts = ["one two three four five six"] * 9 + ["seven eight nine ten eleven twelve"] * 5 + ["other words than those before here", None]
    check(spark, texts)
    assert sorted(r.doc_id for r in N.keep_one_each(docs_of(spark, texts)).collect()) == [0, 9, 14, 15]


def test_families_near_the_threshold(spark):
    rng = random.Random(5)
    texts = []
    for size in (6, 9, 14, 30, 60, 146):
        base = prose(rng, size).split()
        for _ in range(20):
            w = list(base)
            for _ in range(rng.randrange(max(2, size // 12))):
                k = rng.randrange(len(w))
                if rng.random() < 0.5:
                    w[k] = f"x{rng.randrange(30)}"
                else:
                    w = w[:k] + w[k + 1 :] + [f"y{rng.randrange(9)}"]
            texts.append(" ".join(w))
    check(spark, texts)


def test_families_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(N, "PAIRED_MEMBERS", 2)
    monkeypatch.setattr(N, "CHUNK_SETS", 7)
    monkeypatch.setattr(N, "PRODUCT_COLUMNS", 16)
    test_families_near_the_threshold(spark)


def test_repeated_rows_and_one_id_with_two_texts(spark):
    rows = [(1, "a b c d e f", "", "", 0), (1, "a b c d e f", "", "", 0), (2, "a b c d e f", "", "", 0), (2, "q r s t u v", "", "", 0), (3, None, "", "", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(map(tuple, N.join_documents(df).collect()))
    assert got == [(1, 2, 1), (1, 2, 1), (2, 2, 1), (2, 2, 2), (3, 0, 3)]
    kept = sorted((r.doc_id, r.text) for r in N.keep_one_each(df).collect())
    assert kept == [(1, "a b c d e f"), (2, "q r s t u v"), (3, None)]


def test_rows_of_one_id_are_judged_each_by_its_text(spark):
    """An unrelated text stays although another text of its doc_id goes; of rows that differ in other columns one stays."""
    a, b, c = "one two three four five six", "seven eight nine ten eleven twelve", "un deux trois quatre cinq six"
    rows = [(3, b, "y"), (5, a, "x"), (5, b, "x"), (7, c, "q"), (7, c, "p"), (7, c, "p"), (8, c, "p"), (5, "", "x"), (5, None, "x"), (None, a, "x"), (None, a, "x"), (4, "  ", "x"), (4, a + " z", "x")]
    df = with_clashes(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    want = [(3, b, "y"), (4, "  ", "x"), (4, a + " z", "x"), (5, a, "x"), (5, "", "x"), (5, None, "x"), (7, c, "p"), (None, a, "x"), (None, a, "x")]
    for again in range(2):
        got = N.keep_one_each(df.repartition(3 + again))
        assert got.columns == df.columns
        assert sorted(map(str, ((r.doc_id, r.text, r.lang) for r in got.collect()))) == sorted(map(str, want))


def test_empty_table(spark):
    assert N.join_documents(docs_of(spark, [])).count() == 0
    assert N.keep_one_each(docs_of(spark, [])).count() == 0


def test_pipeline_stage_keeps_one_of_each(spark):
    texts = some_corpus(4)
    want = brute(dict(enumerate(texts)))
    docs = with_clashes(docs_of(spark, texts))
    kept = N.keep_one_each(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, (_, c) in want.items() if i == c}


def test_pigeonhole_holds_for_random_pairs():
    """Sets within the bound share a hash that neither's allowance covers."""
    rng = np.random.default_rng(0)
    for size in (4, 5, 6, 8, 9, 12, 20, 33, 60, 200, 700):
        for _ in range(60):
            own = np.unique(rng.integers(1, 1 << 62, size).astype(np.uint64))
            most = int(len(own) * 2 // 9)
            drop = int(rng.integers(0, most + 1))
            other = np.unique(np.concatenate([own[drop:], rng.integers(1, 1 << 62, int(rng.integers(0, most - drop + 1))).astype(np.uint64)]))
            both = len(np.intersect1d(own, other))
            if 100 * both < 80 * (len(own) + len(other) - both) or drop == 0 and len(other) == len(own):
                continue
            met = False
            dealt = {}
            for x in (own, other):
                for flag, k in N.bands_of(len(x)):
                    dealt.setdefault(k, []).append(N.deal(x, k))
            for two in dealt.values():
                if len(two) == 2:
                    (h, f, spare), (g, e, more) = two
                    common = np.intersect1d(h, g)
                    free = len(np.intersect1d(common, h[~f]))
                    met |= free > spare or len(np.intersect1d(common, h[f])) > 0 or len(np.intersect1d(common, g[e])) > 0 or len(np.intersect1d(common, g[~e])) > more
            assert met, (size, len(own), len(other))
