import random

import numpy as np

from chronoweft.llm import decontaminate as C
from tests.llm.helpers import ODD_TEXTS, docs_of, prose, with_clashes


def tiles_by_hand(text, item, least):
    """Greedy string tiling as first defined: the longest match of unmarked words, marked, again and again."""
    a, b = [0] * len(text), [0] * len(item)
    out = []
    while True:
        best = None
        for i in range(len(text)):
            for j in range(len(item)):
                n = 0
                while i + n < len(text) and j + n < len(item) and text[i + n] == item[j + n] and not a[i + n] and not b[j + n]:
                    n += 1
                if n >= least and (best is None or n > best[0]):
                    best = (n, i, j)
        if best is None:
            return sorted(out)
        n, i, j = best
        a[i : i + n] = b[j : j + n] = [1] * n
        out.append(best)


def benchmark_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")


def corpus():
    rng = random.Random(4)
    items = [prose(rng, n) for n in (12, 20, 30, 40)] + ["too short", None, "a b a b a b a b a b"]
    texts = [*ODD_TEXTS]
    for k, item in enumerate(items[:4]):
        w = item.split()
        half = len(w) // 2
        texts += [prose(rng, 30) + " " + item + " " + prose(rng, 30), " ".join(w[half:]) + " and then " + prose(rng, 9) + " " + " ".join(w[:half]), item.upper().replace(" ", ", "), " ".join(w[: half - 1]), " ".join(w[:4]) + " " + prose(rng, 50)]
    return items, [*texts, "a b a b a b a b a b a b a b", "a b a b a b", *(prose(rng, 100) for _ in range(20))]


def words_of(text):
    return "".join(c.lower() if c.isascii() and c.isalnum() or not c.isascii() else " " for c in text or "").split()


def test_against_tiling_by_hand(spark):
    items, texts = corpus()
    got = {(r.doc_id, r.item_id): (round(r.coverage, 9), r.n_tiles, r.longest, r.covered) for r in C.contaminated(with_clashes(docs_of(spark, texts)), benchmark_of(spark, items)).collect()}
    want = {}
    for i, t in enumerate(texts):
        for j, b in enumerate(items):
            text, item = words_of(t), words_of(b)
            if len(item) >= 5 and (tiles := tiles_by_hand(text, item, 5)):
                covered = sum(x[0] for x in tiles)
                if covered >= 0.5 * len(item):
                    want[i, j] = (round(covered / len(item), 9), len(tiles), max(x[0] for x in tiles), covered)
    assert got == want and len(want) > 12


def test_items_in_blocks_give_the_same(spark):
    items, texts = corpus()
    docs, bench = docs_of(spark, texts), benchmark_of(spark, items)
    assert sorted(C.contaminated(docs, bench).collect()) == sorted(C.contaminated(docs, bench, max_item_bytes=100).collect())


def test_filter(spark):
    items, texts = corpus()
    docs, bench = with_clashes(docs_of(spark, texts)), benchmark_of(spark, items)
    bad = {r.doc_id for r in C.contaminated(docs, bench).collect()}
    kept = C.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(range(len(texts))) - bad


def test_empty_tables(spark):
    items, texts = corpus()
    assert C.contaminated(docs_of(spark, []), benchmark_of(spark, items)).count() == 0
    assert C.contaminated(docs_of(spark, texts), benchmark_of(spark, [])).count() == 0
    assert C.drop_contaminated(docs_of(spark, texts), benchmark_of(spark, [])).count() == len(texts)


def test_equal_hashes_of_different_words_are_no_match():
    items = C.Items([(1, "a b c d e f g h"), (2, "p q r s t u v w")], 5)
    words = items.words[0]
    items.seeds[:] = C.hash_runs(words, 5)[0]  # as if all seeds had one hash
    assert [(i.tolist(), p.tolist()) for i, p, _ in items.pairs(words, np.array([0]))] == [([0], [0])]


def test_a_long_repetitive_text(spark):
    """Thousands of words that repeat an item: one row, covered in full, in bounded time."""
    item = "the same six words come again"
    docs = docs_of(spark, [f"{item} " * 700, "nothing of it"])
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    (row,) = C.contaminated(docs, bench).collect()
    assert (row.doc_id, row.item_id, row.coverage, row.n_tiles) == (0, 7, 1.0, 1)
