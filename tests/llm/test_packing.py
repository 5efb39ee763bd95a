import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from chronoweft.llm import packing as K
from tests.llm.helpers import ODD_TEXTS, docs_of, prose, with_clashes


def corpus():
    rng = random.Random(2)
    odd = ["<|endoftext|> x", "<|STARTOFTEXT|>", "it's he'll 'street \"'s", "a1b22c333", "ß Éa ÿ×÷ ª²", "Ⅷ ſ İ", "re've 'd"]
    return [*ODD_TEXTS, *odd, *(prose(rng, rng.choice([1, 30, 400])) for _ in range(60)), prose(rng, 9000)]


def test_ids_are_the_tokenisers_own():
    e = K.Encoder(K.vocabulary())
    texts = [t or "" for t in corpus()]
    for t, ids in zip(texts, e.encode(texts), strict=True):
        assert ids.tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids
    e.clear()
    assert e.encode(["again again"])[0].tolist() == e.tokenizer.encode("again again", add_special_tokens=False).ids


def test_pieces_and_places(spark):
    texts = corpus()
    got = K.pack(with_clashes(docs_of(spark, texts))).collect()
    e = K.Encoder(K.vocabulary())
    want = []
    for i, t in enumerate(texts):
        ids = np.array([*e.whole(t or ""), 1], "<u4")
        want += [(i, k, s, len(ids[s : s + 4096]), zlib.crc32(ids[s : s + 4096].tobytes())) for k, s in enumerate(range(0, len(ids), 4096))]
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    check_places(got)
    whole = sum(r.length == 4096 for r in got)
    third = sum(4096 / 3 < r.length < 4096 for r in got)  # two of these at most go together; the others fit beside them
    assert len({r.sequence_id for r in got}) == whole + -(-third // 2)


def check_places(rows, capacity=4096):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity


def test_empty_table_and_repeated_rows(spark):
    assert K.pack(docs_of(spark, [])).count() == 0
    rows = docs_of(spark, ["same text"] * 3).withColumn("doc_id", __import__("pyspark.sql.functions", fromlist=["x"]).lit(5).cast("long"))
    got = K.pack(rows).collect()
    assert len(got) == 3
    check_places(got)


def least_bins(items, capacity):
    items = sorted(items, reverse=True)
    best = len(items)

    def run(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(items):
            best = len(bins)
            return
        for r in sorted({b for b in bins if b >= items[i]}):
            k = bins.index(r)
            bins[k] -= items[i]
            run(i + 1, bins)
            bins[k] += items[i]
        run(i + 1, [*bins, capacity - items[i]])

    run(0, [])
    return best


@pytest.mark.parametrize("seed", range(40))
def test_reduction_keeps_an_optimum(seed):
    """What reduction fixes, with the best packing of the rest, is as good as the best packing of all."""
    rng = random.Random(seed)
    items = [rng.randrange(1, 21) for _ in range(rng.randrange(1, 9))]
    counts = dict(Counter(items))
    fixed = K.reduce(counts, 20)
    for own, _ in fixed:
        assert sum(s * k for s, k in own) <= 20
    rest = [s for s, n in counts.items() for _ in range(n)]
    assert sorted(rest + [s for own, t in fixed for s, k in own for _ in range(k * t)]) == sorted(items)
    assert sum(t for _, t in fixed) + (least_bins(rest, 20) if rest else 0) == least_bins(items, 20)


@pytest.mark.parametrize("seed", range(30))
def test_better_fillings_by_enumeration(seed):
    """Whether some two or more pieces beside one fill its room better than the largest alone."""
    rng = random.Random(100 + seed)
    capacity = 60
    counts = dict(Counter(rng.randrange(1, 40) for _ in range(rng.randrange(2, 9))))
    for size in counts:
        rest = capacity - size
        others = [s for s, n in counts.items() for _ in range(n - (s == size))]
        fitting = [s for s in others if s <= rest]
        if not fitting or rest in fitting:
            continue
        sums = {sum(s for k, s in enumerate(others) if pick >> k & 1) for pick in range(1 << len(others)) if pick.bit_count() > 1}
        want = any(max(fitting) < x <= rest for x in sums)
        took = K._dominant(size, K.Sizes(dict(counts), capacity))
        assert (took is None) == want
        if took:
            assert sum(s * k for s, k in took[0]) == size + max(fitting)


def test_many_lengths():
    """2,000 lengths, and the same in very large numbers: all pieces are placed, in little more than the volume."""
    rng = np.random.default_rng(6)
    lengths = rng.choice(np.arange(20, 4000), 2000, replace=False)
    for times in (1, 10**9):
        histogram = {int(s): int(n) * times for s, n in zip(lengths, rng.integers(1, 4, 2000), strict=True)}
        counts = dict(histogram)
        fixed = K.reduce(counts, 4096)
        placed = Counter(counts)
        for own, n in fixed:
            assert sum(s * k for s, k in own) <= 4096
            for s, k in own:
                placed[s] += k * n
        assert placed == Counter(histogram) and len(fixed) < 4000
        _, sequences = K.plan(histogram)
        assert sequences <= 1.01 * sum(s * n for s, n in histogram.items()) / 4096 + 1


@pytest.mark.parametrize("seed", range(10))
def test_plan_covers_every_rank(seed):
    rng = random.Random(seed)
    histogram = {rng.randrange(1, 4097): rng.randrange(1, 400) for _ in range(rng.choice([3, 50, 400]))}
    table, n = K.plan(histogram)
    assert n >= -(-sum(s * c for s, c in histogram.items()) // 4096)
    for size, count in histogram.items():
        own = np.flatnonzero(table["length"] == size)
        assert table["rank"][own[0]] == 0 and (np.diff(table["rank"][own]) > 0).all() and table["rank"][own[-1]] < count
