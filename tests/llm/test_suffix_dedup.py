import hashlib
import random

import numpy as np
import pytest

from chronoweft.llm import suffix_dedup as D
from tests.llm.helpers import ODD_TEXTS, docs_of, some_corpus, with_clashes


def brute(rows, least=50):
    first = {}
    for i, x in sorted(rows):
        for k in range(len(x) - least + 1):
            first.setdefault(x[k : k + least], i)
    out = []
    for i, x in rows:
        gone = bytearray(len(x))
        for k in range(len(x) - least + 1):
            if first[x[k : k + least]] < i:
                gone[k : k + least] = b"\1" * least
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out.append((i, len(x), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(x, gone, strict=True) if not g)).hexdigest()))
    return sorted(out)


def check(spark, texts, **how):
    got = sorted(map(tuple, D.deduplicate(with_clashes(docs_of(spark, texts)), **how).collect()))
    assert got == brute([(i, (t or "").encode()) for i, t in enumerate(texts)])


def corpus():
    rng = random.Random(8)
    line = "this very line of some fifty-five bytes stands in many texts"
    texts = [*ODD_TEXTS, line, line * 3, "a" * 49, "a" * 50, "a" * 51, "ab" * 200, "é" * 60, "xé" * 40, line[:49], line[1:52]]
    return texts + [t + line[: rng.randrange(40, 60)] + str(k) for k, t in enumerate(some_corpus(9)[:40]) if t is not None]


def test_against_brute_force(spark):
    check(spark, corpus())


@pytest.mark.parametrize("limit", [1, 3])
def test_hot_anchors(spark, limit):
    check(spark, corpus(), local_variants=limit, hot_variants=limit)


def test_two_levels_of_blocks(spark):
    check(spark, corpus(), most_coarse=7)
    check(spark, corpus(), most_coarse=7, local_variants=1, hot_variants=2)


def test_repeated_rows_and_null_ids(spark):
    text = "one text of more than fifty bytes that is here several times over"
    rows = [(5, text), (5, text), (3, "z" + text), (None, text), (9, None)]
    got = sorted(map(str, D.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    want = [(i, n, r, s, h) for i, n, r, s, h in brute([(i, (t or "").encode()) for i, t in rows if i is not None])]
    want.append((None, len(text), 0, 0, hashlib.sha256(text.encode()).hexdigest()))
    assert [x.split("(", 1)[1] for x in got] == sorted(f"doc_id={i}, n_bytes={n}, n_removed={r}, n_spans={s}, kept_sha256='{h}')" for i, n, r, s, h in want)


def test_empty_table(spark):
    assert D.deduplicate(docs_of(spark, [])).count() == 0


def test_intervals_are_those_of_equal_prefixes():
    rng = np.random.default_rng(1)
    for sigma in (2, 5):
        parts = [rng.integers(1, sigma + 1, 60).astype(np.uint8) for _ in range(8)]
        parts += [parts[0][5:40], parts[1], np.concatenate([parts[2][:30], parts[3][:30]])]
        text = np.concatenate([np.append(p, 0) for p in parts]).astype(np.uint8)
        for depth in (8, 12, 20):
            order, divided = D.repeated_intervals(text, depth)
            raw = text.tobytes()
            for a, b, new in zip(order[:-1], order[1:], divided[1:], strict=True):
                x, y = raw[a : a + depth], raw[b : b + depth]
                if 0 not in x and 0 not in y and len(x) == len(y) == depth:
                    assert (x != y) == new
