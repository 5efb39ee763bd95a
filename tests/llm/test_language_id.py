import random

from chronoweft.llm import language_id as L
from tests.llm.helpers import ODD_TEXTS, docs_of, prose, with_clashes

EN = "the and of to in is that it was for on are with as his they at be this from have or by".split()
DE = "der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch".split()


def corpus(n=120):
    rng = random.Random(3)
    texts, langs = [], []
    for i in range(n):
        lang = "en" if i % 2 else "de"
        texts.append(prose(rng, rng.choice([5, 30]), EN if lang == "en" else DE))
        langs.append(lang if i % 7 else None)
    return texts + ODD_TEXTS, langs + [None] * len(ODD_TEXTS), ["en" if i % 2 else "de" for i in range(n)]


def test_held_out_accuracy_and_odd_texts(spark):
    texts, langs, truth = corpus()
    got = {r.doc_id: r for r in L.identify(with_clashes(docs_of(spark, texts, langs=langs))).collect()}
    assert len(got) == len(texts)
    assert all(got[i].lang_pred == t for i, t in enumerate(truth))
    assert all(0 <= r.score <= 1 for r in got.values())
    for i, t in enumerate(texts):
        has_letter = any(c.isalpha() for c in t or "")
        assert (got[i].lang_pred == "und") == (not has_letter)
    import zlib

    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())


def test_held_out_labels_and_ids_dont_matter(spark):
    import zlib

    texts, langs, _ = corpus()
    other = [("xx" if zlib.crc32(str(i).encode()) % 4 == 2 else x) for i, x in enumerate(langs)]
    one = L.identify(docs_of(spark, texts, langs=langs)).orderBy("doc_id").collect()
    two = L.identify(docs_of(spark, texts, langs=other)).orderBy("doc_id").collect()
    assert one == two


def test_more_languages_than_the_model_may_have(spark):
    """A noisy lang column: the most frequent languages are learned, the others' rows aren't."""
    texts, langs, truth = corpus()
    noisy = [f"x{i}" if i % 11 == 5 else x for i, x in enumerate(langs)]
    got = {r.doc_id: r for r in L.identify(docs_of(spark, texts, langs=noisy), max_languages=2).collect()}
    assert all(got[i].lang_pred == t for i, t in enumerate(truth)) and len(got) == len(texts)
    names, _ = L.learn(docs_of(spark, texts, langs=noisy), ~L.held_out(), max_languages=3)
    assert names[:2] == ["de", "en"] and len(names) == 3


def test_no_labels_and_no_rows(spark):
    got = L.identify(docs_of(spark, ["some text", None], langs=[None, None])).collect()
    assert {r.lang_pred for r in got} == {"und"}
    assert L.identify(docs_of(spark, [])).count() == 0


def test_block_scores_match_one_text_at_a_time():
    texts, langs, _ = corpus(10)
    import numpy as np

    logs = np.log(np.random.default_rng(0).random((L.BUCKETS + 1, 3))).astype(np.float32)
    names, p = L.score_block([t or "" for t in texts], ["a", "b", "c"], logs)
    for t, n, q in zip(texts, names, p, strict=True):
        m, r = L.score_block([t or ""], ["a", "b", "c"], logs)
        assert m[0] == n and abs(r[0] - q) < 1e-5


def test_filter_keeps_rows_and_columns(spark):
    texts, langs, _ = corpus()
    docs = with_clashes(docs_of(spark, texts, langs=langs))
    kept = L.keep_identified(docs)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert set(range(120)) <= ids and not ids & {i for i, t in enumerate(texts) if not any(c.isalpha() for c in t or "")}
