import random
import zlib

import corpus_pipeline
from chronoweft.llm import secret_scan
from chronoweft.llm.packing import Encoder, vocabulary
from tests.llm.helpers import ODD_TEXTS, docs_of, prose, with_clashes
from tests.llm.test_decontaminate import tiles_by_hand, words_of
from tests.llm.test_language_id import DE, EN
from tests.llm.test_ngram_join import brute
from tests.llm.test_packing import check_places


def corpus():
    rng = random.Random(11)
    items = [prose(rng, 14), prose(rng, 22)]
    texts, langs = list(ODD_TEXTS), [None] * len(ODD_TEXTS)
    for i in range(60):
        lang = "en" if i % 2 else "de"
        t = prose(rng, 60, EN + [f"q{k}" for k in range(40)] if lang == "en" else DE + [f"z{k}" for k in range(40)])
        if i % 10 == 3:
            t += " " + rng.choice(items)
        if i % 10 == 4:
            t += ' password = "x9Q#long.Secret77" and key AKIA' + "ABCD1234" * 2
        texts.append(t)
        langs.append(lang)
        if i % 6 == 0:
            w = t.split()
            w[5] = "other"
            texts.append(" ".join(w))
            langs.append(lang)
    return texts, langs, items


def test_stages_and_run(spark, tmp_path):
    texts, langs, items = corpus()
    docs = docs_of(spark, texts, langs=langs)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    now = docs
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, str(tmp_path))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        out.write.parquet(str(tmp_path / f"stage{k}"))
        now = spark.read.parquet(str(tmp_path / f"stage{k}"))
        kept[name] = now.collect()

    lettered = {i for i, t in enumerate(texts) if any(c.isalpha() for c in t or "")}
    first = {r.doc_id for r in kept["language_id"]}
    assert first <= lettered and {i for i, x in enumerate(langs) if x} <= first
    components = brute({i: texts[i] for i in first})
    second = {i for i, (_, c) in components.items() if c == i}
    assert {r.doc_id for r in kept["ngram_join"]} == second < first
    leaks = set()
    for i in second:
        for item in items:
            t, b = words_of(texts[i])[-200:], words_of(item)
            if sum(x[0] for x in tiles_by_hand(t, b, 5)) >= 0.5 * len(b):
                leaks.add(i)
    third = second - leaks
    assert {r.doc_id for r in kept["decontamination"]} == third and leaks
    words = secret_scan.learn_words(docs_of(spark, [texts[i] for i in sorted(third)]))
    want = {i: secret_scan.masked(texts[i].encode(), words, 10.0, 8).decode() for i in third}
    assert {r.doc_id: r.text for r in kept["secret_scans"]} == want and any(want[i] != texts[i] for i in third)
    encoder = Encoder(vocabulary())
    pieces = sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in kept["best_fit_packing"])
    expected = []
    for i in sorted(third):
        import numpy as np

        ids = np.array([*encoder.whole(want[i]), 1], "<u4")
        expected += [(i, k, s, len(ids[s : s + 4096]), zlib.crc32(ids[s : s + 4096].tobytes())) for k, s in enumerate(range(0, len(ids), 4096))]
    assert pieces == sorted(expected)
    check_places(kept["best_fit_packing"])
    again = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in again) == pieces
    check_places(again)


def test_empty_documents(spark, tmp_path):
    docs_of(spark, []).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, "a b c d e f")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_clashing_columns_and_ids(spark, tmp_path):
    """Columns that operators use themselves stay; rows without a doc_id stay; of a doc_id with several texts each is
    judged by itself, and of equal rows one stays."""
    rng = random.Random(5)
    long = [prose(rng, 60, EN + [f"k{i}_{k}" for k in range(30)]) for i in range(6)]
    rows = [(1, long[0]), (1, long[0]), (1, long[1]), (2, long[1]), (3, long[2]), (0, long[2]), (None, long[3]), (None, long[3]), (4, None), (5, ""), (6, long[4] + " token = " + "ab12" * 8), (7, "x" * 50_000 + " " + long[5])]
    docs = with_clashes(spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    bench = with_clashes(spark.createDataFrame([(0, prose(rng, 20, [f"zz{k}" for k in range(99)]))], "item_id long, text string"))
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns and now.dtypes == docs.dtypes, name
    got = sorted(((r.doc_id, r.text) for r in now.collect()), key=str)
    kept = [(0, long[2]), (1, long[0]), (1, long[1]), (None, long[3]), (None, long[3]), (6, long[4] + " [secret]"), (7, rows[-1][1])]
    assert got == sorted(kept, key=str)
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted({str(r.doc_id) for r in pieces}) == ["0", "1", "6", "7", "None"] and sum(r.piece == 0 for r in pieces) == len(kept)
    check_places(pieces)
