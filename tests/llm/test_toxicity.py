import random
import zlib

import numpy as np
import pytest

from chronoweft.llm import toxicity as X
from tests.llm.helpers import ODD_TEXTS, docs_of, prose, with_clashes


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_automaton_accepts_what_the_distance_allows():
    rng = random.Random(1)
    terms = ["moron", "idiots", "worthless", "scum", "disgusting"]
    made = X.fuzzy_automaton([t for t in terms if X.allowed_edits(t)])
    words = ["mor0n", "moon", "moron", "idlots", "scam", "worthles", "wrthlss", "worthlessly", "disgustng"]
    for t in terms:
        for _ in range(60):
            w = list(t)
            for _ in range(rng.randrange(4)):
                k = rng.randrange(len(w) + 1)
                w[k : k + rng.randrange(2)] = rng.choice(["", "x", "o", "a"])
            words.append("".join(w) or "q")
    hits = made.run(X.Words([" ".join(words)]))
    assert [h >= 0 for h in hits] == [any(X.allowed_edits(t) and distance(w, t) <= X.allowed_edits(t) for t in terms) for w in words]


def test_exact_automaton_and_stems():
    made = X.exact_automaton(["abc", "lowe*", "abcdef"])
    words = X.Words(["abc abcd lowe lower loweiß low abcdef x abc"])
    assert made.run(words).tolist() == [0, -1, 1, 1, 1, -1, 2, -1, 0]


def test_quotation_counts_less():
    lexicon = X.Lexicon([("moron", 6.0)])
    abuse, quoted, reported = lexicon.features(["you are a moron", 'the word "moron" stands here', "he said moron once"])
    assert abuse[1] > quoted[1] == reported[1] > 0


def words_by_hand(text):
    """(start, end, word) of the runs of letters, digits, @ and $ of the basic plane."""
    low, out, start = text.lower(), [], None
    for i, c in enumerate(low + " "):
        inside = i < len(low) and (ord(c) < 1 << 16 and c.isalnum() or c in "@$")
        if inside and start is None:
            start = i
        if not inside and start is not None:
            out.append((start, i, low[start:i]))
            start = None
    return low, out


def features_by_hand(text, terms):
    low, words = words_by_hand(text)
    said = [w for _, _, w in words]
    names = [t for t, _ in terms]
    sums, distinct, each = [0.0, 0.0, 0.0], set(), 0.0
    for k, (start, end, w) in enumerate(words):
        stems = [t for t in names if t.endswith("*") and w.startswith(t[:-1])]
        near = [(distance(w, t), i) for i, t in enumerate(names) if not t.endswith("*") and X.allowed_edits(t) and distance(w, t) <= X.allowed_edits(t)]
        misspelled = w not in names and not stems
        if w in names:
            i = names.index(w)
        elif stems:
            i = names.index(max(stems, key=len))
        elif near:
            i = min(near)[1]
        else:
            continue
        a, b = max(0, k - 6), min(len(words) - 1, k + 6)
        before = low[words[a - 1][1] if a else 0 : start]
        after = low[end : words[b + 1][0] if b + 1 < len(words) else len(low)]
        quoted = any(c in X.QUOTES for c in before) and any(c in X.QUOTES for c in after)
        told = any(x in X.REPORTING for x in said[a : b + 1])
        weight = terms[i][1] * (0.25 if (quoted or told) and not any(x in X.ADDRESSING for x in said[a : b + 1]) else 1)
        sums[2 if misspelled else 0 if terms[i][1] >= 4.5 else 1] += weight
        each += weight
        if terms[i][1] >= 4.5:
            distinct.add(i)
    n = len(words)
    return [1, *np.log1p(sums), np.log1p(each / max(n, 1) * 100), np.log1p(len(distinct)), np.log1p(n) / 10]


TERMS = [("moron", 6.0), ("worthless", 5.0), ("trash", 4.0), ("lowe*", 4.6), ("lower", 4.55), ("pathe*", 3.5), ("scum", 3.2), ("crétin", 5.5), ("morons", 3.1)]


def test_scores_by_brute_force(spark):
    """Words, nearest terms, contexts, sums and the logistic score, computed text by text without automata."""
    rng = random.Random(9)
    parts = ["moron", "mor0n", "morons", "mroon", "worthles", "worthlses", "trash", "tresh", "lower", "lowe", "loweing", "pathetic", "scum", "scam", "crétin", "cretin", "CRÉTINS", "you", "du", "said", "wrote", '"', "«", "»", "'", "”", "plain", "words", "here", "é", "中文", "😀", "a@b$", "x" * 40, "\n", "."]
    texts = [*ODD_TEXTS, '"moron" stands first', 'last stands "moron"', "moron"]
    for _ in range(400):
        texts.append(rng.choice([" ", " ", ""]).join(rng.choice(parts) for _ in range(rng.choice([1, 3, 12, 60]))))
    w = np.array([-2.0, 1.3, 0.7, 0.9, 0.3, 0.4, -0.8])
    got = {r.doc_id: r for r in X.score(with_clashes(docs_of(spark, texts)), model=(X.Lexicon(TERMS), w)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        want = 1 / (1 + np.exp(-np.dot(features_by_hand(t or "", TERMS), w)))
        assert abs(got[i].score - want) < 1e-9 and got[i].predicted == (want >= 0.3), t


def test_the_sample_is_bounded_and_the_same_again(spark):
    texts, toxic = corpus()
    docs = docs_of(spark, texts)
    labels = spark.createDataFrame([(i, 1, t) for i, t in enumerate(toxic)], "doc_id long, quality int, toxic int")
    assert X.training_rows(docs, labels, 50).count() == 50
    one, two = (X.learn(docs.repartition(k), labels.repartition(k), max_train_docs=200) for k in (2, 5))
    assert one[0].terms == two[0].terms and np.allclose(one[1], two[1], atol=1e-9)


def corpus(n=400):
    rng = random.Random(5)
    texts, toxic = [], []
    for i in range(n):
        t = prose(rng, rng.choice([10, 60])).split()
        bad = i % 5 == 0
        if bad:
            for w in rng.sample(["moron", "worthless", "pathetic", "trash", "idiot"], 2):
                t.insert(rng.randrange(len(t)), w)
        texts.append(" ".join(t))
        toxic.append(int(bad))
    return texts, toxic


def test_held_out(spark):
    texts, toxic = corpus()
    docs = with_clashes(docs_of(spark, texts + ODD_TEXTS))
    labels = spark.createDataFrame([(i, 1, t if i % 3 else None) for i, t in enumerate(toxic)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in X.score(docs, labels).collect()}
    assert len(got) == len(texts) + len(ODD_TEXTS)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) and r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    held = [i for i in range(len(texts)) if got[i].held_out]
    assert np.mean([got[i].predicted == toxic[i] for i in held]) > 0.97
    assert not any(got[i].predicted for i in range(len(texts), len(got)))
    other = spark.createDataFrame([(i, 1, (1 - t if got[i].held_out else t) if i % 3 else None) for i, t in enumerate(toxic)], "doc_id long, quality int, toxic int")
    assert sorted(X.score(docs, other).collect()) == sorted(got.values())


def test_without_labels_or_rows(spark):
    docs = docs_of(spark, ["some text", None])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.predicted for r in X.score(docs, none).collect()} == {0}
    one = spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int")
    assert {r.predicted for r in X.score(docs, one).collect()} == {0}
    assert X.score(docs_of(spark, []), none).count() == 0


def test_fit_separates():
    x = np.array([[1, 0], [1, 1], [1, 0.1], [1, 0.9]] * 10, float)
    y = np.array([0, 1, 0, 1] * 10, float)
    w = X.fit(x, y, 0.01)
    assert ((x @ w > 0) == (y == 1)).all()


@pytest.mark.parametrize("text", ["", "a", "ünï 中文 😀 x", "a" * 1000])
def test_words(text):
    w = X.Words([text, text])
    assert set(w.row.tolist()) <= {0, 1}


def test_every_whole_word_is_matched_misspelled():
    rng = random.Random(2)
    terms = list({"".join(rng.choices("abcdefghij", k=rng.randrange(5, 12))) for _ in range(150)})
    lexicon = X.Lexicon([(t, 9 - i / 50) for i, t in enumerate(terms)])
    words = [t[:k] + "z" + t[k + 1 :] for t in terms for k in (0, 2, len(t) - 1)]
    words += ["".join(rng.choices("abcdefghij", k=rng.randrange(3, 13))) for _ in range(300)]
    near = [min(((distance(w, t), i) for i, t in enumerate(terms) if distance(w, t) <= X.allowed_edits(t)), default=(0, -1))[1] for w in words]
    assert lexicon.misspelled(X.Words([" ".join(words)])).tolist() == near
    at, _, misspelled, _ = lexicon.hits(X.Words([" ".join(words[: 3 * len(terms)])]))
    assert len(at) == 3 * len(terms) and misspelled.any()


def test_a_lexicon_of_many_characters():
    rng = random.Random(4)
    signs = [chr(c) for c in range(0xAC00, 0xAC00 + 600)]
    rng.shuffle(signs)
    terms = ["".join(signs[i : i + 6]) for i in range(0, 600, 6)]
    lexicon = X.Lexicon([(t, 6.0) for t in terms] + [(signs[3] + signs[9] + signs[20] + signs[31] + "*", 4.0)])
    words = [*terms, signs[3] + signs[9] + signs[20] + signs[31] + "x"]
    assert lexicon.exact.run(X.Words([" ".join(words)])).tolist() == list(range(len(words)))
    changed = [t[:2] + "x" + t[3:] for t in terms] + [t[:2] + "x" + signs[0] + t[4:] for t in terms]
    assert lexicon.misspelled(X.Words([" ".join(changed)])).tolist() == [*range(len(terms)), *[-1] * len(terms)]
    made = X.fuzzy_automaton(terms[:45])
    assert made.width == 271 and made.run(X.Words([" ".join(changed)])).tolist() == [*range(45), *[-1] * (2 * len(terms) - 45)]
