"""Small tables for the operators' tests."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, first=0, langs=None):
    rows = [(first + i, t, (langs[i] if langs else "en"), "src0", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def prose(rng, n, words=None):
    words = words or [f"w{i}" for i in range(400)]
    return " ".join(rng.choice(words) for _ in range(n))


#: Null, empty, blank, one word, control characters, other scripts, a very long word.
ODD_TEXTS = [None, "", " \n\t", "word", "\x00\x01 a", "naïve Ünïcode ÆØ 中文 😀 é", "x" * 70_000, "short one", "short one"]


def with_clashes(df):
    """The same rows with columns whose names operators use themselves."""
    from pyspark.sql import functions as F

    for name in ("rid", "node", "key", "hash", "score", "held_out", "toxic", "label_id", "p", "doc", "kind", "row", "length", "rank"):
        df = df.withColumn(name, F.lit("extra"))
    return df


def some_corpus(seed=1, n=60):
    """Texts with copies, near copies, a shared passage and odd ones."""
    rng = random.Random(seed)
    passage = prose(rng, 40)
    out = list(ODD_TEXTS)
    for _ in range(n):
        t = prose(rng, rng.choice([3, 6, 20, 80, 200]))
        out.append(t)
        k = rng.random()
        if k < 0.15:
            out.append(t)
        elif k < 0.4:
            w = t.split()
            for _ in range(rng.choice([1, 1, 2, 4])):
                w[rng.randrange(len(w))] = "changed"
            out.append(" ".join(w))
        elif k < 0.6:
            out.append(t[: len(t) // 2] + " " + passage + " " + t[len(t) // 2 :])
    out.append(passage * 30)
    rng.shuffle(out)
    return out
