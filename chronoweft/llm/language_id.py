"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams (1 to 3 code points of the lower-cased text) per language into ``buckets`` hash
buckets, in numpy inside the tasks; the tasks' partial counts are summed by language and slice of the
buckets, so what comes to the driver is the model alone: languages x buckets numbers, whatever the
corpus. The matrix of log probabilities then goes to the tasks, and each block of texts is scored by
gathering the rows of its n-grams and summing them by text.

The classifier is fitted on at most ``max_train_docs`` labelled documents in expectation, chosen by a hash
of doc_id; all documents where there are no more. Of more than ``max_languages`` values of lang, the sample
has those with the most documents (ties by name): the model's size is languages x buckets.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; without any labelled row all
texts are ``und``; documents with a null lang are predicted but not learned from; repeated rows each give
a row; an empty table gives an empty result; of equally likely languages the first by name wins; other
columns are ignored, and lang, source and doc_id never enter a prediction.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweft.llm.common import BLOCK_BYTES, U64, bounded_batches, row_blocks, text_view, texts, tidy

BUCKETS = 1 << 16
SIZES = (1, 2, 3)
MAX_TRAIN_DOCS = 40_000
MAX_LANGUAGES = 1_000
SLICES = 16
EFFECTIVE_GRAMS = 200.0
"""The score is a posterior as if a text had at most this many independent n-grams."""
LETTER = re.compile(r"[^\W\d_]")
_FACTORS = [U64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def held_out(doc_id: str = "doc_id") -> Column:
    """True for documents that nothing is learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def grams(texts_: list[str], buckets: int) -> tuple[Iterator[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """For each n-gram size, bucket ids by position and which positions are whole n-grams; and where
    each text begins. Each text gets one separator after it, so that no text is empty here."""
    low = [t.lower() for t in texts_]
    points = np.frombuffer("\n".join([*low, ""]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    starts = np.zeros(len(low), np.int64)
    np.cumsum([len(t) + 1 for t in low[:-1]], out=starts[1:])
    ends = np.append(starts[1:], len(points)) - 1
    left = np.repeat(ends, np.diff(np.append(starts, len(points)))) - np.arange(len(points))

    def sizes() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for n in SIZES:
            h = points * _FACTORS[0]
            for k in range(1, n):
                h[: len(h) - k] += points[k:] * _FACTORS[k]
            h += U64(n) * _FACTORS[2]
            h ^= h >> U64(29)
            h *= U64(0xBF58476D1CE4E5B9)
            yield (h >> U64(40)).astype(np.int64) & (buckets - 1), left >= n

    return sizes(), starts


def learn(docs: DataFrame, trained: Column, buckets: int = BUCKETS, max_train_docs: int = MAX_TRAIN_DOCS, max_languages: int = MAX_LANGUAGES) -> tuple[list[str], np.ndarray]:
    """Languages, and log probabilities with a row per bucket; a last row holds the log priors."""
    known = docs.where(trained & F.col("lang").isNotNull())
    most = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(max_languages + 1).collect()
    sizes = {r["lang"]: r["n"] for r in most[:max_languages]}
    langs = sorted(sizes)
    if len(most) > max_languages:
        known = known.where(F.col("lang").isin(langs))
    if not langs:
        return [], np.zeros((buckets + 1, 0), np.float32)
    total = sum(sizes.values())
    if total > max_train_docs:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(max_train_docs / total * (1 << 30)))
    number = {x: i for i, x in enumerate(langs)}
    width = buckets // SLICES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(len(langs) * buckets, np.int64)
        for batch in batches:
            _, offsets = text_view(batch.column(0))
            own = np.array([number[x] for x in batch.column(1).to_pylist()], np.int64)
            for a, b in row_blocks(offsets, BLOCK_BYTES // 2):
                found, starts = grams([x or "" for x in batch.column(0).slice(a, b - a).to_pylist()], buckets)
                for ids, whole in found:
                    lang = np.repeat(own[a:b], np.diff(np.append(starts, len(ids)))) * buckets
                    sums += np.bincount((ids + lang)[whole], minlength=len(sums))
        if sums.any():
            parts = sums.reshape(-1, width)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(parts))), pa.array([x.tobytes() for x in parts], pa.binary())], ["slice", "counts"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x, np.int64) for x in pdf["counts"])
        return pd.DataFrame({"slice": pdf["slice"][:1], "counts": [total.tobytes()]})

    counted = bounded_batches(known).select(F.coalesce("text", F.lit("")).alias("text"), "lang").mapInArrow(tidy(count), "slice long, counts binary")
    got = {r["slice"]: r["counts"] for r in counted.groupBy("slice").applyInPandas(add, "slice long, counts binary").collect()}
    sums = np.zeros((len(langs) * SLICES, width), np.int64)
    for k, v in got.items():
        sums[k] = np.frombuffer(v, np.int64)
    counts = sums.reshape(len(langs), buckets).T + 0.5
    logs = np.log(counts) - np.log(counts.sum(axis=0))
    prior = np.log(np.array([sizes[x] for x in langs]) / total)
    return langs, np.vstack([logs, prior[None]]).astype(np.float32)


def score_block(texts_: list[str], langs: list[str], logs: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Predicted language and score of each text."""
    if not langs:
        return ["und"] * len(texts_), np.zeros(len(texts_))
    found, starts = grams(texts_, len(logs) - 1)
    sums = np.zeros((len(texts_), len(langs)))
    n = np.zeros(len(texts_))
    for ids, whole in found:
        values = logs[ids]
        values[~whole] = 0
        sums += np.add.reduceat(values, starts, axis=0, dtype=np.float64)
        n += np.add.reduceat(whole.astype(np.int64), starts)
    sums = sums * np.minimum(1, EFFECTIVE_GRAMS / np.maximum(n, 1))[:, None] + logs[-1]
    sums -= sums.max(axis=1, keepdims=True)
    p = np.exp(sums)
    p /= p.sum(axis=1, keepdims=True)
    best = p.argmax(axis=1)
    lettered = np.array([LETTER.search(t) is not None for t in texts_], bool)
    names = [langs[k] if ok else "und" for k, ok in zip(best.tolist(), lettered.tolist(), strict=True)]
    return names, np.where(lettered, p[np.arange(len(p)), best], 0.0)


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray] | None = None, **how) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each document; the model is learned from the rows of
    ``docs`` that aren't held out, unless one is given."""
    spark = docs.sparkSession
    shipped = spark.sparkContext.broadcast(model or learn(docs, ~held_out(), **how))
    rows = texts(docs, held_out().alias("held_out"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, logs = shipped.value
        for batch in batches:
            _, offsets = text_view(batch.column(1))
            names: list[str] = []
            scores = [np.zeros(0)]
            for a, b in row_blocks(offsets, BLOCK_BYTES // 2):
                got, p = score_block(batch.column(1).slice(a, b - a).to_pylist(), langs, logs)
                names += got
                scores.append(p)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(names, pa.string()), pa.array(np.concatenate(scores))], ["doc_id", "held_out", "lang_pred", "score"])

    return rows.mapInArrow(tidy(run), f"doc_id {dict(rows.dtypes)['doc_id']}, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, min_score: float = 0.5, **how) -> DataFrame:
    """The rows and columns of ``docs`` whose language is found with at least ``min_score``.

    The decision is made in the same pass over the rows, so no join is needed to apply it."""
    shipped = docs.sparkSession.sparkContext.broadcast(how.pop("model", None) or learn(docs, ~held_out(), **how))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, logs = shipped.value
        for batch in batches:
            _, offsets = text_view(batch.column(at))
            for a, b in row_blocks(offsets, BLOCK_BYTES // 2):
                part = batch.slice(a, b - a)
                names, p = score_block([x or "" for x in part.column(at).to_pylist()], langs, logs)
                kept = (np.array(names) != "und") & (p >= min_score)
                yield part.filter(pa.array(kept))

    return bounded_batches(docs).mapInArrow(tidy(run), docs.schema)
