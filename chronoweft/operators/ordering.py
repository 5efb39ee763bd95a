"""Orders in which variants are added to a model: scores, ranks, their fusion, and rate filters.

A candidate table has ``candidate`` and ``score``; the best has rank 1.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoweft.operators.alignment import Aligner, f_measure_of
from chronoweft.operators.discovery import add_trace, around_deviation
from chronoweft.plans import process_tree as P


MOST_COMPARED = 20_000
FIRST_CODE = 0x10000
"""Labels are written as characters from here on: a million of them, without gaps."""


def _acts(variants: DataFrame) -> Column:
    """A variant's activities: ``acts``, or without such a column the text's parts between commas."""
    return F.col("acts") if "acts" in variants.columns else F.split("variant", ",")


def levenshtein_scores(variants: DataFrame, added: DataFrame | None = None) -> DataFrame:
    """candidate, score: the sum over variants not yet added of their distance times their frequency.

    ``variants``: variant, acts (array of labels) and n_cases. Each label becomes one character, so the JVM's
    own distance applies. The score is defined on all pairs of variants, which are few next to cases; more
    than MOST_COMPARED of them raise an error."""
    v = variants.select("variant", "n_cases", _acts(variants).alias("acts"))
    rest = v if added is None else v.join(added.select("variant"), "variant", "left_anti")
    if rest.count() > MOST_COMPARED:
        raise ValueError(f"more than {MOST_COMPARED} variants to compare")
    code = lambda i: F.decode(F.unhex(F.lpad(F.hex(i + FIRST_CODE), 8, "0")), "UTF-32")
    names = v.select(F.explode("acts").alias("label")).agg(F.array_sort(F.collect_set("label")).alias("names"))
    book = names.select(F.map_from_entries(F.transform("names", lambda x, i: F.struct(x, code(i)))).alias("book"))
    coded = rest.crossJoin(F.broadcast(book)).select("variant", "n_cases", F.array_join(F.transform("acts", lambda x: F.col("book")[x]), "").alias("code"))
    a = coded.select(F.col("variant").alias("candidate"), F.col("code").alias("x"))
    b = coded.select(F.col("code").alias("y"), "n_cases")
    return a.crossJoin(b).groupBy("candidate", "x").agg(F.sum(F.levenshtein("x", "y") * F.col("n_cases")).cast("double").alias("score")).drop("x")


def missing_activity_scores(variants: DataFrame, labels: list[str]) -> DataFrame:
    """candidate, score: the number of a variant's activities that a model doesn't have."""
    have = F.array(*map(F.lit, labels)) if labels else F.array().cast("array<string>")
    return variants.select(F.col("variant").alias("candidate"), F.size(F.array_except(F.array_distinct(_acts(variants)), have)).cast("double").alias("score"))


def random_scores(variants: DataFrame, seed: int = 0) -> DataFrame:
    """candidate, score: the same on every run."""
    return variants.select(F.col("variant").alias("candidate"), (F.pmod(F.xxhash64("variant", F.lit(seed)), F.lit(1 << 20)) / (1 << 20)).alias("score"))


def adapted(scores: DataFrame, how: Callable = F.avg) -> DataFrame:
    """Scores of variants from (candidate, score) of each of their sequences."""
    return scores.groupBy("candidate").agg(how("score").alias("score"))


def ranked(scores: DataFrame, highest_best: bool = False) -> DataFrame:
    """``scores`` with rank; equal scores in the order of the candidates. One task ranks them all: candidates
    are variants, not cases."""
    key = F.desc("score") if highest_best else F.asc("score")
    return scores.withColumn("rank", F.row_number().over(Window.orderBy(key, "candidate")))


def fused(ranks: list[DataFrame], weights: list[float]) -> DataFrame:
    """candidate, score: the weighted sum of ranks; the least is best."""
    parts = [r.select("candidate", (F.col("rank") * w).alias(f"r{i}")) for i, (r, w) in enumerate(zip(ranks, weights, strict=True))]
    joined = reduce(lambda a, b: a.join(b, "candidate"), parts)
    return joined.select("candidate", reduce(lambda a, b: a + b, [F.col(f"r{i}") for i in range(len(parts))]).cast("double").alias("score"))


def rate_filter(ranks: DataFrame, rate: float) -> DataFrame:
    """The best ``max(1, ceil(rate * n))`` candidates."""
    n = ranks.count()
    return ranks.where(F.col("rank") <= max(1, math.ceil(rate * n)))


def choose(variants: DataFrame, steps: list[tuple[Callable[[DataFrame], DataFrame], float | None]]) -> str:
    """Rank and filter by each step in turn; the last must leave one candidate."""
    left = variants
    for score, rate in steps:
        ranks = ranked(score(left))
        kept = rate_filter(ranks, rate) if rate is not None else ranks.where("rank = 1")
        left = left.join(kept.select(F.col("candidate").alias("variant")), "variant", "left_semi")
    rows = left.select("variant").limit(2).collect()
    if len(rows) != 1:
        raise ValueError("the last step must leave exactly one candidate")
    return rows[0]["variant"]


# Scores by a model


def _scored(variants: DataFrame, score: Callable[[tuple[str, ...]], float]) -> DataFrame:
    """candidate, score of (variant), by a function that runs once a variant on the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([float(score(tuple(acts))) for acts in b.column(1).to_pylist()], pa.float64())], ["candidate", "score"])

    return variants.select(F.col("variant").alias("candidate"), _acts(variants).alias("acts")).mapInArrow(run, "candidate string, score double")


def alignment_scores(variants: DataFrame, tree: P.Tree) -> DataFrame:
    """The cost of each variant's alignment; infinite where the search is given up."""

    def score(acts: tuple[str, ...]) -> float:
        found = Aligner(tree).align(acts)
        return math.inf if found is None else found.cost

    return _scored(variants, score)


def deviation_height_scores(variants: DataFrame, tree: P.Tree) -> DataFrame:
    """The height of the subtree that would be discovered anew for the first deviation; infinite if the variant
    fits, or if its alignment is given up."""

    def score(acts: tuple[str, ...]) -> float:
        found = Aligner(tree).align(acts)
        return math.inf if found is None or found.fits else P.height(P.nodes(tree)[around_deviation(tree, found)])

    return _scored(variants, score)


def duplicate_scores(variants: DataFrame, tree: P.Tree) -> DataFrame:
    """How many labels occur more than once in that subtree; infinite if the alignment is given up."""

    def score(acts: tuple[str, ...]) -> float:
        found = Aligner(tree).align(acts)
        return math.inf if found is None else 0 if found.fits else len(P.duplicate_labels(P.nodes(tree)[around_deviation(tree, found)]))

    return _scored(variants, score)


def brute_force_scores(variants: DataFrame, tree: P.Tree, added: list[tuple[str, ...]], log: dict[tuple[str, ...], int], pull_down: bool = False) -> DataFrame:
    """The F-measure, on a log's counted sequences, of the model that has each variant added: highest is best.
    The sequences travel with the tasks; more than MOST_COMPARED of them raise an error."""
    if len(log) > MOST_COMPARED:
        raise ValueError(f"more than {MOST_COMPARED} sequences to score on")
    shipped = variants.sparkSession.sparkContext.broadcast((tree, added, log))

    def score(acts: tuple[str, ...]) -> float:
        tree, added, log = shipped.value
        return f_measure_of(log, add_trace(tree, added, acts, pull_down))

    return _scored(variants, score)
