"""Clusters of variants or patterns, by tree edit distance or by their labels.

Distances between all pairs are what agglomerative clustering and medoids need, so these work on at most
``most`` trees (variants are few next to cases); k-means and mixtures run in the cluster.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweft.operators.variants import label_array
from chronoweft.plans import variant_tree as V

MOST = 2_000


def distance_matrix(trees: list[V.Tree]) -> np.ndarray:
    n = len(trees)
    out = np.zeros((n, n))
    for i in range(n):
        for j in range(i):
            out[i, j] = out[j, i] = V.edit_distance(trees[i], trees[j])
    return out


def chain_distance(one: tuple[V.Tree, ...], other: tuple[V.Tree, ...]) -> int:
    """Of two chains of patterns: the sum, over the parts of both, of a part's least distance to a part of the
    other chain that is no nearer to its beginning. It depends on the order of two chains of one length."""
    n, m = len(one), len(other)
    if n > m:
        return chain_distance(other, one)
    d = {(i, j): V.edit_distance(one[i], other[j]) for i in range(n) for j in range(i, m)}
    return sum(min(d[i, j] for j in range(i, m)) for i in range(n)) + sum(min(d[i, j] for i in range(min(j + 1, n))) for j in range(m))


def agglomerative(distances: np.ndarray, most_distance: float) -> list[int]:
    """Complete linkage until the closest clusters are further apart than ``most_distance``."""
    n = len(distances)
    d = distances.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    label = np.arange(n)
    while n > 1:
        i, j = divmod(int(d.argmin()), len(d))
        if not d[i, j] <= most_distance:
            break
        i, j = min(i, j), max(i, j)
        label[label == j] = i
        d[i] = np.maximum(d[i], d[j])
        d[:, i] = d[i]
        d[i, i] = d[j] = d[:, j] = np.inf
        n -= 1
    order = {x: k for k, x in enumerate(dict.fromkeys(label.tolist()))}
    return [order[x] for x in label.tolist()]


def medoids(distances: np.ndarray, k: int, rounds: int = 100) -> list[int]:
    """k-medoids from the first k items."""
    centres = list(range(min(k, len(distances))))
    for _ in range(rounds):
        label = distances[:, centres].argmin(axis=1)
        new = []
        for c in range(len(centres)):
            own = np.flatnonzero(label == c)
            new.append(int(own[distances[np.ix_(own, own)].sum(axis=1).argmin()]) if len(own) else centres[c])
        if new == centres:
            break
        centres = new
    return distances[:, centres].argmin(axis=1).tolist()


def distances(variants: DataFrame, most: int = MOST) -> DataFrame:
    """a, b, distance of all pairs of different variants (variant_json), a before b: the trees, of which there may be
    at most ``most``, travel with the tasks, and each task holds its own against them."""
    raw = _collected(variants, most)
    shipped = variants.sparkSession.sparkContext.broadcast(raw)

    def run(batches):
        trees = [V.from_json(r) for r in shipped.value]
        for b in batches:
            for i in b.column(0).to_pylist():
                later = range(i + 1, len(trees))
                found = [V.edit_distance(trees[i], trees[j]) for j in later]
                yield pa.RecordBatch.from_arrays([pa.array([shipped.value[i]] * len(found), pa.string()), pa.array([shipped.value[j] for j in later], pa.string()), pa.array(found, pa.int32())], ["a", "b", "distance"])

    spark = variants.sparkSession
    return spark.range(0, len(raw), 1, max(1, min(len(raw), 4 * spark.sparkContext.defaultParallelism))).mapInArrow(run, "a string, b string, distance int")


def _collected(variants: DataFrame, most: int) -> list[str]:
    rows = [r["variant_json"] for r in variants.select("variant_json").orderBy("variant_json").limit(most + 1).collect()]
    if len(rows) > most:
        raise ValueError(f"more than {most} variants")
    return rows


def cluster_by_distance(variants: DataFrame, most_distance: float | None = None, k: int | None = None, most: int = MOST) -> DataFrame:
    """variant_json, cluster: agglomerative with ``most_distance``, or k-medoids with ``k``."""
    raw = _collected(variants, most)
    number = {r: i for i, r in enumerate(raw)}
    d = np.zeros((len(raw), len(raw)))
    for r in distances(variants, most).collect():  # most * most / 2 rows at most
        d[number[r["a"]], number[r["b"]]] = d[number[r["b"]], number[r["a"]]] = r["distance"]
    found = agglomerative(d, most_distance) if k is None else medoids(d, k)
    return variants.sparkSession.createDataFrame(list(zip(raw, map(int, found), strict=True)), "variant_json string, cluster int")


def cluster_in_groups(groups: DataFrame, most_distance: float, most: int = MOST) -> DataFrame:
    """variant_json, cluster, by agglomerative clustering within each ``cluster`` of ``groups`` (variant_json,
    cluster), as :func:`cluster_by_start` or :func:`cluster_by_labels` make them. Groups are clustered apart, each in
    a task; one of more than ``most`` variants is an error."""
    kind = dict(groups.dtypes)["cluster"]

    def run(pdf):
        raw = sorted(pdf["variant_json"])
        if len(raw) > most:
            raise ValueError(f"a group has more than {most} variants")
        found = agglomerative(distance_matrix([V.from_json(r) for r in raw]), most_distance)
        return pd.DataFrame({"variant_json": raw, "within": pdf["cluster"].iloc[0], "part": found})

    made = groups.groupBy("cluster").applyInPandas(run, f"variant_json string, within {kind}, part int")
    return made.select("variant_json", F.concat_ws("/", F.col("within").cast("string"), F.col("part").cast("string")).alias("cluster"))


def label_counts(variants: DataFrame) -> DataFrame:
    """variant_json, label, n."""
    return variants.select("variant_json", F.explode(label_array()).alias("label")).groupBy("variant_json", "label").agg(F.count("*").alias("n"))


def _vectors(variants: DataFrame, most_labels: int = 10_000) -> DataFrame:
    counts = label_counts(variants)
    names = sorted(r["label"] for r in counts.select("label").distinct().limit(most_labels + 1).collect())
    if len(names) > most_labels:
        raise ValueError(f"more than {most_labels} labels")
    number = {x: i for i, x in enumerate(names)}
    to_vector = F.udf(lambda own: Vectors.sparse(len(number), sorted((number[x["label"]], float(x["n"])) for x in own)), VectorUDT())
    return counts.groupBy("variant_json").agg(F.collect_list(F.struct("label", "n")).alias("own")).select("variant_json", to_vector("own").alias("features"))


def cluster_by_labels(variants: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """variant_json, cluster by k-means on label counts."""
    v = _vectors(variants)
    model = KMeans(k=k, seed=seed).fit(v)
    return model.transform(v).select("variant_json", F.col("prediction").alias("cluster"))


def mixture_clusters(variants: DataFrame, k: int, least: float = 0.3, seed: int = 0) -> DataFrame:
    """variant_json, cluster: every component of a Gaussian mixture with at least this probability."""
    v = _vectors(variants)
    model = GaussianMixture(k=k, seed=seed).fit(v)
    p = F.udf(lambda x: [float(y) for y in x], "array<double>")
    rows = model.transform(v).select("variant_json", F.posexplode(p("probability")).alias("cluster", "p"))
    return rows.where(F.col("p") >= least).select("variant_json", "cluster")


def cluster_by_start(variants: DataFrame) -> DataFrame:
    """variant_json, cluster: the first label in depth-first order."""
    return variants.select("variant_json", F.get(label_array(), F.lit(0)).alias("cluster"))


def largest_clusters(clusters: DataFrame, n: int) -> DataFrame:
    """Only the n clusters with the most members."""
    best = clusters.groupBy("cluster").agg(F.count("*").alias("size")).orderBy(F.desc("size"), "cluster").limit(n)
    return clusters.join(F.broadcast(best.select("cluster")), "cluster", "left_semi")
