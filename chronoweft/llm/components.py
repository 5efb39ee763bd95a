"""Connected components by alternating large-star and small-star steps.

Edges point from the larger node ``u`` to the smaller ``v``. Every step is a minimum per node (combined before its
shuffle) and a join of the edges with it, and each round is written to the shared folder and the round before
it deleted. Where a node has so many edges that they would make a join's task long, there are few such nodes
(at most 2 * HOT_SHARE, by their degree): their minima are broadcast, and their edges aren't shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweft.llm.common import cut, drop_cut

HOT_SHARE = 50_000
"""A node with more than this part of all edges, and more than LEAST_HOT, is hot."""
LEAST_HOT = 100_000


def _least(edges: DataFrame) -> DataFrame:
    """(node, m): each node that has smaller neighbours with the least of them."""
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m"))


def _looked_up(edges: DataFrame, key: str, least: DataFrame, how: str, hot_degree: int | None) -> DataFrame:
    """(u, v, m) of each edge, m being that of its node ``key``."""
    plain = lambda rows: rows.join(least.withColumnRenamed("node", key), key, how).select("u", "v", "m")
    if hot_degree is None:
        return plain(edges)
    many = edges.groupBy(F.col(key).alias("hot")).agg(F.count("*").alias("n")).where(F.col("n") > hot_degree).select("hot")
    known = many.join(least, F.col("hot") == F.col("node"), how).select("hot", F.col("m").alias("hot_m"))
    split = edges.join(F.broadcast(known), edges[key] == F.col("hot"), "left")
    return plain(split.where("hot IS NULL").select("u", "v")).unionByName(split.where("hot IS NOT NULL").select("u", "v", F.col("hot_m").alias("m")))


def _large_star(edges: DataFrame, hot_degree: int | None) -> DataFrame:
    """Each node's larger neighbours point to the least of it and its neighbours."""
    found = _looked_up(edges, "v", _least(edges), "left", hot_degree)
    return found.select("u", F.coalesce("m", "v").alias("v")).distinct()


def _small_star(edges: DataFrame, hot_degree: int | None) -> DataFrame:
    """Each node and its smaller neighbours point to the least of these."""
    least = _least(edges)
    moved = _looked_up(edges, "u", least, "inner", hot_degree).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select(F.col("node").alias("u"), F.col("m").alias("v"))).where("u <> v").distinct()


def _hot_degree(edges: DataFrame, n: int) -> int | None:
    """The degree from which a node is hot; None if no node is."""
    limit = max(LEAST_HOT, n // HOT_SHARE)
    if n <= limit:
        return None
    most = edges.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).first()["n"]
    return limit if most > limit else None


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) of every node in ``edges`` (u, v: longs); the root is the component's least node."""
    down = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    now = cut(down.distinct(), "edges")
    mark, n = None, now.count()
    for _ in range(most_rounds):
        if not n:
            break
        hot = _hot_degree(now, n)
        new = cut(_small_star(_large_star(now, hot), hot), "edges")
        drop_cut(now)
        now = new
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        n = seen["n"]
        if (seen["n"], seen["h"]) == mark:
            break
        mark = (seen["n"], seen["h"])
    else:
        raise RuntimeError("components didn't settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
