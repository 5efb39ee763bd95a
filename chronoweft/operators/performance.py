"""Service, waiting, idle and cycle times of cases and of the nodes of their variants."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoweft.functions.stats import seconds_between, statistics
from chronoweft.operators.variants import Known, case_subvariants, in_slices, signatures
from chronoweft.plans import variant_tree as V
from chronoweft.sources.logs import truncated


def _placed(tree: V.Tree, names: list[str]) -> tuple[str, V.Tree]:
    """The text of a tree whose leaves are instance numbers, and the tree in canonical order."""
    kind, parts = tree
    if kind == "leaf":
        if len(parts) == 1:
            return names[parts[0]], tree
        own = sorted(parts, key=lambda i: (names[i], i))
        return V.text(("leaf", tuple([names[i] for i in own]))), ("leaf", tuple(own))
    made = [_placed(c, names) for c in parts]
    if kind in V.UNORDERED:
        made.sort(key=lambda x: x[0])
    return f"{V.SIGNS[kind]}({', '.join([x[0] for x in made])})", (kind, tuple([x[1] for x in made]))


def _nodes(acts: list[str], s: list[int], t: list[int]) -> tuple[str, list[tuple]]:
    """A case's variant, and (node, parent, the parent's kind, left neighbour, kind, place among its siblings,
    label, instances) of its nodes."""
    name, tree = _placed(V.cut_times(s, t), acts)
    out: list[tuple] = []

    def walk(tr: V.Tree, parent: int, above: str | None, left: int, place: int) -> tuple[int, list[int]]:
        me = len(out)
        kind, parts = tr
        if kind == "leaf":
            at = list(parts)
            out.append((me, parent, above, left, kind, place, acts[at[0]] if len(at) == 1 else ", ".join([acts[i] for i in at]), at))
            return me, at
        out.append(())
        at, before = [], -1
        for k, c in enumerate(parts):
            before, own = walk(c, me, kind, before, k)
            at += own
        out[me] = (me, parent, above, left, kind, place, V.SIGNS[kind], at)
        return me, at

    walk(tree, -1, None, -1, 0)
    return name, out


_NODE = {"node": pa.int32(), "parent": pa.int32(), "parent_kind": pa.string(), "left": pa.int32(), "kind": pa.string(), "place": pa.int32(), "label": pa.string(), "at": pa.list_(pa.int32())}
NODE = "array<struct<node: int, parent: int, parent_kind: string, left: int, kind: string, place: int, label: string, at: array<int>>>"


def node_times(log: DataFrame, granularity: str = "ms") -> DataFrame:
    """case_id, variant, node, parent, parent_kind, kind, place, label, start_ts, end_ts of each node of each case's
    variant; parent_start, parent_end, and before_ts, the end of its left neighbour.

    One exchange, on the case: Python gets the ranks of the times alone, and what nodes need of each other is
    looked up in their case's arrays."""
    rows = signatures(log, granularity, times=True)
    kind = dict(rows.dtypes)["case_id"]
    times = "starts array<timestamp_ntz>, ends array<timestamp_ntz>"

    def make(acts: list[str], s: list[int], t: list[int]) -> tuple[tuple[str, list[tuple]], int]:
        name, nodes = _nodes(acts, s, t)
        return (name, nodes), sum(1 + len(n[-1]) for n in nodes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known(make)
        for b in in_slices(batches):
            made = [known.get(*x) for x in zip(*(b.column(k).to_pylist() for k in (1, 2, 3)), strict=True)]
            upto = pa.array([0, *accumulate(len(nodes) for _, nodes in made)], pa.int32())
            columns = zip(*(n for _, nodes in made for n in nodes), strict=True)
            nodes = pa.StructArray.from_arrays([pa.array(c, kind) for c, kind in zip(columns, _NODE.values(), strict=True)], list(_NODE))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([m[0] for m in made], pa.string()), pa.ListArray.from_arrays(upto, nodes), b.column(4), b.column(5)], ["case_id", "variant", "nodes", "starts", "ends"])

    shaped = rows.mapInArrow(run, f"case_id {kind}, variant string, nodes {NODE}, {times}")
    of = lambda name, least, n: least(F.transform(n["at"], lambda i: F.get(name, i)))
    spans = F.transform("nodes", lambda n: F.struct(of("starts", F.array_min, n).alias("a"), of("ends", F.array_max, n).alias("b")))
    flat = shaped.withColumn("spans", spans).select("case_id", "variant", "spans", F.explode("nodes").alias("n"))
    at = lambda k, part: F.get("spans", F.col(f"n.{k}"))[part]
    return flat.select(
        "case_id", "variant", "n.node", "n.parent", "n.parent_kind", "n.kind", "n.place", "n.label", at("node", "a").alias("start_ts"), at("node", "b").alias("end_ts"),
        at("parent", "a").alias("parent_start"), at("parent", "b").alias("parent_end"), at("left", "b").alias("before_ts"),
    )


def service_times(nodes: DataFrame, digits: int | None = None) -> DataFrame:
    """Statistics over cases of the time from a node's first start to its last end."""
    return nodes.groupBy("variant", "node", "label").agg(*statistics(seconds_between("start_ts", "end_ts"), digits))


def sequence_waits(nodes: DataFrame) -> DataFrame:
    """case_id, variant, node, wait: from the end of a node's left neighbour in a sequence to its start."""
    inside = nodes.where("parent_kind = 'follows' AND before_ts IS NOT NULL")
    return inside.select("case_id", "variant", "node", seconds_between("before_ts", "start_ts").alias("wait"))


def parallel_waits(nodes: DataFrame) -> DataFrame:
    """case_id, variant, node, wait_start, wait_end: from a parallel's start to a child's, and from the child's
    end to the parallel's."""
    inside = nodes.where("parent_kind = 'parallel'")
    return inside.select("case_id", "variant", "node", seconds_between("parent_start", "start_ts").alias("wait_start"), seconds_between("end_ts", "parent_end").alias("wait_end"))


def merged_service(log: DataFrame) -> DataFrame:
    """case_id, start_ts, end_ts of the maximal spans in which something of a case runs."""
    order = Window.partitionBy("case_id").orderBy("start_ts", "end_ts", "pos")
    reach = F.max("end_ts").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = log.withColumn("new", F.coalesce((F.col("start_ts") > reach).cast("int"), F.lit(1)))
    return marked.withColumn("span", F.sum("new").over(order)).groupBy("case_id", "span").agg(F.min("start_ts").alias("start_ts"), F.max("end_ts").alias("end_ts")).drop("span")


def idle_times(log: DataFrame) -> DataFrame:
    """case_id, start_ts, end_ts of the gaps between those spans."""
    after = F.lead("start_ts").over(Window.partitionBy("case_id").orderBy("start_ts"))
    return merged_service(log).select("case_id", F.col("end_ts").alias("start_ts"), after.alias("end_ts")).where("end_ts IS NOT NULL")


def cycle_times(log: DataFrame) -> DataFrame:
    """case_id and, in seconds, its cycle, service and idle time."""
    s = merged_service(log).groupBy("case_id").agg(seconds_between(F.min("start_ts"), F.max("end_ts")).alias("cycle"), F.sum(seconds_between("start_ts", "end_ts")).alias("service"))
    return s.withColumn("idle", F.col("cycle") - F.col("service"))


def subvariant_waits(log: DataFrame, granularity: str = "ms") -> DataFrame:
    """case_id, step, from_name, to_name, wait: between consecutive times of a case, backward from the first
    completion of the step before to each start, or forward from each completion to the first start; the
    larger set counts, backward if they are equal."""
    e = log.select("case_id", "pos", "activity", truncated("start_ts", granularity).alias("s"), truncated("end_ts", granularity).alias("t"))
    number = F.row_number().over(Window.partitionBy("case_id", "activity").orderBy("s", "t", "pos")) - 1
    e = e.withColumn("name", F.concat("activity", F.lit("#"), number))
    both = F.explode(F.array(F.struct(F.col("s").alias("at"), F.lit("s").alias("k")), F.struct(F.col("t").alias("at"), F.lit("c").alias("k"))))
    of = lambda k: F.array_sort(F.collect_list(F.when(F.col("k") == k, F.col("name"))))
    steps = e.select("case_id", "name", both.alias("x")).select("case_id", "name", "x.*").groupBy("case_id", "at").agg(of("s").alias("starts"), of("c").alias("ends"))
    order = Window.partitionBy("case_id").orderBy("at")
    steps = steps.select("case_id", F.row_number().over(order).alias("step"), "at", "starts", F.lag("at").over(order).alias("was"), F.lag("ends").over(order).alias("ended"))
    steps = steps.where("size(ended) > 0 AND size(starts) > 0")
    pair = lambda a, b: F.struct(a.alias("from_name"), b.alias("to_name"))
    back = F.transform("starts", lambda x: pair(F.get("ended", F.lit(0)), x))
    forth = F.transform("ended", lambda x: pair(x, F.get("starts", F.lit(0))))
    chosen = F.when(F.size("starts") >= F.size("ended"), back).otherwise(forth)
    return steps.select("case_id", "step", F.explode(chosen).alias("p"), seconds_between("was", "at").alias("wait")).select("case_id", "step", "p.from_name", "p.to_name", "wait")


def subvariant_durations(log: DataFrame, granularity: str = "ms", digits: int | None = None) -> DataFrame:
    """Statistics of the whole duration of the cases of each sub-variant."""
    spans = log.groupBy("case_id").agg(seconds_between(F.min("start_ts"), F.max("end_ts")).alias("x"))
    return spans.join(case_subvariants(log, granularity), "case_id").groupBy("steps", "subvariant").agg(*statistics("x", digits)).drop("steps")


def subvariant_services(log: DataFrame, granularity: str = "ms", digits: int | None = None) -> DataFrame:
    """Statistics of the duration of each numbered instance in each sub-variant."""
    number = F.row_number().over(Window.partitionBy("case_id", "activity").orderBy(truncated("start_ts", granularity), truncated("end_ts", granularity), "pos")) - 1
    named = log.select("case_id", F.concat("activity", F.lit("#"), number).alias("name"), seconds_between("start_ts", "end_ts").alias("x"))
    return named.join(case_subvariants(log, granularity), "case_id").groupBy("steps", "subvariant", "name").agg(*statistics("x", digits)).drop("steps")


def subvariant_wait_statistics(log: DataFrame, granularity: str = "ms", digits: int | None = None) -> DataFrame:
    """Statistics of the waits between the steps of each sub-variant."""
    waits = subvariant_waits(log, granularity).join(case_subvariants(log, granularity), "case_id")
    return waits.groupBy("steps", "subvariant", "step", "from_name", "to_name").agg(*statistics("wait", digits)).drop("steps")
