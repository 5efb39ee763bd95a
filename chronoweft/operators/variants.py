"""Variants of a log: cases grouped by how their activities follow one another or overlap.

A case's signature, its activities with the ranks of their times, is made by the JVM in one exchange on the
case. Python only turns signatures into variants, each distinct one once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoweft.plans import variant_tree as V
from chronoweft.session import together
from chronoweft.sources.logs import truncated

CACHED = 200_000
"""What a task keeps of signatures it has met, as a number of instances and nodes."""
AT_ONCE = 1_000
"""So many cases are Python objects at a time."""
TOGETHER = 50_000
"""Instances whose cases are cut at once, if no case is longer."""
HELD = 20_000_000
"""Characters of variants that a task counts before it passes them on."""


class Known:
    """What a function gives for signatures (acts, s, t), with its size. When more than CACHED is held, all is
    forgotten: memory depends neither on how many distinct signatures a task meets nor on how long they are."""

    def __init__(self, make: Callable[[list[str], list[int], list[int]], tuple[object, int]]):
        self.make, self.of, self.held = make, {}, 0

    def get(self, acts: list[str], s: list[int], t: list[int]):
        key = (tuple(acts), tuple(s), tuple(t))
        if key in self.of:
            return self.of[key]
        found, size = self.make(acts, s, t)
        if self.held + size > CACHED:
            self.of.clear()
            self.held = 0
        if size <= CACHED:
            self.of[key] = found
            self.held += size
        return found


def in_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of at most AT_ONCE rows."""
    for b in batches:
        yield from (b.slice(i, AT_ONCE) for i in range(0, b.num_rows, AT_ONCE))


def signatures(log: DataFrame, granularity: str = "ms", times: bool = False) -> DataFrame:
    """case_id, acts, s, t: activities in order, and the ranks of their starts and ends in the case; ``times``
    adds the arrays starts and ends, of the times as they are."""
    raw = [F.col("start_ts").alias("from"), F.col("end_ts").alias("to")] if times else []
    item = F.struct("pos", F.col("activity").alias("a"), truncated("start_ts", granularity).alias("s"), truncated("end_ts", granularity).alias("t"), *raw)
    c = log.groupBy("case_id").agg(F.sort_array(F.collect_list(item)).alias("x"))
    c = c.withColumn("times", F.sort_array(F.array_compact(F.array_distinct(F.concat(F.col("x.s"), F.col("x.t"))))))
    rank = lambda times: F.transform(times, lambda v: F.array_position("times", v).cast("int"))
    return c.select("case_id", F.col("x.a").alias("acts"), rank(F.col("x.s")).alias("s"), rank(F.col("x.t")).alias("t"), *([F.col("x.from").alias("starts"), F.col("x.to").alias("ends")] if times else []))


def _cut(df: DataFrame, keep: list[str], change: Callable[[V.Tree], V.Tree] | None = None) -> DataFrame:
    """``df`` (acts, s, t and ``keep``) with the variant's JSON and text."""
    types = dict(df.dtypes)
    schema = ", ".join([*(f"{k} {types[k]}" for k in keep), "variant_json string", "variant string"])

    def make(acts: list[str], s: list[int], t: list[int]) -> tuple[tuple[str, str], int]:
        tree = V.variant_of(acts, s, t)
        tree = V.canonical(change(tree)) if change else tree
        return (V.to_json(tree), V.text(tree)), len(acts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known(make)
        for b in in_slices(batches):
            made = [known.get(*x) for x in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("acts", "s", "t")), strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(k)) for k in keep), pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.string())], [*keep, "variant_json", "variant"])

    return df.mapInArrow(run, schema)


def case_variants(log: DataFrame, granularity: str = "ms") -> DataFrame:
    """case_id, variant_json and variant of each case."""
    return _cut(signatures(log, granularity), ["case_id"])


def variants(log: DataFrame, granularity: str = "ms", change: Callable[[V.Tree], V.Tree] | None = None) -> DataFrame:
    """variant_json, variant, n_cases and n_graphs. Signatures are counted before Python sees them. ``change``
    rewrites each variant, as :func:`variant_tree.collapse` does."""
    counted = signatures(log, granularity).groupBy("acts", "s", "t").agg(F.count("*").alias("n"))
    return _cut(counted, ["n"], change).groupBy("variant_json", "variant").agg(F.sum("n").alias("n_cases"), F.count("*").alias("n_graphs"))


def trees(log: DataFrame, granularity: str = "ms") -> DataFrame:
    """variant_json and n_cases, as :func:`variants` has them, of a log whose places are in the order of starts, as
    those of all views are.

    Such a case is a sequence of parts that hang together by overlaps, and its tree that of the parts': so cases are
    cut in arrays, many at once, and Python makes trees of distinct parts alone. Neither places nor signatures are
    made. Cases with an end before its start, where the order of equal starts counts, or with nulls go the way of
    :func:`variants`; whether there are any is looked up first, in a job of its own."""
    odd = log.where(~F.coalesce(F.col("start_ts") <= F.col("end_ts"), F.lit(False)) | F.col("activity").isNull())
    if odd.select(F.lit(1)).isEmpty():
        return _trees(_cut_at_once(log, granularity))
    ids = odd.select(F.col("case_id").alias("odd_id")).distinct()
    of = F.col("case_id").eqNullSafe(F.col("odd_id"))
    other = variants(log.join(ids, of, "left_semi"), granularity).select("variant_json", F.col("n_cases").alias("n"))
    return _trees(_cut_at_once(log.join(ids, of, "left_anti"), granularity).unionByName(other))


def _trees(counted: DataFrame) -> DataFrame:
    return counted.groupBy("variant_json").agg(F.sum("n").alias("n_cases"))


def _cut_at_once(log: DataFrame, granularity: str) -> DataFrame:
    """variant_json and n, the number of some task's cases with it."""
    rows = log.select("case_id", "activity", truncated("start_ts", granularity).alias("s"), truncated("end_ts", granularity).alias("t"))

    # whole numbers are sorted by their prefix alone, and what is sorted inside a case is sorted in arrays
    whole = dict(rows.dtypes)["case_id"] in ("tinyint", "smallint", "int", "bigint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = parts_known()
        sums: dict[str, int] = {}
        held = 0
        for chunk in _whole_cases(_opened(batches) if whole else batches):
            for raw, n in _cut_chunk(chunk, known):
                if raw not in sums:
                    held += len(raw)
                    sums[raw] = n
                else:
                    sums[raw] += n
            if held > HELD:
                yield from _counts(sums)
                sums, held = {}, 0
        yield from _counts(sums)

    if whole:
        rows = together(rows, "case_id").sortWithinPartitions("case_id")
    else:
        rows = rows.select(F.row_number().over(Window.partitionBy("case_id").orderBy("s")).alias("k"), "activity", "s", "t")
    return rows.mapInArrow(run, "variant_json string, n long")


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of case_id, a whole number or null, with a 1 for the first of each case in its place."""
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        ids, null = b.column(0).fill_null(0).to_numpy(), b.column(0).is_null().to_numpy(zero_copy_only=False)
        opens = np.ones(b.num_rows, np.int32)
        opens[1:] = (ids[1:] != ids[:-1]) | (null[1:] != null[:-1])
        opens[0] = last != (ids[0], null[0])
        last = ids[-1], null[-1]
        yield pa.RecordBatch.from_arrays([pa.array(opens), *b.columns[1:]], ["k", "activity", "s", "t"])


@cache
def parts_known() -> Known:
    """The JSON of parts of cases (acts, none, the last that each one overlaps), which a Python worker remembers from
    task to task."""
    return Known(lambda acts, _, reach: (_json(V.variant_of(acts, list(range(len(acts))), reach)), len(acts)))


def _json(tree: V.Tree) -> str:
    """What :func:`variant_tree.to_json` gives."""
    kind, parts = tree
    return _leaf_json(parts) if kind == "leaf" else f'{{"{kind}":[{",".join([_json(c) for c in parts])}]}}'


@lru_cache(10_000)
def _leaf_json(labels: tuple[str, ...]) -> str:
    return V.to_json(("leaf", labels))


def _counts(sums: dict[str, int]) -> Iterator[pa.RecordBatch]:
    raw, n = list(sums), list(sums.values())
    for i in range(0, len(raw), 10_000):
        yield pa.RecordBatch.from_arrays([pa.array(raw[i : i + 10_000], pa.string()), pa.array(n[i : i + 10_000], pa.int64())], ["variant_json", "n"])


def _whole_cases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of whole cases (k, 1 in the first of each alone), TOGETHER or more at a time."""
    waiting: list[pa.RecordBatch] = []
    rows = 0
    for b in batches:
        starts = np.flatnonzero(b.column(0).to_numpy() == 1)
        if rows + b.num_rows > TOGETHER and len(starts) and (rows or starts[-1]):
            last = int(starts[-1])
            yield pa.Table.from_batches([*waiting, b.slice(0, last)])
            waiting, rows = [b.slice(last)], b.num_rows - last
        elif b.num_rows:
            waiting.append(b)
            rows += b.num_rows
    if waiting:
        yield pa.Table.from_batches(waiting)


def _numbered(columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A row for each distinct row of an array of small numbers, and the number of each row's."""
    n = len(columns)
    if n < 16:
        return np.arange(n), np.arange(n)
    key, size = columns[:, 0].astype(np.int64), int(columns[:, 0].max()) + 1
    for k in range(1, columns.shape[1]):
        base = int(columns[:, k].max()) + 1
        if size * base >= 1 << 62:
            found, key = np.unique(key, return_inverse=True)
            size = len(found)
        key, size = key * base + columns[:, k], size * base
    _, first, number = np.unique(key, return_index=True, return_inverse=True)
    return first, number


def _cut_chunk(chunk: pa.Table, known: Known) -> Iterator[tuple[str, int]]:
    """variant_json and a number of cases, of whole cases (as of :func:`_whole_cases`), none with an end before
    its start."""
    coded = chunk.column(1).combine_chunks().dictionary_encode()
    names = coded.dictionary.to_pylist()
    by_name = sorted(range(len(names)), key=names.__getitem__)
    names = [names[i] for i in by_name]
    act = np.argsort(by_name)[coded.indices.to_numpy(zero_copy_only=False)]
    opens = chunk.column(0).to_numpy() == 1
    n = len(act)
    # times as ranks, later cases' above earlier ones'
    found, ranks = np.unique(np.concatenate([chunk.column(2).to_numpy(), chunk.column(3).to_numpy()]), return_inverse=True)
    above = (np.cumsum(opens) - 1) * len(found)
    s, t = ranks[:n] + above, ranks[n:] + above
    by_start = np.argsort(s, kind="stable")
    s, t, act = s[by_start], t[by_start], act[by_start]
    part_at = np.flatnonzero(np.concatenate([[True], s[1:] > np.maximum.accumulate(t)[:-1]]))
    size = np.diff(np.append(part_at, n))
    # of instances in the order of starts, the last that began before one's end tells which it overlaps
    reach = np.searchsorted(s, t, side="right") - 1
    leaves = [V.to_json(V.leaf(x)) for x in names]
    texts: list[str] = list(leaves)
    number = act[part_at]
    for m in np.unique(size[size > 1]):
        own = np.flatnonzero(size == m)
        at = part_at[own][:, None] + np.arange(m)
        acts = act[at]
        if m == 2:
            acts.sort(axis=1)
            first, of = _numbered(acts)
            made = ['{"parallel":[' + leaves[a] + "," + leaves[b] + "]}" for a, b in acts[first].tolist()]
        else:
            local = reach[at] - part_at[own][:, None]
            first, of = _numbered(np.concatenate([acts, local], axis=1))
            made = [known.get([names[i] for i in a], [], r) for a, r in zip(acts[first].tolist(), local[first].tolist(), strict=True)]
        number[own] = of + len(texts)
        texts += made
    case_at = np.flatnonzero(opens[part_at])
    parts = np.diff(np.append(case_at, len(part_at)))
    for m in np.unique(parts):
        at = case_at[parts == m][:, None] + np.arange(m)
        first, of = _numbered(number[at])
        for row, count in zip(number[at[first]].tolist(), np.bincount(of).tolist(), strict=True):
            yield (texts[row[0]] if m == 1 else '{"follows":[' + ",".join([texts[i] for i in row]) + "]}"), count


def treebank(log: DataFrame, granularity: str = "ms", borders: bool = False, by_case: bool = False) -> DataFrame:
    """Variants, those with the most cases first; ``borders`` puts artificial activities at their ends, and
    ``by_case`` gives each case a row of its own, with its case_id and an n_cases of 1."""
    if by_case:
        out = _cut(signatures(log, granularity), ["case_id"], V.with_borders if borders else None)
        return out.withColumn("n_cases", F.lit(1).cast("long")).orderBy("variant_json", "case_id")
    return variants(log, granularity, V.with_borders if borders else None).orderBy(F.desc("n_cases"), "variant_json")


#: The list of a leaf's labels, as JSON strings, in a variant's JSON.
_LEAF = r'"leaf":\[((?:"(?:[^"\\]++|\\.)*+",?+)*+)\]'


def label_array(variant_json: str = "variant_json") -> Column:
    """All labels of a variant's JSON, in depth-first order."""
    lists = F.regexp_extract_all(F.col(variant_json), F.lit(_LEAF), 1)
    return F.flatten(F.transform(lists, lambda x: F.from_json(F.concat(F.lit("["), x, F.lit("]")), "array<string>")))


def sequence_variants(log: DataFrame) -> DataFrame:
    """acts, variant and n_cases, activities in order and overlaps ignored: no Python at all. ``acts`` tells
    sequences apart, ``variant`` is their text and need not."""
    acts = F.transform(F.array_sort(F.collect_list(F.struct("pos", "activity"))), lambda x: x["activity"])
    seq = log.groupBy("case_id").agg(acts.alias("acts"))
    return seq.groupBy("acts").agg(F.count("*").alias("n_cases")).select("acts", F.array_join("acts", ",").alias("variant"), "n_cases")


def collapsed_sequences(log: DataFrame) -> DataFrame:
    """runs, variant and n_cases, runs (a, again) of one activity written once, with a star if they are longer."""
    case = Window.partitionBy("case_id").orderBy("pos")
    run = log.withColumn("new", (F.lag("activity").over(case) != F.col("activity")).cast("int"))
    run = run.withColumn("run", F.sum(F.coalesce("new", F.lit(1))).over(case))
    runs = run.groupBy("case_id", "run").agg(F.first("activity").alias("a"), (F.count("*") > 1).alias("again"))
    whole = F.transform(F.array_sort(F.collect_list(F.struct("run", "a", "again"))), lambda x: F.struct(x["a"].alias("a"), x["again"].alias("again")))
    counted = runs.groupBy("case_id").agg(whole.alias("runs")).groupBy("runs").agg(F.count("*").alias("n_cases"))
    text = F.array_join(F.transform("runs", lambda x: F.concat(x["a"], F.when(x["again"], "*").otherwise(""))), ",")
    return counted.select("runs", text.alias("variant"), "n_cases")


def case_subvariants(log: DataFrame, granularity: str = "ms") -> DataFrame:
    """case_id, steps and subvariant: starts and completions by equal time, instances numbered by activity.

    A step is a list of events; an event is activity, number, s or c. In the text, a step joins its events
    with ``+``, and steps are joined with ``|``."""
    e = log.select("case_id", "pos", "activity", truncated("start_ts", granularity).alias("s"), truncated("end_ts", granularity).alias("t"))
    number = F.row_number().over(Window.partitionBy("case_id", "activity").orderBy("s", "t", "pos")) - 1
    e = e.withColumn("name", F.concat("activity", F.lit("#"), number))
    both = F.explode(F.array(F.struct(F.col("s").alias("at"), F.concat("name", F.lit("s")).alias("ev")), F.struct(F.col("t").alias("at"), F.concat("name", F.lit("c")).alias("ev"))))
    steps = e.select("case_id", both.alias("x")).groupBy("case_id", "x.at").agg(F.array_sort(F.collect_list("x.ev")).alias("step"))
    whole = steps.groupBy("case_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "step"))), lambda x: x["step"]).alias("steps"))
    return whole.select("case_id", "steps", F.array_join(F.transform("steps", lambda x: F.array_join(x, "+")), "|").alias("subvariant"))


def subvariants(log: DataFrame, granularity: str = "ms") -> DataFrame:
    """steps, subvariant and n_cases."""
    return case_subvariants(log, granularity).groupBy("steps", "subvariant").agg(F.count("*").alias("n_cases"))


def with_sequentialisations(trees: DataFrame, most: int = V.MOST_SEQUENTIALISATIONS, seed: int = 0) -> DataFrame:
    """``trees`` (variant_json) with one row for each of a variant's linear extensions, or for a random sample of
    ``most`` where there are more; ``whole`` says whether a variant's rows are all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw in b.column(0).to_pylist():
                made, whole = V.bounded_sequentialisations(V.from_json(raw), most, seed)
                for i in range(0, len(made), 10_000):
                    part = made[i : i + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array([raw] * len(part), pa.string()), pa.array(part, pa.list_(pa.string())), pa.array([whole] * len(part))], ["variant_json", "sequence", "whole"])

    return trees.select("variant_json").mapInArrow(run, "variant_json string, sequence array<string>, whole boolean")


def _mapped(trees: DataFrame, what: Callable[[V.Tree], list[tuple]], fields: dict[str, tuple[str, pa.DataType]]) -> DataFrame:
    """``trees`` (variant_json, and others that stay) with the rows that a function of the tree gives."""
    kept = trees.columns
    at = kept.index("variant_json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            index, rows = [], []
            for i, raw in enumerate(b.column(at).to_pylist()):
                found = what(V.from_json(raw))
                index += [i] * len(found)
                rows += found
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(fields)
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(index, pa.int64())) for c in b.columns), *(pa.array(c, kind) for c, (_, kind) in zip(columns, fields.values(), strict=True))], [*kept, *fields])

    return trees.mapInArrow(run, ", ".join([*(f"`{n}` {k}" for n, k in trees.dtypes), *(f"{n} {k}" for n, (k, _) in fields.items())]))


def extension_counts(trees: DataFrame) -> DataFrame:
    """``trees`` with n_extensions, the number of linear extensions, as a decimal."""
    found = _mapped(trees, lambda t: [(str(V.n_sequentialisations(t)),)], {"n_extensions": ("string", pa.string())})
    return found.withColumn("n_extensions", F.col("n_extensions").cast("decimal(38,0)"))


def fragment_counts(trees: DataFrame, fragment: V.Tree, where: str = "PROPER_INFIX") -> DataFrame:
    """``trees`` with n_found: how often a fragment stands in a variant."""
    return _mapped(trees, lambda t: [(V.count_fragment(t, fragment, where),)], {"n_found": ("int", pa.int32())})


def parts(trees: DataFrame) -> DataFrame:
    """``trees`` with a row for each part of what a variant is a sequence of (the variant itself, if it is none), and
    for each child of a parallel part: part (from 1), kind and labels, in order."""

    def rows(tree: V.Tree) -> list[tuple]:
        out = []
        for k, part in enumerate(tree[1] if tree[0] == "follows" else (tree,), 1):
            inside = part[1] if part[0] == "parallel" else (part,)
            out += [(k, "unknown" if part[0] == "leaf" and len(part[1]) > 1 else part[0], sorted(V.labels(c))) for c in inside]
        return out

    return _mapped(trees, rows, {"part": ("int", pa.int32()), "kind": ("string", pa.string()), "labels": ("array<string>", pa.list_(pa.string()))})


def add_borders(log: DataFrame, start: str = "▶", end: str = "■") -> DataFrame:
    """An artificial first and last activity in each case, at its first and last times."""
    edge = log.groupBy("case_id").agg(F.min("start_ts").alias("a"), F.max("end_ts").alias("b"), F.max("pos").alias("n"))
    first = edge.select("case_id", F.lit(0).alias("pos"), F.lit(start).alias("activity"), F.col("a").alias("start_ts"), F.col("a").alias("end_ts"))
    last = edge.select("case_id", (F.col("n") + 1).alias("pos"), F.lit(end).alias("activity"), F.col("b").alias("start_ts"), F.col("b").alias("end_ts"))
    return log.select("case_id", "pos", "activity", "start_ts", "end_ts").unionByName(first).unionByName(last).withColumn("pos", F.col("pos") + 1)


def remove_borders(log: DataFrame, start: str = "▶", end: str = "■") -> DataFrame:
    kept = log.where(~F.col("activity").isin(start, end))
    return kept.withColumn("pos", F.row_number().over(Window.partitionBy("case_id").orderBy("pos")))


def as_log(trees: DataFrame) -> DataFrame:
    """An interval log with one case for each row of ``trees`` (variant_json), named by it: queries and
    relations then apply to variants that no case has, such as rewritten ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(raw, k, *e) for raw in b.column(0).to_pylist() for k, e in enumerate(V.intervals(V.from_json(raw)), 1)]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64()], strict=True)], ["case_id", "pos", "activity", "s", "t"])

    flat = trees.select("variant_json").mapInArrow(run, "case_id string, pos int, activity string, s long, t long")
    at = lambda c: F.timestamp_seconds(c).cast("timestamp_ntz")
    return flat.select("case_id", "pos", "activity", at("s").alias("start_ts"), at("t").alias("end_ts"))
