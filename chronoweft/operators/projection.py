"""Logs projected on sets of activities, fragments of them, and the measures built on that."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SKIP = "..."
EPSILON = 0.001


def project(log: DataFrame, labels: list[str]) -> DataFrame:
    """The events with these labels; ``orig_pos`` keeps their places."""
    kept = log.where(F.col("activity").isin(labels)).withColumn("orig_pos", F.col("pos"))
    return kept.withColumn("pos", F.row_number().over(Window.partitionBy("case_id").orderBy("orig_pos")))


def project_with_skips(log: DataFrame, labels: list[str]) -> DataFrame:
    """case_id, pos, activity: each maximal run of other events between kept ones is one ``...``."""
    case = Window.partitionBy("case_id").orderBy("pos")
    e = log.select("case_id", "pos", "activity", F.col("activity").isin(labels).alias("kept"))
    kept = e.where("kept").withColumn("before", F.lag("pos").over(case))
    skip = F.col("before").isNotNull() & (F.col("pos") > F.col("before") + 1)
    parts = F.array_compact(F.array(F.when(skip, F.lit(SKIP)), F.col("activity")))
    flat = kept.select("case_id", F.col("pos").alias("orig"), F.posexplode(parts).alias("k", "activity"))
    return flat.select("case_id", F.row_number().over(Window.partitionBy("case_id").orderBy("orig", "k")).alias("pos"), "activity")


def project_with_time_skips(log: DataFrame, labels: list[str]) -> DataFrame:
    """As :func:`project_with_skips`, but a skip stands only where a dropped event lies strictly between, in
    time, the kept ones on both sides."""
    case = Window.partitionBy("case_id").orderBy("pos")
    e = log.select("case_id", "pos", "activity", "start_ts", "end_ts", F.col("activity").isin(labels).alias("kept"))
    last_kept = F.last(F.when(F.col("kept"), F.col("end_ts")), ignorenulls=True).over(case.rowsBetween(Window.unboundedPreceding, -1))
    backwards = Window.partitionBy("case_id").orderBy(F.desc("pos"))
    next_kept = F.last(F.when(F.col("kept"), F.col("start_ts")), ignorenulls=True).over(backwards.rowsBetween(Window.unboundedPreceding, -1))
    e = e.withColumn("between", ~F.col("kept") & (F.col("start_ts") > last_kept) & (F.col("end_ts") < next_kept))
    e = e.withColumn("group", F.sum(F.col("kept").cast("int")).over(case))
    gap = e.groupBy("case_id", "group").agg(F.max(F.coalesce("between", F.lit(False))).alias("skip"), F.first(F.when(F.col("kept"), F.col("activity")), ignorenulls=True).alias("activity")).where("activity IS NOT NULL")
    after = F.coalesce(F.col("skip"), F.lit(False)) & F.lead("group").over(Window.partitionBy("case_id").orderBy("group")).isNotNull()
    parts = gap.withColumn("after", after).select("case_id", "group", F.posexplode(F.array_compact(F.array(F.col("activity"), F.when(F.col("after"), F.lit(SKIP))))).alias("k", "activity"))
    return parts.select("case_id", F.row_number().over(Window.partitionBy("case_id").orderBy("group", "k")).alias("pos"), "activity")


def coverage(log: DataFrame, labels: list[str]) -> DataFrame:
    """One row: the share of events that have these labels."""
    return log.agg((F.sum(F.col("activity").isin(labels).cast("int")) / F.count("*")).alias("coverage"))


def sequences(log: DataFrame) -> DataFrame:
    """case_id and its activities in order."""
    return log.groupBy("case_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "activity"))), lambda x: x["activity"]).alias("acts"))


def fragment_counts(log: DataFrame, fragment: list[str]) -> DataFrame:
    """case_id, ordered, unordered: how often a fragment stands in a case as a sub-list (overlaps count), and
    the least count of any of its labels."""
    n = len(fragment)
    want = F.array(*map(F.lit, fragment))
    starts = F.when(F.size("acts") >= n, F.sequence(F.lit(1), F.size("acts") - n + 1)).otherwise(F.array().cast("array<int>"))
    ordered = F.size(F.filter(starts, lambda i: F.slice("acts", i, n) == want))
    count = lambda a: F.size(F.filter("acts", lambda x: x == a))
    counts = [count(a) for a in dict.fromkeys(fragment)]
    return sequences(log).select("case_id", ordered.alias("ordered"), (F.least(*counts) if len(counts) > 1 else counts[0]).alias("unordered"))


def fragment_range(log: DataFrame, labels: list[str]) -> DataFrame:
    """One row, mean, min and max over cases of the distance from the first to the last projected event."""
    spans = project(log, labels).groupBy("case_id").agg((F.max("orig_pos") - F.min("orig_pos")).alias("r"))
    return spans.agg(F.avg("r").alias("mean_range"), F.min("r").alias("min_range"), F.max("r").alias("max_range"))


def support_measures(counts: DataFrame) -> DataFrame:
    """One row from (case_id, occurrences): support_tax s/(s+1), the share of cases with any, and occurrences
    a case, at most 1."""
    c = counts.agg(F.sum("occurrences").alias("s"), F.sum((F.col("occurrences") > 0).cast("int")).alias("k"), F.count("*").alias("n"))
    return c.select((F.col("s") / (F.col("s") + 1)).alias("support_tax"), (F.col("k") / F.col("n")).alias("support_trans"), F.least(F.col("s") / F.col("n"), F.lit(1.0)).alias("support_occ"))


def confidence(log: DataFrame, explained: DataFrame, labels: list[str]) -> DataFrame:
    """One row: the harmonic mean over labels of the share of their events that ``explained`` (activity, one
    row an event) has; shares below EPSILON count as EPSILON."""
    all_ = log.where(F.col("activity").isin(labels)).groupBy("activity").agg(F.count("*").alias("n"))
    own = explained.groupBy("activity").agg(F.count("*").alias("k"))
    share = F.greatest(F.coalesce(F.col("k"), F.lit(0)) / F.col("n"), F.lit(EPSILON))
    return all_.join(own, "activity", "left").agg((F.count("*") / F.sum(1 / share)).alias("confidence"))


def label_vectors(log: DataFrame) -> DataFrame:
    """case_id, activity, n: counts of labels in long form."""
    return log.groupBy("case_id", "activity").agg(F.count("*").alias("n"))


def repetition_pairs(log: DataFrame) -> DataFrame:
    """case_id, activity, first_pos, next_pos: consecutive occurrences of an activity in a case."""
    after = F.lead("pos").over(Window.partitionBy("case_id", "activity").orderBy("pos"))
    return log.select("case_id", "activity", F.col("pos").alias("first_pos"), after.alias("next_pos")).where("next_pos IS NOT NULL")


def frequent_sublists(log: DataFrame, size: int, least: int, occurrences: bool = False) -> DataFrame:
    """pattern, support of the contiguous sub-lists of a size in at least ``least`` cases (or so often)."""
    n = F.size("acts")
    starts = F.when(n >= size, F.sequence(F.lit(1), n - size + 1)).otherwise(F.array().cast("array<int>"))
    parts = F.transform(starts, lambda i: F.array_join(F.slice("acts", i, size), ","))
    rows = sequences(log).select(F.explode(parts if occurrences else F.array_distinct(parts)).alias("pattern"))
    return rows.groupBy("pattern").agg(F.count("*").alias("support")).where(F.col("support") >= least)
