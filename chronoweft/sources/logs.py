"""Event logs as DataFrames: readers, and conversions between lifecycle and interval events.

Interval log: case_id, pos (1-based, a total order inside the case), activity, start_ts, end_ts.
Lifecycle log: case_id, event_idx, activity, lifecycle ('start' or 'complete', any case), ts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoweft.session import dealt

UNITS = ("ms", "second", "minute", "hour", "day", "month")
"""Granularities, finest first. ``ms`` leaves timestamps as they are."""

XES_SCHEMA = (
    "string ARRAY<STRUCT<_key: STRING, _value: STRING>>, "
    "event ARRAY<STRUCT<string: ARRAY<STRUCT<_key: STRING, _value: STRING>>, date: ARRAY<STRUCT<_key: STRING, _value: STRING>>>>"
)


def truncated(ts: Column | str, unit: str) -> Column:
    """A timestamp cut to a unit; months begin on day one."""
    c = F.col(ts) if isinstance(ts, str) else ts
    if unit not in UNITS:
        raise ValueError(f"unknown unit {unit}")
    return c if unit == "ms" else F.date_trunc(unit, c).cast("timestamp_ntz")


def to_utc(ts: Column | str, zone: Column | str) -> Column:
    """A local time without zone, in UTC."""
    return F.convert_timezone(zone if isinstance(zone, Column) else F.lit(zone), F.lit("UTC"), ts)


def granularity(log: DataFrame, *columns: str) -> DataFrame:
    """One row with ``granularity``: the finest unit in which some timestamp isn't zero, over all rows."""
    columns = columns or ("start_ts", "end_ts")
    any_of = lambda f: F.max(F.greatest(*(F.coalesce(f(F.col(c)), F.lit(False)) for c in columns), F.lit(False)))
    fine = F.coalesce(any_of(lambda c: F.extract(F.lit("SECOND"), c) % 1 != 0), F.lit(False))
    second = F.coalesce(any_of(lambda c: F.second(c) != 0), F.lit(False))
    minute = F.coalesce(any_of(lambda c: F.minute(c) != 0), F.lit(False))
    hour = F.coalesce(any_of(lambda c: F.hour(c) != 0), F.lit(False))
    return log.agg(F.when(fine, "ms").when(second, "second").when(minute, "minute").when(hour, "hour").otherwise("day").alias("granularity"))


def keep_lifecycle(log: DataFrame) -> DataFrame:
    """Only start and complete events."""
    return log.where(F.lower("lifecycle").isin("start", "complete"))


def to_interval(log: DataFrame) -> DataFrame:
    """Pair the k-th complete of an activity in a case with its k-th start, first in first out; a complete
    without a start is an interval of no length, a start without a complete is dropped.

    One exchange, on the case: both numberings and the pairing stay inside a case and activity."""
    order = Window.partitionBy("case_id", "activity", F.lower("lifecycle")).orderBy("ts", "event_idx")
    numbered = keep_lifecycle(log).withColumn("k", F.row_number().over(order))
    is_start = F.lower("lifecycle") == "start"
    paired = numbered.groupBy("case_id", "activity", "k").agg(
        F.min(F.when(is_start, F.col("ts"))).alias("s"),
        F.min(F.when(~is_start, F.col("ts"))).alias("end_ts"),
        F.min(F.when(~is_start, F.col("event_idx"))).alias("event_idx"),
    )
    whole = paired.where("end_ts IS NOT NULL").withColumn("start_ts", F.when(F.col("s") <= F.col("end_ts"), F.col("s")).otherwise(F.col("end_ts")))
    place = Window.partitionBy("case_id").orderBy("start_ts", "event_idx")
    return whole.select("case_id", F.row_number().over(place).alias("pos"), "activity", "start_ts", "end_ts")


def to_lifecycle(log: DataFrame) -> DataFrame:
    """Two events for each interval; event_idx follows time, and a start comes before the complete."""
    both = F.array(F.struct(F.lit("start").alias("lifecycle"), F.col("start_ts").alias("ts")), F.struct(F.lit("complete").alias("lifecycle"), F.col("end_ts").alias("ts")))
    events = log.select("case_id", "pos", "activity", F.posexplode(both).alias("part", "e")).select("case_id", "pos", "activity", "part", "e.lifecycle", "e.ts")
    place = Window.partitionBy("case_id").orderBy("ts", "part", "pos")
    return events.select("case_id", F.row_number().over(place).alias("event_idx"), "activity", "lifecycle", "ts")


def read_xes(spark: SparkSession, path: str) -> DataFrame:
    """A lifecycle log from XES files, through Spark's XML reader."""
    traces = spark.read.format("xml").option("rowTag", "trace").schema(XES_SCHEMA).load(path)
    of = lambda items, key: F.element_at(F.filter(items, lambda x: x["_key"] == key), 1)["_value"]
    events = traces.select(of(F.col("string"), "concept:name").alias("case_id"), F.posexplode("event").alias("i", "e"))
    return events.select(
        "case_id",
        (F.col("i") + 1).alias("event_idx"),
        of(F.col("e.string"), "concept:name").alias("activity"),
        F.coalesce(of(F.col("e.string"), "lifecycle:transition"), F.lit("complete")).alias("lifecycle"),
        F.to_timestamp(of(F.col("e.date"), "time:timestamp")).cast("timestamp_ntz").alias("ts"),
    )


def write_xes(lifecycle: DataFrame, path: str) -> None:
    """XES files with a lifecycle log's traces, as Spark's XML writer spreads them."""
    pair = lambda key, value: F.struct(F.lit(key).alias("_key"), value.alias("_value"))
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    event = F.struct(F.array(pair("concept:name", F.col("activity")), pair("lifecycle:transition", F.col("lifecycle"))).alias("string"), F.array(pair("time:timestamp", stamp)).alias("date"))
    events = F.transform(F.array_sort(F.collect_list(F.struct("event_idx", event.alias("e")))), lambda x: x["e"])
    traces = lifecycle.groupBy("case_id").agg(events.alias("event")).select(F.array(pair("concept:name", F.col("case_id").cast("string"))).alias("string"), "event")
    traces.write.format("xml").option("rootTag", "log").option("rowTag", "trace").mode("overwrite").save(path)


PNML_SCHEMA = "path string, n_places int, initial array<int>, final array<int>, transitions array<struct<label: string, pre: array<int>, post: array<int>>>"


def read_pnml(spark: SparkSession, folder: str) -> DataFrame:
    """The nets of the PNML files in a folder, one a row: path, n_places, the places marked first and last, and
    transitions (label, null if silent; places before and after). ``petri_net.from_row`` makes a net of a row."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pnml").load(folder).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from chronoweft.plans.petri_net import from_pnml

        ints, text = pa.list_(pa.int32()), pa.string()
        kinds = [text, pa.int32(), ints, ints, pa.list_(pa.struct([("label", text), ("pre", ints), ("post", ints)]))]
        for b in batches:
            rows = []
            for path, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                net = from_pnml(raw.decode())
                rows.append((path, net.n_places, sorted(net.initial), sorted(net.final), [{"label": t.label, "pre": sorted(t.pre), "post": sorted(t.post)} for t in net.transitions]))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["path", "n_places", "initial", "final", "transitions"])

    return files.mapInArrow(run, PNML_SCHEMA)


def combine(one: DataFrame, other: DataFrame) -> DataFrame:
    return one.unionByName(other)


def instance_names(log: DataFrame) -> DataFrame:
    """The log with ``instance``: the activity and the number of its earlier occurrences in the case."""
    order = Window.partitionBy("case_id", "activity").orderBy("pos")
    return log.withColumn("instance", F.concat("activity", F.row_number().over(order) - 1))


# Views of the driver's tables as interval logs, and the same in SQL

def _placed(df: DataFrame, *order: str) -> DataFrame:
    place = Window.partitionBy("case_id").orderBy(*order)
    return dealt(df, "case_id").withColumn("pos", F.row_number().over(place)).select("case_id", "pos", "activity", "start_ts", "end_ts")


def lineitem_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as cases, line items as activities that take ten days a unit."""
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    days = F.make_dt_interval(days=(F.col("l_quantity") * 10).cast("int"))
    t = t.select(F.col("l_orderkey").alias("case_id"), F.concat("l_returnflag", "l_linestatus").alias("activity"), F.col("l_shipdate").alias("start_ts"), (F.col("l_shipdate") + days).alias("end_ts"), "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return _placed(t, "start_ts", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's day as a case, events at hour precision."""
    t = spark.read.parquet(f"{sf_dir}/events.parquet")
    hour = truncated("ts", "hour")
    case = F.concat_ws("/", "user_id", F.date_format("ts", "yyyy-MM-dd"))
    return _placed(t.select(case.alias("case_id"), F.col("event_type").alias("activity"), hour.alias("start_ts"), hour.alias("end_ts"), "ts", "event_id"), "ts", "event_id")


def user_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.read.parquet(f"{sf_dir}/events.parquet")
    return _placed(t.select(F.col("user_id").alias("case_id"), F.col("event_type").alias("activity"), F.col("ts").alias("start_ts"), F.col("ts").alias("end_ts"), "event_id"), "start_ts", "event_id")


def order_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as cases, priorities of their orders as activities, at day precision."""
    t = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return _placed(t.select(F.col("o_custkey").alias("case_id"), F.col("o_orderpriority").alias("activity"), F.col("o_orderdate").alias("start_ts"), F.col("o_orderdate").alias("end_ts"), "o_orderkey"), "start_ts", "o_orderkey")


def conversation_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as cases, roles as activities; turns count as seconds."""
    t = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    at = F.timestamp_seconds("turn").cast("timestamp_ntz")
    return _placed(t.select(F.col("conv_id").alias("case_id"), F.col("role").alias("activity"), at.alias("start_ts"), at.alias("end_ts"), "turn", "text"), "turn", "text")


SQL_VIEWS = {
    "li": """e AS (SELECT l_orderkey AS case_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS pos,
  l_returnflag || l_linestatus AS activity, l_shipdate AS s, l_shipdate + CAST(l_quantity * 10 AS INTEGER) * INTERVAL 1 DAY AS t FROM lineitem)""",
    "ev": """e AS (SELECT user_id || '/' || strftime(ts, '%Y-%m-%d') AS case_id, row_number() OVER (PARTITION BY user_id, date_trunc('day', ts) ORDER BY ts, event_id) AS pos,
  event_type AS activity, date_trunc('hour', ts) AS s, date_trunc('hour', ts) AS t FROM events)""",
    "user": "e AS (SELECT user_id AS case_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos, event_type AS activity, ts AS s, ts AS t FROM events)",
    "ord": "e AS (SELECT o_custkey AS case_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS pos, o_orderpriority AS activity, o_orderdate AS s, o_orderdate AS t FROM orders)",
    "conv": "e AS (SELECT conv_id AS case_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS pos, role AS activity, turn AS s, turn AS t FROM conversations)",
}
VIEWS = {"li": lineitem_log, "ev": event_log, "user": user_log, "ord": order_log, "conv": conversation_log}
