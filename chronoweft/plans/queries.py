"""Queries on the event-log views of the driver's tables, and the SQL that each can be checked against."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweft.functions.stats import exact_percentiles, seconds_between, sql_statistics, statistics
from chronoweft.operators import alignment, clustering, discovery, local_models, mining, ordering, performance, projection, relations, tree_performance, variants
from chronoweft.plans import process_tree, sequentializer, variant_tree, vql
from chronoweft.session import shared_dir
from chronoweft.sources import logs
from chronoweft.sources.logs import SQL_VIEWS, VIEWS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a query under its function's name."""

    def register(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return register


PAIRS = """raw AS (SELECT x.case_id, x.pos AS a_pos, y.pos AS b_pos, x.activity AS a, y.activity AS b, x.t < y.s AS ef, y.s AS b_start, y.t AS b_end
  FROM e x JOIN e y ON x.case_id = y.case_id AND x.pos < y.pos),
pairs AS (SELECT *, ef AND b_start <= min(CASE WHEN ef THEN b_end END) OVER (PARTITION BY case_id, a_pos) AS df FROM raw)"""
RELATION_WHERE = {"EF": "ef", "DF": "df", "P": "NOT ef"}
ORDERED = {"EF": "a_pos, b_pos, a, b", "DF": "a_pos, b_pos, a, b", "P": "CASE WHEN a > b THEN b_pos ELSE a_pos END AS a_pos, CASE WHEN a > b THEN a_pos ELSE b_pos END AS b_pos, least(a, b) AS a, greatest(a, b) AS b"}

for _view in VIEWS:
    for _rel in relations.RELATIONS:
        if _view in ("li", "ev") or _rel == "DF":
            query(f"WITH {SQL_VIEWS[_view]}, {PAIRS} SELECT case_id, {ORDERED[_rel]} FROM pairs WHERE {RELATION_WHERE[_rel]}", f"{_rel.lower()}_pairs_{_view}")(
                lambda spark, sf_dir, v=_view, r=_rel: relations.related(VIEWS[v](spark, sf_dir), r)
            )

GRAINS = {"day": "day", "month": "month"}
for _unit in GRAINS:
    _cut = f"cut AS (SELECT case_id, pos, activity, date_trunc('{_unit}', s) AS s, date_trunc('{_unit}', t) AS t FROM e)"
    query(f"WITH {SQL_VIEWS['li']}, {_cut}, {PAIRS.replace('FROM e x JOIN e y', 'FROM cut x JOIN cut y')} SELECT a, b, count(*) AS support FROM pairs WHERE df GROUP BY a, b", f"df_counts_li_{_unit}")(
        lambda spark, sf_dir, u=_unit: relations.relation_counts(logs.lineitem_log(spark, sf_dir), "DF", u)
    )

for _rel in relations.RELATIONS:
    for _occ in (True, False):
        _n = "count(*)" if _occ else "count(DISTINCT case_id)"
        _ab = "least(a, b) AS a, greatest(a, b) AS b" if _rel == "P" else "a, b"
        query(f"WITH {SQL_VIEWS['li']}, {PAIRS}, r AS (SELECT case_id, {_ab} FROM pairs WHERE {RELATION_WHERE[_rel]}) SELECT a, b, {_n} AS support FROM r GROUP BY a, b", f"{_rel.lower()}_counts_{'occurrence' if _occ else 'transaction'}_li")(
            lambda spark, sf_dir, r=_rel, o=_occ: relations.relation_counts(logs.lineitem_log(spark, sf_dir), r, occurrences=o)
        )

BORDERS = """firsts AS (SELECT case_id, min(a_pos) AS first FROM pairs WHERE ef GROUP BY case_id),
head AS (SELECT e.case_id, e.pos FROM e LEFT JOIN firsts USING (case_id) WHERE first IS NULL OR pos <= first),
starts AS (SELECT case_id, pos FROM head UNION SELECT p.case_id, p.b_pos FROM pairs p JOIN head h ON p.case_id = h.case_id AND p.a_pos = h.pos WHERE NOT p.ef),
goes_on AS (SELECT DISTINCT case_id, a_pos AS pos FROM pairs WHERE ef),
marks AS (SELECT e.case_id, e.pos, e.activity, s.pos IS NOT NULL AS is_start, g.pos IS NULL AS is_end
  FROM e LEFT JOIN starts s ON e.case_id = s.case_id AND e.pos = s.pos LEFT JOIN goes_on g ON e.case_id = g.case_id AND e.pos = g.pos)"""
for _view in ("li", "ev"):
    query(f"WITH {SQL_VIEWS[_view]}, {PAIRS}, {BORDERS} SELECT * FROM marks", f"start_end_activities_{_view}")(lambda spark, sf_dir, v=_view: relations.borders(VIEWS[v](spark, sf_dir)))
query(f"WITH {SQL_VIEWS['li']}, {PAIRS}, {BORDERS}, late AS (SELECT DISTINCT case_id, b_pos AS pos FROM pairs WHERE ef) SELECT m.case_id, m.pos, m.activity, l.pos IS NULL AS is_start, m.is_end FROM marks m LEFT JOIN late l ON m.case_id = l.case_id AND m.pos = l.pos", "strict_start_activities_li")(
    lambda spark, sf_dir: relations.borders(logs.lineitem_log(spark, sf_dir), strict_start=True)
)


@query("SELECT CASE WHEN max((epoch_us(ts) % 1000000 <> 0)::INT) = 1 THEN 'ms' WHEN max((second(ts) <> 0)::INT) = 1 THEN 'second' WHEN max((minute(ts) <> 0)::INT) = 1 THEN 'minute' WHEN max((hour(ts) <> 0)::INT) = 1 THEN 'hour' ELSE 'day' END AS granularity FROM events")
def detect_granularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.granularity(logs.user_log(spark, sf_dir), "start_ts")


@query("SELECT event_id, date_trunc('second', ts) AS second, date_trunc('minute', ts) AS minute, date_trunc('hour', ts) AS hour, date_trunc('day', ts)::TIMESTAMP AS day, date_trunc('month', ts)::TIMESTAMP AS month FROM events")
def granularity_truncation(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.read.parquet(f"{sf_dir}/events.parquet")
    return t.select("event_id", *(logs.truncated("ts", u).alias(u) for u in ("second", "minute", "hour", "day", "month")))


@query(f"WITH {SQL_VIEWS['li']} SELECT case_id, pos, activity, activity || (row_number() OVER (PARTITION BY case_id, activity ORDER BY pos) - 1) AS instance FROM e")
def unique_instance_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.instance_names(logs.lineitem_log(spark, sf_dir)).select("case_id", "pos", "activity", "instance")


@query(f"""WITH {SQL_VIEWS['li']},
starts AS (SELECT case_id, activity, s, row_number() OVER (PARTITION BY case_id, activity ORDER BY s, pos) AS k FROM e),
ends AS (SELECT case_id, activity, t, row_number() OVER (PARTITION BY case_id, activity ORDER BY t, pos) AS k FROM e)
SELECT case_id, activity, s AS start_ts, t AS end_ts FROM starts JOIN ends USING (case_id, activity, k)""")
def interval_from_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as lifecycle events, paired again first in, first out."""
    return logs.to_interval(logs.to_lifecycle(logs.lineitem_log(spark, sf_dir))).select("case_id", "activity", "start_ts", "end_ts")


@query(f"WITH {SQL_VIEWS['li']} SELECT case_id, activity, 'start' AS lifecycle, s AS ts FROM e UNION ALL SELECT case_id, activity, 'complete', t FROM e")
def lifecycle_from_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.to_lifecycle(logs.lineitem_log(spark, sf_dir)).select("case_id", "activity", "lifecycle", "ts")


# The query language: each query, and the SQL condition over instance counts that it stands for

GRAPH = """own AS (SELECT case_id, activity, count(*) AS n, sum(is_start::INT) AS n_start, sum(is_end::INT) AS n_end FROM marks GROUP BY case_id, activity),
rel AS (SELECT case_id, 'ef' AS r, a, b, a_pos AS place FROM pairs WHERE ef UNION ALL SELECT case_id, 'df', a, b, a_pos FROM pairs WHERE df
  UNION ALL SELECT case_id, 'par', a, b, a_pos FROM pairs WHERE NOT ef UNION ALL SELECT case_id, 'par', b, a, b_pos FROM pairs WHERE NOT ef),
cases AS (SELECT DISTINCT case_id FROM e)"""


def _n(activity: str, column: str = "n") -> str:
    return f"coalesce((SELECT max({column}) FROM own o WHERE o.case_id = c.case_id AND o.activity = '{activity}'), 0)"


def _met(r: str, a: str, *b: str) -> str:
    names = ", ".join(f"'{x}'" for x in b)
    return f"(SELECT count(DISTINCT place) FROM rel l WHERE l.case_id = c.case_id AND l.r = '{r}' AND l.a = '{a}' AND l.b IN ({names}))"


def _covers(r: str, a: str, b: str) -> str:
    return f"({_n(a)} > 0 AND {_n(b)} > 0 AND {_met(r, a, b)} = {_n(a)})"


VQL_QUERIES: dict[str, tuple[str, str, str]] = {
    "contains": ("li", "'AF' isC;", f"{_n('AF')} > 0"),
    "contains_any": ("li", "ANY {'AF', 'NF'} isContained;", f"{_n('AF')} > 0 OR {_n('NF')} > 0"),
    "contains_all": ("li", "ALL {'AF', 'RO', 'NO'} isC;", f"{_n('AF')} > 0 AND {_n('RO')} > 0 AND {_n('NO')} > 0"),
    "contains_outside": ("li", "~ ANY {'AF', 'AO', 'NF', 'NO', 'RF'} isC;", f"{_n('RO')} > 0"),
    "contains_count": ("li", "'AF' isC > 1;", f"{_n('AF')} > 1"),
    "start": ("li", "'AF' isStart;", f"{_n('AF', 'n_start')} > 0"),
    "end_all": ("li", "ALL {'AF', 'RO'} isEnd;", f"{_n('AF', 'n_end')} > 0 AND {_n('RO', 'n_end')} > 0"),
    "start_count": ("li", "ANY {'AF', 'NO'} isS = 2;", f"{_n('AF', 'n_start')} = 2 OR {_n('NO', 'n_start')} = 2"),
    "df": ("li", "'AF' isDF 'RO';", _covers("df", "AF", "RO")),
    "ef": ("li", "'AF' isEF 'RO';", _covers("ef", "AF", "RO")),
    "parallel": ("li", "'AF' isP 'RO';", _covers("par", "AF", "RO")),
    "ef_any_right": ("li", "'AF' isEF ANY {'RO', 'NO'};", f"{_n('AF')} > 0 AND {_met('ef', 'AF', 'RO', 'NO')} = {_n('AF')}"),
    "ef_all_right": ("li", "'AF' isEF ALL {'RO', 'NO'};", f"{_covers('ef', 'AF', 'RO')} AND {_covers('ef', 'AF', 'NO')}"),
    "df_any_left": ("li", "ANY {'AF', 'RF'} isDF 'NO';", f"{_covers('df', 'AF', 'NO')} OR {_covers('df', 'RF', 'NO')}"),
    "df_all_left": ("ev", "ALL {'click', 'view'} isEF 'purchase';", f"{_covers('ef', 'click', 'purchase')} AND {_covers('ef', 'view', 'purchase')}"),
    "df_count": ("li", "'AF' isDF 'RO' = 1;", f"{_met('df', 'AF', 'RO')} = 1"),
    "ef_less": ("li", "'AF' isEF 'AF' < 2;", f"{_met('ef', 'AF', 'AF')} < 2"),
    "parallel_more": ("li", "ANY {'AF', 'NO'} isP 'RO' > 1;", f"{_met('par', 'AF', 'RO')} > 1 OR {_met('par', 'NO', 'RO')} > 1"),
    "ef_group_count": ("li", "'AF' isEF ANY {'RO', 'NO'} > 1;", f"{_met('ef', 'AF', 'RO', 'NO')} > 1"),
    "implies": ("li", "'AF' isC -> 'AF' isDF 'RO';", f"NOT ({_n('AF')} > 0) OR {_covers('df', 'AF', 'RO')}"),
    "nested": ("li", "NOT ('AF' isC -> 'RO' isP 'AF') AND ('NO' isC OR 'RF' isStart);", f"NOT (NOT ({_n('AF')} > 0) OR {_covers('par', 'RO', 'AF')}) AND ({_n('NO')} > 0 OR {_n('RF', 'n_start')} > 0)"),
    "conversation": ("conv", "'user' isDF 'assistant' AND NOT ('system' isStart);", f"{_covers('df', 'user', 'assistant')} AND NOT ({_n('system', 'n_start')} > 0)"),
}
for _name, (_view, _text, _sql) in VQL_QUERIES.items():
    query(f"WITH {SQL_VIEWS[_view]}, {PAIRS}, {BORDERS}, {GRAPH} SELECT case_id FROM cases c WHERE {_sql}", f"vql_{_name}")(lambda spark, sf_dir, v=_view, q=_text: vql.query_cases(VIEWS[v](spark, sf_dir), q))


@query(f"WITH {SQL_VIEWS['li']}, d AS (SELECT activity, epoch(t - s) AS x FROM e) SELECT activity, {sql_statistics("x", 3)} FROM d GROUP BY activity")
def service_time_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Durations of each activity."""
    log = logs.lineitem_log(spark, sf_dir)
    return log.groupBy("activity").agg(*statistics(seconds_between("start_ts", "end_ts"), 3))


@query(f"WITH {SQL_VIEWS['li']}, d AS (SELECT activity, epoch(t - s)::DOUBLE AS x FROM e) SELECT activity, count(*) AS n, {', '.join(f'round(quantile_cont(x, {p}), 3) AS p{int(1000 * p)}' for p in (0.05, 0.5, 0.95, 0.999))} FROM d GROUP BY activity")
def service_time_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of each activity's durations, without a task that holds an activity's."""
    points = [0.05, 0.5, 0.95, 0.999]
    rows = logs.lineitem_log(spark, sf_dir).select("activity", seconds_between("start_ts", "end_ts").alias("x"))
    found = exact_percentiles(rows, ["activity"], "x", points)
    return found.select("activity", "n", *(F.round(F.get("p", F.lit(i)), 3).alias(f"p{int(1000 * p)}") for i, p in enumerate(points)))


@query(f"WITH {SQL_VIEWS['li']}, d AS (SELECT case_id, epoch(max(t) - min(s)) AS x FROM e GROUP BY case_id) SELECT {sql_statistics("x", 3)} FROM d")
def case_duration_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the first start to the last end of each case."""
    log = logs.lineitem_log(spark, sf_dir)
    return log.groupBy("case_id").agg(seconds_between(F.min("start_ts"), F.max("end_ts")).alias("x")).agg(*statistics("x", 3))


# Variants

SEQ = "seq AS (SELECT case_id, string_agg(activity, ',' ORDER BY pos) AS variant FROM e GROUP BY case_id)"
for _view in ("li", "user", "ord", "conv"):
    query(f"WITH {SQL_VIEWS[_view]}, {SEQ} SELECT variant, count(*) AS n_cases FROM seq GROUP BY variant", f"sequence_variants_{_view}")(lambda spark, sf_dir, v=_view: variants.sequence_variants(VIEWS[v](spark, sf_dir)).select("variant", "n_cases"))
    query(
        f"""WITH {SQL_VIEWS[_view]}, m AS (SELECT *, coalesce((lag(activity) OVER w <> activity)::INT, 1) AS fresh FROM e WINDOW w AS (PARTITION BY case_id ORDER BY pos)),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY case_id ORDER BY pos) AS run FROM m),
g AS (SELECT case_id, run, min(activity) || CASE WHEN count(*) > 1 THEN '*' ELSE '' END AS p FROM r GROUP BY case_id, run),
s AS (SELECT case_id, string_agg(p, ',' ORDER BY run) AS variant FROM g GROUP BY case_id)
SELECT variant, count(*) AS n_cases FROM s GROUP BY variant""",
        f"collapsed_variants_{_view}",
    )(lambda spark, sf_dir, v=_view: variants.collapsed_sequences(VIEWS[v](spark, sf_dir)).select("variant", "n_cases"))

SUB = """numbered AS (SELECT *, activity || '#' || (row_number() OVER (PARTITION BY case_id, activity ORDER BY s, t, pos) - 1) AS name FROM e),
marks AS (SELECT case_id, s AS ts, name || 's' AS ev FROM numbered UNION ALL SELECT case_id, t, name || 'c' FROM numbered),
steps AS (SELECT case_id, ts, string_agg(ev, '+' ORDER BY ev) AS step FROM marks GROUP BY case_id, ts),
whole AS (SELECT case_id, string_agg(step, '|' ORDER BY ts) AS subvariant FROM steps GROUP BY case_id)"""
for _view in ("li", "ev"):
    query(f"WITH {SQL_VIEWS[_view]}, {SUB} SELECT subvariant, count(*) AS n_cases FROM whole GROUP BY subvariant", f"detailed_subvariants_{_view}")(lambda spark, sf_dir, v=_view: variants.subvariants(VIEWS[v](spark, sf_dir)).select("subvariant", "n_cases"))


@query()
def concurrency_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(logs.lineitem_log(spark, sf_dir))


# Events of one hour are parallel, and what has no duration has no other overlaps
GROUPS = f"""{SQL_VIEWS['ev']}, g AS (SELECT case_id, s, count(*) AS n, CASE WHEN count(*) = 1 THEN min(activity) ELSE '∧(' || string_agg(activity, ', ' ORDER BY activity) || ')' END AS p FROM e GROUP BY case_id, s)"""


def _whole(parts: str, case: str = "case_id", order: str = "s", p: str = "p") -> str:
    """A case's variant from the texts of its parts in a sequence."""
    return f"SELECT {case}, CASE WHEN count(*) = 1 THEN min({p}) ELSE '→(' || string_agg({p}, ', ' ORDER BY {order}) || ')' END AS variant FROM {parts} GROUP BY {case}"


@query(f"WITH {GROUPS}, v AS ({_whole('g')}) SELECT variant, count(*) AS n_cases FROM v GROUP BY variant")
def concurrency_variants_ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(logs.event_log(spark, sf_dir)).select("variant", "n_cases")


@query(f"""WITH {GROUPS}, m AS (SELECT *, coalesce((lag(p) OVER w <> p OR n > 1)::INT, 1) AS fresh FROM g WINDOW w AS (PARTITION BY case_id ORDER BY s)),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY case_id ORDER BY s) AS run FROM m),
c AS (SELECT case_id, run, CASE WHEN count(*) = 1 THEN min(p) ELSE '*(' || min(p) || ')' END AS p FROM r GROUP BY case_id, run), v AS ({_whole('c', order='run')})
SELECT variant, count(*) AS n_cases FROM v GROUP BY variant""")
def collapsed_concurrency_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(logs.event_log(spark, sf_dir), change=variant_tree.collapse).select("variant", "n_cases")


@query(f"""WITH {GROUPS}, f AS (SELECT *, list_product(range(1, n + 1)) AS ways FROM g), w AS (SELECT case_id, product(ways) AS ways FROM f GROUP BY case_id), v AS ({_whole('g')})
SELECT variant, any_value(ways)::DECIMAL(38, 0) AS n_extensions FROM v JOIN w USING (case_id) GROUP BY variant""")
def extension_counts_ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linear extensions of each variant: those of its simultaneous events."""
    return variants.extension_counts(variants.variants(logs.event_log(spark, sf_dir))).select("variant", "n_extensions")


@query(f"WITH {GROUPS}, v AS ({_whole('g')}), n AS (SELECT case_id, activity AS label, count(*) AS n FROM e GROUP BY case_id, activity) SELECT DISTINCT variant, label, n FROM v JOIN n USING (case_id)")
def variant_label_counts_ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = variants.variants(logs.event_log(spark, sf_dir))
    return clustering.label_counts(rows).join(rows.select("variant_json", "variant"), "variant_json").select("variant", "label", "n")


@query(f"""WITH {GROUPS}, x AS (SELECT case_id, s, CASE WHEN p = '∧(click, view)' THEN 'click, view' ELSE p END AS p, p = '∧(click, view)' AS changed FROM g),
v AS (SELECT case_id, CASE WHEN count(*) = 1 AND NOT bool_or(changed) THEN min(p) ELSE '→(' || string_agg(p, ', ' ORDER BY s) || ')' END AS variant FROM x GROUP BY case_id)
SELECT variant, count(*) AS n_cases FROM v GROUP BY variant""")
def sequentialised_pairs_ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A click and a view alone in one hour, as a click before a view."""
    return variants.variants(logs.event_log(spark, sf_dir), change=lambda t: sequentializer.apply(t, "+('click', 'view')", "->('click', 'view')")).select("variant", "n_cases")


# Overlapping line items: what a case is a sequence of are the spans in which something runs, and such a span is a
# parallel of what eventually follows joins, or of unknown order where it joins all
SPANS = f"""{SQL_VIEWS['li']}, sm AS (SELECT *, coalesce((s > max(t) OVER (PARTITION BY case_id ORDER BY s, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))::INT, 1) AS fresh FROM e),
sp AS (SELECT case_id, pos, activity, s, t, sum(fresh) OVER (PARTITION BY case_id ORDER BY s, pos)::INT AS part FROM sm),
near AS (SELECT x.case_id, x.pos AS a, y.pos AS b FROM sp x JOIN sp y ON x.case_id = y.case_id AND x.part = y.part AND x.t < y.s),
edges AS (SELECT case_id, a, b FROM near UNION ALL SELECT case_id, b, a FROM near),
reach AS (SELECT case_id, pos, pos AS root FROM sp UNION SELECT r.case_id, n.b, r.root FROM reach r JOIN edges n ON r.case_id = n.case_id AND r.pos = n.a),
comp AS (SELECT case_id, pos, min(root) AS root FROM reach GROUP BY case_id, pos),
whole AS (SELECT case_id, part, count(*) AS n, count(DISTINCT root) AS k, min(s) AS s, max(t) AS t FROM sp JOIN comp USING (case_id, pos) GROUP BY case_id, part),
child AS (SELECT sp.case_id, sp.part, root, list(activity ORDER BY activity) AS labels, min(sp.s) AS s, max(sp.t) AS t FROM sp JOIN comp USING (case_id, pos) GROUP BY sp.case_id, sp.part, root),
parted AS (SELECT c.case_id, c.part, CASE WHEN n = 1 THEN 'leaf' WHEN k = 1 THEN 'unknown' ELSE 'parallel' END AS kind, labels, c.s, c.t, w.s AS from_ts, w.t AS to_ts FROM child c JOIN whole w USING (case_id, part))"""


@query(f"WITH RECURSIVE {SPANS} SELECT case_id, part, kind, array_to_string(labels, ',') AS labels FROM parted")
def variant_parts_li(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two upper levels of each case's variant."""
    rows = variants.parts(variants.case_variants(logs.lineitem_log(spark, sf_dir)).select("case_id", "variant_json"))
    return rows.select("case_id", "part", "kind", F.array_join("labels", ",").alias("labels"))


@query(f"WITH RECURSIVE {SPANS}, g AS (SELECT case_id, part, epoch(s - lag(t) OVER (PARTITION BY case_id ORDER BY part)) AS wait FROM whole) SELECT case_id, part - 1 AS place, wait::DOUBLE AS wait FROM g WHERE wait IS NOT NULL")
def sequence_waits_top_li(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Waits between the parts of each case's sequence."""
    nodes = performance.node_times(logs.lineitem_log(spark, sf_dir)).where("parent = 0")
    return performance.sequence_waits(nodes.withColumn("node", F.col("place"))).select("case_id", F.col("node").alias("place"), "wait")


@query(f"WITH RECURSIVE {SPANS} SELECT case_id, epoch(s - from_ts)::DOUBLE AS wait_start, epoch(to_ts - t)::DOUBLE AS wait_end FROM parted WHERE kind = 'parallel'")
def parallel_waits_top_li(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Waits inside the parallels that a case's sequence has as parts, or that the case is."""
    nodes = performance.node_times(logs.lineitem_log(spark, sf_dir))
    tops = nodes.where("kind = 'parallel' AND parent <= 0 AND (parent = -1 OR parent_kind = 'follows')").select("case_id", F.col("node").alias("parent"))
    return performance.parallel_waits(nodes.join(tops, ["case_id", "parent"], "left_semi")).select("case_id", "wait_start", "wait_end")


@query(f"WITH RECURSIVE {SPANS}, d AS (SELECT kind, array_to_string(labels, ',') AS labels, epoch(t - s) AS x FROM parted) SELECT kind, labels, {sql_statistics('x', 3)} FROM d WHERE kind = 'leaf' GROUP BY kind, labels")
def part_service_times_li(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Service times of activities that stand alone in their case's sequence."""
    nodes = performance.node_times(logs.lineitem_log(spark, sf_dir)).where("kind = 'leaf' AND parent <= 0 AND coalesce(parent_kind, 'follows') = 'follows' AND NOT contains(label, ', ')")
    rows = nodes.select(F.lit("leaf").alias("kind"), F.col("label").alias("labels"), seconds_between("start_ts", "end_ts").alias("x"))
    return rows.groupBy("kind", "labels").agg(*statistics("x", 3))


# A sequence is a variant without parallels, so its variants are those of the flat query
@query(f"""WITH {SQL_VIEWS['conv']}, g AS (SELECT case_id, string_agg(activity, ', ' ORDER BY pos) AS v, count(*) AS n FROM e GROUP BY case_id),
n AS (SELECT case_id, CASE WHEN n = 1 THEN v ELSE '→(' || v || ')' END AS variant FROM g)
SELECT variant, count(*) AS n_cases FROM n GROUP BY variant""")
def concurrency_variants_conv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(logs.conversation_log(spark, sf_dir)).select("variant", "n_cases")


@query(f"WITH {SQL_VIEWS['conv']}, {SEQ} SELECT DISTINCT variant, true AS whole FROM seq")
def sequentialisations_conv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sequence has one linear extension, itself."""
    rows = variants.with_sequentialisations(variants.variants(logs.conversation_log(spark, sf_dir)))
    return rows.select(F.array_join("sequence", ",").alias("variant"), "whole")


@query(f"""WITH {SQL_VIEWS['conv']}, m AS (SELECT *, coalesce((lag(activity) OVER w <> activity)::INT, 1) AS fresh FROM e WINDOW w AS (PARTITION BY case_id ORDER BY pos)),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY case_id ORDER BY pos) AS run FROM m),
c AS (SELECT case_id, run, CASE WHEN count(*) >= 2 THEN min(activity) || '_LOOP' ELSE min(activity) END AS p FROM r GROUP BY case_id, run), v AS ({_whole('c', order='run')})
SELECT variant, count(*) AS n_cases FROM v GROUP BY variant""")
def folded_runs_conv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(logs.conversation_log(spark, sf_dir), change=variant_tree.fold_runs).select("variant", "n_cases")


@query(f"""WITH {SQL_VIEWS['conv']}, {SEQ}, x AS (SELECT case_id, activity AS a, lead(activity) OVER (PARTITION BY case_id ORDER BY pos) AS b FROM e),
k AS (SELECT case_id, sum((a = 'user' AND coalesce(b, '') = 'assistant')::INT)::INT AS n_found FROM x GROUP BY case_id) SELECT DISTINCT variant, n_found FROM seq JOIN k USING (case_id)""")
def fragment_occurrences_conv(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = variants.fragment_counts(variants.variants(logs.conversation_log(spark, sf_dir)), variant_tree.parse("→(user, assistant)"))
    return found.select(F.array_join(variants.label_array(), ",").alias("variant"), "n_found")


@query(f"WITH {SQL_VIEWS['conv']}, {SEQ}, f AS (SELECT case_id, arg_min(activity, pos) AS cluster FROM e GROUP BY case_id) SELECT DISTINCT variant, cluster FROM seq JOIN f USING (case_id)")
def start_clusters_conv(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = clustering.cluster_by_start(variants.variants(logs.conversation_log(spark, sf_dir)))
    return found.select(F.array_join(variants.label_array(), ",").alias("variant"), "cluster")


# Sources


@query(f"WITH {SQL_VIEWS['conv']} SELECT case_id::VARCHAR AS case_id, activity, 'start' AS lifecycle, make_timestamp((s * 1000000)::BIGINT) AS ts FROM e UNION ALL SELECT case_id::VARCHAR, activity, 'complete', make_timestamp((t * 1000000)::BIGINT) FROM e")
def xes_round_trip_conv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations written as XES and read again."""
    path = f"{shared_dir(spark)}/chronoweft/xes-{uuid.uuid4().hex}"
    logs.write_xes(logs.to_lifecycle(logs.conversation_log(spark, sf_dir)), path)
    return logs.read_xes(spark, path).select("case_id", "activity", "lifecycle", "ts")


@query(f"WITH {SQL_VIEWS['user']}, a AS (SELECT * FROM e), {SQL_VIEWS['ord'].replace('e AS', 'o AS', 1)} SELECT case_id, activity, s AS start_ts FROM a UNION ALL SELECT case_id, activity, s FROM o")
def combined_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.combine(logs.user_log(spark, sf_dir), logs.order_log(spark, sf_dir)).select("case_id", "activity", "start_ts")


@query("SELECT event_id, ts - INTERVAL '5 hours 30 minutes' AS utc FROM events")
def events_in_utc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times read as those of a zone five and a half hours ahead."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", logs.to_utc("ts", "+05:30").alias("utc"))


@query(f"WITH {SQL_VIEWS['ev']}, b AS (SELECT case_id, min(s) AS s, max(t) AS t, max(pos) AS n FROM e GROUP BY case_id) SELECT case_id, pos + 1 AS pos, activity, s AS start_ts, t AS end_ts FROM e UNION ALL SELECT case_id, 1, '▶', s, s FROM b UNION ALL SELECT case_id, n + 2, '■', t, t FROM b")
def artificial_borders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.add_borders(logs.event_log(spark, sf_dir))


# Performance

MERGED = """m AS (SELECT *, coalesce((s > max(t) OVER (PARTITION BY case_id ORDER BY s, t, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))::INT, 1) AS fresh FROM e),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY case_id ORDER BY s, t, pos) AS span FROM m),
merged AS (SELECT case_id, min(s) AS start_ts, max(t) AS end_ts FROM r GROUP BY case_id, span)"""
query(f"WITH {SQL_VIEWS['li']}, {MERGED} SELECT * FROM merged", "merged_service_times")(lambda spark, sf_dir: performance.merged_service(logs.lineitem_log(spark, sf_dir)))
query(f"WITH {SQL_VIEWS['li']}, {MERGED}, g AS (SELECT case_id, end_ts AS start_ts, lead(start_ts) OVER (PARTITION BY case_id ORDER BY start_ts) AS end_ts FROM merged) SELECT * FROM g WHERE end_ts IS NOT NULL", "idle_times")(
    lambda spark, sf_dir: performance.idle_times(logs.lineitem_log(spark, sf_dir))
)
query(f"WITH {SQL_VIEWS['li']}, {MERGED}, c AS (SELECT case_id, epoch(max(end_ts) - min(start_ts)) AS cycle, sum(epoch(end_ts - start_ts)) AS service FROM merged GROUP BY case_id) SELECT *, cycle - service AS idle FROM c", "cycle_times")(
    lambda spark, sf_dir: performance.cycle_times(logs.lineitem_log(spark, sf_dir))
)


@query()
def node_service_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return performance.service_times(performance.node_times(logs.lineitem_log(spark, sf_dir)), 3)


@query(f"WITH {SQL_VIEWS['conv']}, w AS (SELECT case_id, pos, s - lag(t) OVER (PARTITION BY case_id ORDER BY pos) AS wait FROM e) SELECT case_id, pos AS node, wait::DOUBLE AS wait FROM w WHERE wait IS NOT NULL")
def sequence_waits_conv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return performance.sequence_waits(performance.node_times(logs.conversation_log(spark, sf_dir))).select("case_id", "node", "wait")


@query()
def sequence_waits_li(spark: SparkSession, sf_dir: str) -> DataFrame:
    return performance.sequence_waits(performance.node_times(logs.lineitem_log(spark, sf_dir)))


@query()
def parallel_waits_li(spark: SparkSession, sf_dir: str) -> DataFrame:
    return performance.parallel_waits(performance.node_times(logs.lineitem_log(spark, sf_dir)))


@query(f"""WITH {SQL_VIEWS['li']}, numbered AS (SELECT *, activity || '#' || (row_number() OVER (PARTITION BY case_id, activity ORDER BY s, t, pos) - 1) AS name FROM e),
marks AS (SELECT case_id, s AS ts, name, 's' AS k FROM numbered UNION ALL SELECT case_id, t, name, 'c' FROM numbered),
steps AS (SELECT case_id, ts, list(name ORDER BY name) FILTER (k = 's') AS starts, list(name ORDER BY name) FILTER (k = 'c') AS ends FROM marks GROUP BY case_id, ts),
w AS (SELECT case_id, row_number() OVER o AS step, ts, starts, lag(ts) OVER o AS was, lag(ends) OVER o AS ended FROM steps WINDOW o AS (PARTITION BY case_id ORDER BY ts)),
u AS (SELECT case_id, step, epoch(ts - was) AS wait, CASE WHEN len(starts) >= len(ended) THEN list_transform(starts, lambda x: {{'f': ended[1], 't': x}}) ELSE list_transform(ended, lambda x: {{'f': x, 't': starts[1]}}) END AS p
  FROM w WHERE len(starts) > 0 AND len(ended) > 0), x AS (SELECT case_id, step, wait, unnest(p) AS q FROM u)
SELECT case_id, step, q.f AS from_name, q.t AS to_name, wait FROM x""")
def subvariant_waits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return performance.subvariant_waits(logs.lineitem_log(spark, sf_dir))


# Projection and local measures

KEPT = ["AF", "RO"]
IN = "('AF', 'RO')"
query(f"WITH {SQL_VIEWS['li']} SELECT case_id, row_number() OVER (PARTITION BY case_id ORDER BY pos) AS pos, activity, pos AS orig_pos FROM e WHERE activity IN {IN}", "projected_log")(
    lambda spark, sf_dir: projection.project(logs.lineitem_log(spark, sf_dir), KEPT).select("case_id", "pos", "activity", "orig_pos")
)
query(
    f"""WITH {SQL_VIEWS['li']}, k AS (SELECT case_id, pos, activity, lag(pos) OVER (PARTITION BY case_id ORDER BY pos) AS before FROM e WHERE activity IN {IN}),
f AS (SELECT case_id, pos, 1 AS k, activity FROM k UNION ALL SELECT case_id, pos, 0, '...' FROM k WHERE pos > before + 1)
SELECT case_id, row_number() OVER (PARTITION BY case_id ORDER BY pos, k) AS pos, activity FROM f""",
    "projected_log_with_skips",
)(lambda spark, sf_dir: projection.project_with_skips(logs.lineitem_log(spark, sf_dir), KEPT))
query(
    f"""WITH {SQL_VIEWS['li']}, m AS (SELECT *, activity IN {IN} AS kept, last_value(CASE WHEN activity IN {IN} THEN t END IGNORE NULLS) OVER (PARTITION BY case_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
  first_value(CASE WHEN activity IN {IN} THEN s END IGNORE NULLS) OVER (PARTITION BY case_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after FROM e),
g AS (SELECT case_id, pos, activity, kept, s > before AND t < after AS between_, sum(kept::INT) OVER (PARTITION BY case_id ORDER BY pos) AS grp FROM m),
k AS (SELECT case_id, grp, max(CASE WHEN kept THEN activity END) AS activity, bool_or(coalesce(NOT kept AND between_, false)) AS skip, lead(grp) OVER (PARTITION BY case_id ORDER BY grp) IS NOT NULL AS goes_on FROM g WHERE grp > 0 GROUP BY case_id, grp),
f AS (SELECT case_id, grp, 0 AS k, activity FROM k UNION ALL SELECT case_id, grp, 1, '...' FROM k WHERE skip AND goes_on)
SELECT case_id, row_number() OVER (PARTITION BY case_id ORDER BY grp, k) AS pos, activity FROM f""",
    "projected_log_with_time_skips",
)(lambda spark, sf_dir: projection.project_with_time_skips(logs.lineitem_log(spark, sf_dir), KEPT))
query(f"WITH {SQL_VIEWS['li']} SELECT sum((activity IN {IN})::INT) / count(*) AS coverage FROM e", "coverage")(lambda spark, sf_dir: projection.coverage(logs.lineitem_log(spark, sf_dir), KEPT))
query(f"WITH {SQL_VIEWS['li']}, r AS (SELECT case_id, max(pos) - min(pos) AS r FROM e WHERE activity IN {IN} GROUP BY case_id) SELECT avg(r) AS mean_range, min(r) AS min_range, max(r) AS max_range FROM r", "fragment_range")(
    lambda spark, sf_dir: projection.fragment_range(logs.lineitem_log(spark, sf_dir), KEPT)
)
FRAGMENTS = f"""{SQL_VIEWS['li']}, two AS (SELECT case_id, activity AS a, lead(activity) OVER (PARTITION BY case_id ORDER BY pos) AS b FROM e),
fragments AS (SELECT case_id, sum((a = 'AF' AND coalesce(b, '') = 'RO')::INT)::INT AS ordered, least(sum((a = 'AF')::INT), sum((a = 'RO')::INT))::INT AS unordered FROM two GROUP BY case_id)"""
query(f"WITH {FRAGMENTS} SELECT * FROM fragments", "fragment_counts")(lambda spark, sf_dir: projection.fragment_counts(logs.lineitem_log(spark, sf_dir), KEPT))
query(f"WITH {FRAGMENTS} SELECT sum(ordered) / (sum(ordered) + 1) AS support_tax, sum((ordered > 0)::INT) / count(*) AS support_trans, least(sum(ordered) / count(*), 1.0) AS support_occ FROM fragments", "lpm_support")(
    lambda spark, sf_dir: projection.support_measures(projection.fragment_counts(logs.lineitem_log(spark, sf_dir), KEPT).withColumnRenamed("ordered", "occurrences"))
)
query(
    f"""WITH {SQL_VIEWS['li']}, n AS (SELECT activity, count(*) AS n FROM e WHERE activity IN {IN} GROUP BY activity),
two AS (SELECT activity AS a, lead(activity) OVER (PARTITION BY case_id ORDER BY pos) AS b FROM e), k AS (SELECT count(*) AS k FROM two WHERE a = 'AF' AND b = 'RO')
SELECT round(count(*) / sum(1 / greatest(k / n, 0.001)), 9) AS confidence FROM n, k""",
    "lpm_confidence",
)(
    lambda spark, sf_dir: projection.confidence(
        logs.lineitem_log(spark, sf_dir),
        projection.fragment_counts(logs.lineitem_log(spark, sf_dir), KEPT).select(F.explode(F.flatten(F.array_repeat(F.array(*map(F.lit, KEPT)), F.col("ordered")))).alias("activity")),
        KEPT,
    ).select(F.round("confidence", 9).alias("confidence"))
)
query(f"WITH {SQL_VIEWS['li']} SELECT case_id, activity, count(*) AS n FROM e GROUP BY case_id, activity", "label_vectors")(lambda spark, sf_dir: projection.label_vectors(logs.lineitem_log(spark, sf_dir)))
query(f"WITH {SQL_VIEWS['user']}, x AS (SELECT case_id, activity, pos AS first_pos, lead(pos) OVER (PARTITION BY case_id, activity ORDER BY pos) AS next_pos FROM e) SELECT * FROM x WHERE next_pos IS NOT NULL", "repetition_pairs")(
    lambda spark, sf_dir: projection.repetition_pairs(logs.user_log(spark, sf_dir))
)
for _k in (2, 3):
    for _occ in (True, False):
        _parts = ", ".join(f"lead(activity, {i}) OVER w AS a{i}" for i in range(_k))
        query(
            f"WITH {SQL_VIEWS['user']}, x AS (SELECT case_id, {_parts} FROM e WINDOW w AS (PARTITION BY case_id ORDER BY pos)), p AS (SELECT case_id, {' || chr(44) || '.join(f'a{i}' for i in range(_k))} AS pattern FROM x WHERE a{_k - 1} IS NOT NULL) SELECT pattern, count({'*' if _occ else 'DISTINCT case_id'}) AS support FROM p GROUP BY pattern HAVING count({'*' if _occ else 'DISTINCT case_id'}) >= 20",
            f"frequent_sublists_k{_k}_{'occurrence' if _occ else 'transaction'}",
        )(lambda spark, sf_dir, k=_k, o=_occ: projection.frequent_sublists(logs.user_log(spark, sf_dir), k, 20, o))

# Ordering

CODED = f"""{SQL_VIEWS['conv']}, {SEQ}, v AS (SELECT variant, count(*) AS n_cases FROM seq GROUP BY variant),
labels AS (SELECT label, chr(CAST(dense_rank() OVER (ORDER BY label) + 47 AS INTEGER)) AS c FROM (SELECT DISTINCT unnest(string_split(variant, ',')) AS label FROM v)),
coded AS (SELECT variant, n_cases, (SELECT string_agg(l.c, '' ORDER BY i) FROM (SELECT unnest(string_split(variant, ',')) AS label, generate_subscripts(string_split(variant, ','), 1) AS i) u JOIN labels l USING (label)) AS code FROM v),
lev AS (SELECT a.variant AS candidate, sum(levenshtein(a.code, b.code) * b.n_cases)::DOUBLE AS score FROM coded a, coded b GROUP BY a.variant),
missing AS (SELECT variant AS candidate, (SELECT count(DISTINCT x) FROM unnest(string_split(variant, ',')) u(x) WHERE x NOT IN ('user'))::DOUBLE AS score FROM v),
lev_ranks AS (SELECT *, row_number() OVER (ORDER BY score, candidate) AS rank FROM lev), missing_ranks AS (SELECT *, row_number() OVER (ORDER BY score, candidate) AS rank FROM missing),
fused AS (SELECT candidate, (l.rank * 0.7 + m.rank * 0.3)::DOUBLE AS score FROM lev_ranks l JOIN missing_ranks m USING (candidate))"""


def _conv_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.sequence_variants(logs.conversation_log(spark, sf_dir))


@query(f"WITH {CODED} SELECT * FROM lev_ranks")
def levenshtein_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.ranked(ordering.levenshtein_scores(_conv_variants(spark, sf_dir)))


@query(f"WITH {CODED} SELECT * FROM missing_ranks")
def missing_activity_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.ranked(ordering.missing_activity_scores(_conv_variants(spark, sf_dir), ["user"]))


@query(f"WITH {CODED} SELECT candidate, round(score, 6) AS score FROM fused")
def rank_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = [levenshtein_order(spark, sf_dir), missing_activity_order(spark, sf_dir)]
    return ordering.fused(ranks, [0.7, 0.3]).select("candidate", F.round("score", 6).alias("score"))


@query(f"WITH {CODED} SELECT * FROM lev_ranks WHERE rank <= greatest(1, ceil(0.1 * (SELECT count(*) FROM lev_ranks)))")
def rate_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.rate_filter(levenshtein_order(spark, sf_dir), 0.1)


@query(f"WITH {CODED} SELECT l.candidate AS chosen FROM lev_ranks l JOIN missing m USING (candidate) WHERE l.rank <= greatest(1, ceil(0.5 * (SELECT count(*) FROM lev_ranks))) ORDER BY m.score, l.candidate LIMIT 1")
def chosen_variant_conv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearer half by distance, and of these the one with the fewest unknown activities."""
    steps = [(ordering.levenshtein_scores, 0.5), (lambda v: ordering.missing_activity_scores(v, ["user"]), None)]
    return spark.createDataFrame([(ordering.choose(_conv_variants(spark, sf_dir), steps),)], "chosen string")


@query(f"WITH {CODED} SELECT a.variant AS a, b.variant AS b, levenshtein(a.code, b.code)::INT AS distance FROM coded a JOIN coded b ON a.variant < b.variant WHERE length(a.code) > 1 AND length(b.code) > 1")
def variant_distances_conv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of sequences, the tree edit distance is that of their activities."""
    rows = variants.variants(logs.conversation_log(spark, sf_dir)).where("contains(variant_json, 'follows')")
    text = lambda c: F.array_join(variants.label_array(c), ",")
    found = clustering.distances(rows).select(text("a").alias("x"), text("b").alias("y"), "distance")
    return found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "distance")


# Patterns

LABEL_SUPPORTS = {
    "TraceTransaction": "SELECT activity AS pattern, count(DISTINCT case_id)::BIGINT AS support FROM e GROUP BY activity",
    "TraceOccurrence": "SELECT activity AS pattern, count(*)::BIGINT AS support FROM e GROUP BY activity",
    "VariantTransaction": "SELECT activity AS pattern, count(DISTINCT variant)::BIGINT AS support FROM e JOIN seq USING (case_id) GROUP BY activity",
    "VariantOccurrence": "SELECT activity AS pattern, sum(n)::BIGINT AS support FROM (SELECT DISTINCT variant, activity, n FROM (SELECT case_id, activity, count(*) AS n FROM e GROUP BY case_id, activity) JOIN seq USING (case_id)) GROUP BY activity",
}
for _strategy, _sql in LABEL_SUPPORTS.items():
    query(f"WITH {SQL_VIEWS['conv']}, {SEQ}, l AS ({_sql}) SELECT * FROM l WHERE support >= 5", f"frequent_labels_conv_{_strategy.lower()}")(
        lambda spark, sf_dir, st=_strategy: mining.frequent_patterns(variants.variants(logs.conversation_log(spark, sf_dir)), st, least=5, size=1).select("pattern", "support")
    )


@query(f"""WITH {SQL_VIEWS['conv']}, p AS (SELECT DISTINCT x.case_id, x.activity || '...' || y.activity || '...' || z.activity AS pattern FROM e x JOIN e y ON x.case_id = y.case_id AND y.pos >= x.pos + 2 JOIN e z ON y.case_id = z.case_id AND z.pos >= y.pos + 2)
SELECT pattern, count(*) AS support FROM p GROUP BY pattern HAVING count(*) >= 5""")
def frequent_chains_conv_k3(spark: SparkSession, sf_dir: str) -> DataFrame:
    trees = variants.variants(logs.conversation_log(spark, sf_dir))
    return mining.frequent_chains(trees, least=5, size=1, longest=3).where("k = 3").select("pattern", "support")


@query(f"""WITH {SQL_VIEWS['conv']}, s AS (SELECT activity, count(DISTINCT case_id) AS support FROM e GROUP BY activity HAVING count(DISTINCT case_id) >= 5),
p AS (SELECT DISTINCT x.case_id, x.activity AS a, y.activity AS b FROM e x JOIN e y ON x.case_id = y.case_id AND y.pos >= x.pos + 2), c AS (SELECT a, b, count(*) AS support FROM p GROUP BY a, b HAVING count(*) >= 5)
SELECT a || '...' || b AS pattern, c.support, round(c.support / greatest(s.support, t.support), 2) AS confidence FROM c JOIN s ON s.activity = a JOIN s t ON t.activity = b
UNION ALL SELECT activity, support, NULL FROM s""")
def chain_confidences_conv(spark: SparkSession, sf_dir: str) -> DataFrame:
    trees = variants.variants(logs.conversation_log(spark, sf_dir))
    return mining.confidences(mining.frequent_chains(trees, least=5, size=1, longest=2)).select("pattern", "support", "confidence")


@query(f"""WITH {SQL_VIEWS['conv']}, x AS (SELECT case_id, activity AS a, lead(activity) OVER (PARTITION BY case_id ORDER BY pos) AS b FROM e)
SELECT '→(' || a || ', ' || b || ')' AS pattern, count(DISTINCT case_id) AS support FROM x WHERE b IS NOT NULL GROUP BY a, b HAVING count(DISTINCT case_id) >= 5""")
def frequent_infixes_conv_k3(spark: SparkSession, sf_dir: str) -> DataFrame:
    trees = variants.variants(logs.conversation_log(spark, sf_dir))
    return mining.frequent_patterns(trees, least=5, size=3).where("k = 3").select("pattern", "support")


@query()
def frequent_infixes_li(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.frequent_patterns(variants.trees(logs.lineitem_log(spark, sf_dir)), least=50, size=5).drop("pattern_json")


@query(f"""WITH {SQL_VIEWS['conv']}, p AS (SELECT DISTINCT x.case_id, x.activity || '...' || y.activity AS pattern FROM e x JOIN e y ON x.case_id = y.case_id AND y.pos >= x.pos + 2)
SELECT pattern, count(*) AS support FROM p GROUP BY pattern HAVING count(*) >= 5""")
def frequent_chains_conv_k2(spark: SparkSession, sf_dir: str) -> DataFrame:
    trees = variants.variants(logs.conversation_log(spark, sf_dir))
    return mining.frequent_chains(trees, least=5, size=1, longest=2).where("k = 2").select("pattern", "support")


@query()
def frequent_chains_conv(spark: SparkSession, sf_dir: str) -> DataFrame:
    trees = variants.variants(logs.conversation_log(spark, sf_dir))
    return mining.confidences(mining.frequent_chains(trees, "TraceOccurrence", least=10, size=4, longest=3)).drop("pattern_json")


# In sequences, infixes are sub-lists; one is closed or maximal if none that is longer by one says otherwise
@query(f"""WITH {SQL_VIEWS['conv']}, a AS (SELECT case_id, list(activity ORDER BY pos) AS acts FROM e GROUP BY case_id),
l AS (SELECT case_id, acts, unnest(range(1, 7)) AS n FROM a), w AS (SELECT case_id, acts, n, unnest(range(1, len(acts) - n + 2)) AS i FROM l WHERE n <= len(acts)),
p AS (SELECT DISTINCT case_id, n, acts[i:i + n - 1] AS x FROM w), f AS (SELECT n, x, count(*) AS support FROM p GROUP BY n, x HAVING count(*) >= 5),
up AS (SELECT f.x, bool_or(g.support = f.support) AS same FROM f JOIN f g ON g.n = f.n + 1 AND (g.x[1:f.n] = f.x OR g.x[2:f.n + 1] = f.x) GROUP BY f.x)
SELECT CASE WHEN n = 1 THEN 1 ELSE n + 1 END::INT AS k, CASE WHEN n = 1 THEN x[1] ELSE '→(' || array_to_string(x, ', ') || ')' END AS pattern, support, NOT coalesce(same, false) AS closed, same IS NULL AS maximal FROM f LEFT JOIN up USING (x)""")
def closed_and_maximal_conv(spark: SparkSession, sf_dir: str) -> DataFrame:
    trees = variants.variants(logs.conversation_log(spark, sf_dir))
    return mining.closed_and_maximal(mining.frequent_patterns(trees, least=5, size=7)).drop("pattern_json")


@query()
def closed_chains_conv(spark: SparkSession, sf_dir: str) -> DataFrame:
    trees = variants.variants(logs.conversation_log(spark, sf_dir))
    return mining.closed_and_maximal(mining.frequent_chains(trees, least=10, size=3, longest=3)).drop("pattern_json")


# Models: which conversations fit a model, as wholes, prefixes, infixes and suffixes

MODEL = "->(X('system', tau), *(->('user', 'assistant'), tau))"
FITTING = {
    "full": "^(system,)?user,assistant(,user,assistant)*$",
    "prefix": "^(|system|(system,)?user(,assistant,user)*(,assistant)?)$",
    "infix": "^(|system|(system,)?user(,assistant,user)*(,assistant)?|assistant(,user,assistant)*(,user)?)$",
    "suffix": "^(|(system,)?user,assistant(,user,assistant)*|assistant(,user,assistant)*)$",
}
for _mode, _regex in FITTING.items():
    query(f"WITH {SQL_VIEWS['conv']}, {SEQ} SELECT variant, count(*) AS n_cases, regexp_matches(variant, '{_regex}') AS fits FROM seq GROUP BY variant", f"fitting_conversations_{_mode}")(
        lambda spark, sf_dir, m=_mode: alignment.align_log(logs.conversation_log(spark, sf_dir), process_tree.parse(MODEL), m).select(F.array_join("acts", ",").alias("variant"), "n_cases", alignment.fits().alias("fits"))
    )


@query()
def alignment_moves_conv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.node_counts(alignment.align_log(logs.conversation_log(spark, sf_dir), process_tree.parse(MODEL)))


# Leaves of the model, in preorder: 2 system, 3 its silent alternative, 6 user, 7 assistant, 8 going round again
@query(f"""WITH {SQL_VIEWS['conv']}, {SEQ}, f AS (SELECT case_id FROM seq WHERE regexp_matches(variant, '{FITTING['full']}')),
n AS (SELECT case_id, sum((activity = 'system')::INT) AS s, sum((activity = 'user')::INT) AS u FROM e SEMI JOIN f USING (case_id) GROUP BY case_id),
c AS (SELECT 2 AS node, sum(s) AS n FROM n UNION ALL SELECT 3, sum(1 - s) FROM n UNION ALL SELECT 6, sum(u) FROM n UNION ALL SELECT 7, sum(u) FROM n UNION ALL SELECT 8, sum(u - 1) FROM n)
SELECT node, n::BIGINT AS n FROM c WHERE n > 0""")
def fitting_moves_conv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the conversations that fit go through each leaf of the model."""
    aligned = alignment.align_log(logs.conversation_log(spark, sf_dir), process_tree.parse(MODEL))
    return alignment.node_counts(aligned.where(alignment.fits())).where(F.col("node").isin(2, 3, 6, 7, 8)).select("node", "n")


@query(f"WITH {SQL_VIEWS['conv']}, {SEQ} SELECT case_id, (max(t) - min(s))::DOUBLE AS cycle FROM e JOIN seq USING (case_id) WHERE regexp_matches(variant, '{FITTING['full']}') GROUP BY case_id")
def model_cycle_times_conv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model's cycle time in each conversation that fits."""
    log, tree = logs.conversation_log(spark, sf_dir), process_tree.parse(MODEL)
    fitting = alignment.align_sequences(projection.sequences(log), tree).where(alignment.fits()).select("case_id")
    rows = tree_performance.tree_intervals(log, tree).where("node = 0 AND kind = 'cycle'").join(fitting, "case_id", "left_semi")
    return rows.select("case_id", seconds_between("start_ts", "end_ts").alias("cycle"))


@query(f"WITH {SQL_VIEWS['conv']}, {SEQ} SELECT count(DISTINCT variant) AS n_sequences, true AS all_fit, true AS frozen_stays FROM seq")
def frozen_model_conv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sequences added to a model one after another, its pair of turns frozen: whether all fit in the end, and
    whether the pair stands there once, as it was."""
    traces = sorted(discovery.counted(logs.conversation_log(spark, sf_dir)).items(), key=lambda x: (-x[1], x[0]))
    tree, added = process_tree.parse("->('user', 'assistant')"), []
    pair = tree
    for trace, _ in traces:
        tree = discovery.add_trace_frozen(tree, added, trace, [process_tree.nodes(tree).index(pair)])
        added.append(trace)
    aligner = alignment.Aligner(tree)
    row = (len(added), all(aligner.align(t).fits for t in added), process_tree.nodes(tree).count(pair) == 1)
    return spark.createDataFrame([row], "n_sequences long, all_fit boolean, frozen_stays boolean")


@query(f"""WITH {SQL_VIEWS['conv']}, x AS (SELECT case_id, activity AS a, lead(activity) OVER w AS b, pos, lag(activity) OVER w AS before FROM e WINDOW w AS (PARTITION BY case_id ORDER BY pos)),
p AS (SELECT a, b FROM x UNION ALL SELECT NULL, a FROM x WHERE before IS NULL) SELECT a, b, count(*) AS n FROM p GROUP BY a, b""")
def directly_follows_graph_conv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discovery.directly_follows(logs.conversation_log(spark, sf_dir))


@query()
def discovered_model_conv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inductively mined tree, and one discovered trace by trace, with their F-measures."""
    log = logs.conversation_log(spark, sf_dir)
    trees = {"inductive": discovery.discover(log), "incremental": discovery.rebuild(log)}
    return spark.createDataFrame([(k, process_tree.text(t), alignment.f_measure(log, t)) for k, t in trees.items()], "method string, tree string, f_measure double")


# Clusters and rewrites


@query()
def variant_clusters_conv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster_by_distance(variants.variants(logs.conversation_log(spark, sf_dir)), most_distance=2)


@query()
def label_clusters_ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster_by_labels(variants.variants(logs.event_log(spark, sf_dir)), 4)


@query()
def sequentialised_variants_ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Simultaneous clicks and views as a click before a view."""
    return variants.variants(logs.event_log(spark, sf_dir), change=lambda t: sequentializer.apply(t, "+('click', 'view', ...)", "+(->('click', 'view'), ...)"))


# Sub-variant performance

query(f"WITH {SQL_VIEWS['li']}, {SUB}, d AS (SELECT case_id, epoch(max(t) - min(s)) AS x FROM e GROUP BY case_id) SELECT subvariant, {sql_statistics('x', 3)} FROM d JOIN whole USING (case_id) GROUP BY subvariant", "subvariant_durations")(
    lambda spark, sf_dir: performance.subvariant_durations(logs.lineitem_log(spark, sf_dir), digits=3)
)
query(f"WITH {SQL_VIEWS['li']}, {SUB}, d AS (SELECT case_id, name, epoch(t - s) AS x FROM numbered) SELECT subvariant, name, {sql_statistics('x', 3)} FROM d JOIN whole USING (case_id) GROUP BY subvariant, name", "subvariant_services")(
    lambda spark, sf_dir: performance.subvariant_services(logs.lineitem_log(spark, sf_dir), digits=3)
)
query(
    f"""WITH {SQL_VIEWS['li']}, {SUB}, steps2 AS (SELECT case_id, ts, list(name ORDER BY name) FILTER (k = 's') AS starts, list(name ORDER BY name) FILTER (k = 'c') AS ends
  FROM (SELECT case_id, s AS ts, name, 's' AS k FROM numbered UNION ALL SELECT case_id, t, name, 'c' FROM numbered) GROUP BY case_id, ts),
w AS (SELECT case_id, row_number() OVER o AS step, ts, starts, lag(ts) OVER o AS was, lag(ends) OVER o AS ended FROM steps2 WINDOW o AS (PARTITION BY case_id ORDER BY ts)),
u AS (SELECT case_id, step, epoch(ts - was) AS wait, CASE WHEN len(starts) >= len(ended) THEN list_transform(starts, lambda x: {{'f': ended[1], 't': x}}) ELSE list_transform(ended, lambda x: {{'f': x, 't': starts[1]}}) END AS p
  FROM w WHERE len(starts) > 0 AND len(ended) > 0), x AS (SELECT case_id, step, wait, unnest(p) AS q FROM u),
d AS (SELECT subvariant, step, q.f AS from_name, q.t AS to_name, wait FROM x JOIN whole USING (case_id))
SELECT subvariant, step, from_name, to_name, {sql_statistics('wait', 3)} FROM d GROUP BY subvariant, step, from_name, to_name""",
    "subvariant_wait_stats",
)(lambda spark, sf_dir: performance.subvariant_wait_statistics(logs.lineitem_log(spark, sf_dir), digits=3))


@query()
def tree_intervals_conv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree_performance.node_totals(tree_performance.tree_intervals(logs.conversation_log(spark, sf_dir), process_tree.parse(MODEL)))


# A run of user, assistant ends where one follows the other among the two
@query(f"""WITH {SQL_VIEWS['conv']}, q AS (SELECT case_id, pos, activity AS a, lead(activity) OVER (PARTITION BY case_id ORDER BY pos) AS b FROM e WHERE activity IN ('user', 'assistant')),
k AS (SELECT case_id, sum((a = 'user' AND coalesce(b, '') = 'assistant')::INT) AS k FROM q GROUP BY case_id), c AS (SELECT DISTINCT case_id FROM e), o AS (SELECT case_id, coalesce(k, 0) AS k FROM c LEFT JOIN k USING (case_id)),
n AS (SELECT sum((activity = 'user')::INT) AS u, sum((activity = 'assistant')::INT) AS v, count(*) AS n FROM e)
SELECT sum(k) / (sum(k) + 1) AS support_tax, sum((k > 0)::INT) / count(*) AS support_trans, least(sum(k) / count(*), 1.0)::DOUBLE AS support_occ,
  round(2 / (any_value(u) / sum(k) + any_value(v) / sum(k)), 9) AS confidence, round((any_value(u) + any_value(v)) / any_value(n), 9) AS coverage, 1.0::DOUBLE AS precision, 2::INT AS n_transitions FROM o, n""")
def local_model_measures_conv(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = local_models.measures(logs.conversation_log(spark, sf_dir), process_tree.parse("->('user', 'assistant')"))
    return m.select("support_tax", "support_trans", "support_occ", F.round("confidence", 9).alias("confidence"), F.round("coverage", 9).alias("coverage"), "precision", "n_transitions")


@query()
def local_model_skips_conv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return local_models.measures(logs.conversation_log(spark, sf_dir), process_tree.parse("->('user', X('assistant', ->('...', 'assistant')))"), skips=True)


@query()
def alignment_order_conv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.ranked(ordering.alignment_scores(_conv_variants(spark, sf_dir), process_tree.parse(MODEL)))
