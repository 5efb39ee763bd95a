"""Relations between the activity instances of a case: eventually follows, directly follows, parallel.

With instances in the order of their raw starts and times cut to a granularity: ``a`` is eventually followed
by a later ``b`` if it ends before ``b`` starts, directly if nothing that ``a`` is followed by ends before
``b`` starts, and otherwise the two are parallel.

Since places follow starts, the instances that ``a`` is parallel to, directly followed by and eventually followed by are
ranges of places: those after ``a`` and up to ``low``, from there to ``high``, and from there to the last.
Both bounds come from running counts over a case's starts and ends in the order of time, so no instance meets
another to find its relations. Everything up to there is partitioned by case and spills; only pairs that are
asked for are made, and these are spread by both case and place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from chronoweft.session import n_parts
from chronoweft.sources.logs import truncated

RELATIONS = ("EF", "DF", "P")
_START, _END = 1, 2
"""Order of events at one time: an instance that ends when another starts isn't over by then."""


def _instances(log: DataFrame, granularity: str) -> DataFrame:
    return log.select("case_id", "pos", "activity", truncated("start_ts", granularity).alias("s"), truncated("end_ts", granularity).alias("t"))


def _timeline(e: DataFrame, *more: Column) -> DataFrame:
    """``e`` with each instance twice, as ``k`` = _START and, ``at`` its end, as _END."""
    both = F.array(F.struct(F.col("s").alias("at"), F.lit(_START).alias("k")), F.struct(F.col("t").alias("at"), F.lit(_END).alias("k")), *more)
    return e.select("*", F.explode(both).alias("__x")).select(*e.columns, "__x.at", "__x.k")


def _counted(condition: Column) -> Column:
    return F.sum(F.when(condition, 1).otherwise(0))


def _case() -> WindowSpec:
    return Window.partitionBy("case_id")


def _up_to() -> WindowSpec:
    """The events of a case in time, up to this one."""
    return _case().orderBy(F.col("at").asc_nulls_last(), "k", "pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _before() -> WindowSpec:
    return _case().orderBy(F.col("at").asc_nulls_last(), "k", "pos").rowsBetween(Window.unboundedPreceding, -1)


def _later() -> WindowSpec:
    """The events after this one, backwards: a frame that ends at the last row would be computed anew for each."""
    return _case().orderBy(F.desc("at"), F.desc("k"), F.desc("pos")).rowsBetween(Window.unboundedPreceding, -1)


def bounds(log: DataFrame, granularity: str = "ms", direct: bool = True) -> DataFrame:
    """case_id, pos, activity, s, t, low and last: an instance is followed by those at the places ``low`` + 1
    to ``last``, directly (with ``direct``) by those up to ``high``."""
    e = _instances(log, granularity)
    is_start = F.col("k") == _START
    found = _timeline(e).withColumn("low", _counted(is_start).over(_up_to()))
    if direct:
        found = found.withColumn("first_end", F.min(F.when(is_start, F.col("t"))).over(_later()))
    found = found.where(~is_start).drop("at", "k")
    last = F.count("*").over(_case())
    if not direct:
        return found.withColumn("last", last)
    both = F.explode(F.array(F.struct(F.col("s").alias("at"), F.lit(_START).alias("k")), F.struct(F.col("first_end").alias("at"), F.lit(_END).alias("k")))).alias("__x")
    again = found.select("*", both).select(*found.columns, "__x.at", "__x.k")
    # without a first end nothing follows, and the count is that of all starts
    return again.withColumn("high", _counted(is_start).over(_up_to())).where("k = 2").withColumn("last", last).drop("at", "k", "first_end")


def _partners(log: DataFrame, found: DataFrame, first: Column, last: Column, *others: str) -> DataFrame:
    """Rows of ``found`` (case_id, pos, activity and ``others``), each with the instances at the places given."""
    a = found.where(first <= last).select("case_id", F.col("pos").alias("a_pos"), F.col("activity").alias("a"), *others, first.alias("__first"), last.alias("__last"))
    a = a.select("case_id", "a_pos", "a", *others, F.explode(F.sequence("__first", "__last")).alias("b_pos"))
    b = log.select("case_id", F.col("pos").cast("long").alias("b_pos"), F.col("activity").alias("b"))
    if n := n_parts(log):
        a, b = (x.repartition(n, "case_id", "b_pos") for x in (a, b))
    return a.join(b, ["case_id", "b_pos"]).withColumn("b_pos", F.col("b_pos").cast("int"))


def pairs(log: DataFrame, granularity: str = "ms") -> DataFrame:
    """case_id, a_pos, b_pos, a, b, ef, df: every pair of instances of a case, the earlier one first.
    Parallel pairs are those that aren't ``ef``. The result grows with the square of a case's length."""
    met = _partners(log, bounds(log, granularity), F.col("pos").cast("long") + 1, F.col("last"), "low", "high")
    ef = F.col("b_pos") > F.col("low")
    return met.select("case_id", "a_pos", "b_pos", "a", "b", ef.alias("ef"), (ef & (F.col("b_pos") <= F.col("high"))).alias("df"))


def related(log: DataFrame, relation: str, granularity: str = "ms") -> DataFrame:
    """case_id, a_pos, b_pos, a, b of one relation. Parallel pairs stand once, activities in order."""
    if relation not in RELATIONS:
        raise ValueError(f"unknown relation {relation}")
    found = bounds(log, granularity, relation == "DF")
    low = F.col("low")
    if relation != "P":
        return _partners(log, found, low + 1, F.col("high" if relation == "DF" else "last")).select("case_id", "a_pos", "b_pos", "a", "b")
    p = _partners(log, found, F.col("pos").cast("long") + 1, low)
    swap = F.col("a") > F.col("b")
    pick = lambda x, y: F.when(swap, F.col(y)).otherwise(F.col(x))
    return p.select("case_id", pick("a_pos", "b_pos").alias("a_pos"), pick("b_pos", "a_pos").alias("b_pos"), F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def follows_some(log: DataFrame, wanted: dict[str, set[str]], granularity: str = "ms") -> DataFrame:
    """case_id, pos, activity and, for each relation (ef, df, par) and label in ``wanted``, whether the instance is
    in that relation to some instance with the label: a column ``relation:number``, numbers by the labels'
    order. Running counts by label take the place of pairs."""
    e = _instances(log, granularity)
    names = {x: i for i, x in enumerate(sorted(set().union(*wanted.values())))}
    ef, df, par = (sorted(wanted.get(r, ())) for r in ("ef", "df", "par"))
    is_start, is_end = F.col("k") == _START, F.col("k") == _END
    of = lambda x: F.col("activity") == x
    out = _timeline(e)
    for x in sorted({*ef, *df, *par}):  # starts up to this event
        out = out.withColumn(f"n{names[x]}", _counted(is_start & of(x)).over(_up_to()))
    for x in ef:
        out = out.withColumn(f"all{names[x]}", _counted(is_start & of(x)).over(_case()))
    for x in par:  # at a start: how many are going on
        out = out.withColumn(f"open{names[x]}", (_counted(is_start & of(x)).over(_before()) - _counted(is_end & of(x)).over(_before())))
    if df:
        out = out.withColumn("first_end", F.min(F.when(is_start, F.col("t"))).over(_later()))
    at_start = lambda c: F.max(F.when(is_start, F.col(c)))
    at_end = lambda c: F.max(F.when(is_end, F.col(c)))
    marks = [(at_end(f"all{names[x]}") > at_end(f"n{names[x]}")).alias(f"ef:{names[x]}") for x in ef]
    marks += [((F.coalesce(at_start(f"open{names[x]}"), F.lit(0)) > 0) | (at_end(f"n{names[x]}") > at_start(f"n{names[x]}"))).alias(f"par:{names[x]}") for x in par]
    marks += [at_end(f"n{names[x]}").alias(f"__low{names[x]}") for x in df]
    marks += [at_end("first_end").alias("first_end")] if df else []
    merged = out.groupBy("case_id", "pos", "activity", "s").agg(*marks) if marks else e
    if df:
        both = F.explode(F.array(F.struct(F.col("s").alias("at"), F.lit(_START).alias("k")), F.struct(F.col("first_end").alias("at"), F.lit(_END).alias("k")))).alias("__x")
        again = merged.select("*", both).select(*(f"`{c}`" for c in merged.columns), "__x.at", "__x.k")
        for x in df:
            again = again.withColumn(f"df:{names[x]}", F.col("at").isNotNull() & (_counted(is_start & of(x)).over(_up_to()) > F.col(f"__low{names[x]}")))
        merged = again.where(is_end)
    return merged.select("case_id", "pos", "activity", *(f"`{r}:{names[x]}`" for r, own in (("ef", ef), ("df", df), ("par", par)) for x in own))


def borders(log: DataFrame, granularity: str = "ms", strict_start: bool = False, lone_start: bool = True) -> DataFrame:
    """case_id, pos, activity, is_start, is_end of every instance.

    An instance ends its case if nothing eventually follows it. It starts the case if its place is at most
    that of the first instance that something follows, or if it is parallel to such a one;
    ``strict_start``: if it follows nothing. The only instance of a case starts it unless ``lone_start`` is off.
    """
    e = _instances(log, granularity)
    case = Window.partitionBy("case_id")
    later = case.orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, -1)
    e = e.withColumn("last_start", F.max("s").over(later))
    e = e.withColumn("is_end", F.coalesce(F.col("t") >= F.col("last_start"), F.lit(True)))
    earlier = case.orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    e = e.withColumn("first_end", F.min("t").over(earlier))
    if strict_start:
        return e.select("case_id", "pos", "activity", F.coalesce(F.col("s") <= F.col("first_end"), F.lit(True)).alias("is_start"), "is_end")
    first = F.min(F.when(~F.col("is_end"), F.col("pos"))).over(case)
    e = e.withColumns({"first": first, "n": F.count("*").over(case)})
    head = F.col("first").isNull() | (F.col("pos") <= F.col("first"))
    # parallel to an instance of the head that came before: that one doesn't end before this starts
    latest = F.max(F.when(head, F.col("t"))).over(earlier)
    is_start = F.when((F.col("n") == 1) & F.lit(not lone_start), False).otherwise(head | F.coalesce(latest >= F.col("s"), F.lit(False)))
    return e.select("case_id", "pos", "activity", is_start.alias("is_start"), "is_end")


def _following_labels(log: DataFrame, granularity: str) -> DataFrame:
    """case_id, a, b: the labels of which some instance of ``a`` is eventually followed by some of ``b``, each pair once
    a case. That is so if the last ``b`` stands after the least ``low`` of an ``a``, so no pairs of instances are made."""
    own = bounds(log, granularity, False).groupBy("case_id", "activity").agg(F.min("low").alias("low"), F.max("pos").alias("place"))
    case = own.groupBy("case_id").agg(F.collect_list(F.struct("activity", "low", "place")).alias("labels"))
    first = case.select("case_id", "labels", F.explode("labels").alias("x"))
    after = F.filter("labels", lambda y: y["place"] > F.col("x.low"))
    return first.select("case_id", F.col("x.activity").alias("a"), F.explode(after).alias("y")).select("case_id", "a", F.col("y.activity").alias("b"))


def relation_counts(log: DataFrame, relation: str, granularity: str = "ms", occurrences: bool = True, weights: DataFrame | None = None) -> DataFrame:
    """a, b, support of a relation's activity pairs: the sum over cases of how often they occur, or of
    whether they do. ``weights`` (case_id, weight): how many cases a case stands for."""
    rows = _following_labels(log, granularity) if relation == "EF" and not occurrences else related(log, relation, granularity)
    if weights is not None:
        rows = rows.join(weights, "case_id")
    weight = F.col("weight") if weights is not None else F.lit(1)
    if not occurrences:
        if relation != "EF" and (n := n_parts(log)):
            rows = rows.repartition(n, "case_id", "a", "b")
        rows = rows.groupBy("case_id", "a", "b").agg(F.first(weight).alias("weight"))
        weight = F.col("weight")
    return rows.groupBy("a", "b").agg(F.sum(weight).cast("long").alias("support"))


def frequent_pairs(log: DataFrame, relation: str, least: int, granularity: str = "ms", occurrences: bool = False) -> DataFrame:
    """a, b, support of the activity pairs that are in a relation in at least ``least`` cases (or so often)."""
    return relation_counts(log, relation, granularity, occurrences).where(F.col("support") >= least)


def case_graphs(log: DataFrame, granularity: str = "ms") -> DataFrame:
    """One row a case for queries: maps from activity to its places (acts, starts, ends), and from
    ``a``, U+0001, ``b`` to the places of those ``a`` that are related to some ``b`` (df, ef, par; par both
    ways)."""
    name = lambda x, y: F.concat(F.col(x), F.lit("\u0001"), F.col(y))
    p = pairs(log, granularity)
    kinds = F.array(
        F.when(F.col("ef"), F.struct(F.lit("ef").alias("rel"), name("a", "b").alias("key"), F.col("a_pos").alias("at"))),
        F.when(F.col("df"), F.struct(F.lit("df").alias("rel"), name("a", "b").alias("key"), F.col("a_pos").alias("at"))),
        F.when(~F.col("ef"), F.struct(F.lit("par").alias("rel"), name("a", "b").alias("key"), F.col("a_pos").alias("at"))),
        F.when(~F.col("ef"), F.struct(F.lit("par").alias("rel"), name("b", "a").alias("key"), F.col("b_pos").alias("at"))),
    )
    edges = p.select("case_id", F.explode(F.array_compact(kinds)).alias("k")).select("case_id", "k.*")
    marks = borders(log, granularity).select("case_id", F.explode(F.array_compact(F.array(F.lit("acts"), F.when(F.col("is_start"), "starts"), F.when(F.col("is_end"), "ends")))).alias("rel"), F.col("activity").alias("key"), F.col("pos").alias("at"))
    sets = edges.unionByName(marks).groupBy("case_id", "rel", "key").agg(F.sort_array(F.collect_set("at")).alias("at"))
    own = lambda rel: F.map_from_entries(F.collect_list(F.when(F.col("rel") == rel, F.struct("key", "at")))).alias(rel)
    return sets.groupBy("case_id").agg(*(own(r) for r in ("acts", "starts", "ends", "df", "ef", "par")))
