"""Statistics of a column: null-skipping aggregates, exact linear percentiles, sample deviation."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NAMES = ("min", "max", "mean", "median", "n", "n_not_none", "p50", "p95", "stdev", "percentage_variance")


def statistics(value: Column | str, digits: int | None = None) -> list[Column]:
    """Aggregates named NAMES. ``n`` counts nulls too; one value has a deviation of 0; the percentage is null
    where the mean is 0."""
    x = F.col(value) if isinstance(value, str) else value
    x = x.cast("double")
    sd = F.when(F.count(x) == 1, F.lit(0.0)).otherwise(F.stddev_samp(x))
    parts = [F.min(x), F.max(x), F.avg(x), F.percentile(x, 0.5), F.count(F.lit(1)), F.count(x), F.percentile(x, 0.5), F.percentile(x, 0.95), sd, F.when(F.avg(x) != 0, sd / F.avg(x) * 100)]
    cut = lambda c, name: c if digits is None or name in ("n", "n_not_none") else F.round(c, digits)
    return [cut(c, name).alias(name) for c, name in zip(parts, NAMES, strict=True)]


def statistics_of(rows: DataFrame, by: list[str], names: tuple[str, ...] = NAMES, digits: int | None = None) -> DataFrame:
    """Statistics of statistics: for each of the columns ``names`` of ``rows``, a row ``key`` with the statistics of
    its values in each group of ``by`` (all rows where there are none); nulls count as missing."""
    pairs = ", ".join(f"'{n}', CAST(`{n}` AS DOUBLE)" for n in names)
    long = rows.select(*by, F.expr(f"stack({len(names)}, {pairs}) AS (key, value)"))
    return long.groupBy(*by, "key").agg(*statistics("value", digits))


MOST_GROUPS = 100_000


def exact_percentiles(rows: DataFrame, by: list[str], value: str, points: list[float], accuracy: int = 10_000) -> DataFrame:
    """``by``, n and p (an array by ``points``): exact linear percentiles for groups of any size.

    A sketch of each group brackets each percentile's rank; the values below a bracket are only counted, and only
    those inside it, some 4 / ``accuracy`` of a group, are sorted. So no task holds a group's values. There may be
    MOST_GROUPS groups at most (their brackets are broadcast); nulls are left out, and a group of nulls has null
    percentiles."""
    x = F.col(value).cast("double")
    margin = 2 / accuracy

    def edge(p: float, side: int) -> Column:
        at = p + side * margin
        return F.min("__x") if at <= 0 else F.max("__x") if at >= 1 else F.percentile_approx("__x", F.lit(at), F.lit(accuracy))

    own = rows.select(*by, x.alias("__x"))
    brackets = own.groupBy(*by).agg(F.count("__x").alias("n"), F.array(*(F.struct(edge(p, -1).alias("low"), edge(p, 1).alias("high")) for p in points)).alias("__b"))
    known = brackets.limit(MOST_GROUPS + 1).collect()
    if len(known) > MOST_GROUPS:
        raise ValueError(f"more than {MOST_GROUPS} groups")
    table = rows.sparkSession.createDataFrame(known, brackets.schema)
    same = lambda a, b: F.lit(True) if not by else _all_equal(a, b, by)
    near = own.where("__x IS NOT NULL").alias("r").join(F.broadcast(table).alias("t"), same("r", "t"))
    at = near.select(*(F.col(f"r.{c}").alias(c) for c in by), F.col("r.__x").alias("x"), F.posexplode("t.__b").alias("k", "b"))
    by_point = lambda where, x, m: at.where(where).groupBy(*by, "k").agg(x.alias("x"), m.alias("m")).select(*by, "k", "x", "m")
    # a small group's rank may be that of the value next to the bracket
    below = by_point(F.col("x") < F.col("b.low"), F.max("x"), F.count("*"))
    above = by_point(F.col("x") > F.col("b.high"), F.min("x"), F.max(F.lit(1).cast("long")))
    inside = at.where((F.col("x") >= F.col("b.low")) & (F.col("x") <= F.col("b.high"))).groupBy(*by, "k", "x").agg(F.count("*").alias("m"))
    upto = F.sum("m").over(Window.partitionBy(*by, "k").orderBy("x"))
    counted = below.unionByName(inside).unionByName(above).withColumn("upto", upto)
    ranked = counted.alias("c").join(F.broadcast(table.select(*by, "n")).alias("t"), same("c", "t")).select(*(F.col(f"c.{c}").alias(c) for c in by), "k", "x", "m", "upto", "n")
    rank = F.element_at(F.array(*map(F.lit, points)), F.col("k") + 1) * (F.col("n") - 1)
    holds = lambda r: F.max(F.when((F.col("upto") > r) & (F.col("upto") - F.col("m") <= r), F.col("x")))
    found = ranked.groupBy(*by, "k").agg(holds(F.floor(rank)).alias("a"), holds(F.ceil(rank)).alias("b"), F.max(rank - F.floor(rank)).alias("f"))
    listed = found.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", (F.col("a") + F.col("f") * (F.col("b") - F.col("a"))).alias("v")))), lambda v: v["v"]).alias("p"))
    out = table.select(*by, "n").alias("t").join(listed.alias("l"), same("t", "l"), "left")
    return out.select(*(F.col(f"t.{c}").alias(c) for c in by), "n", F.coalesce("p", F.array(*[F.lit(None).cast("double")] * len(points))).alias("p"))


def _all_equal(a: str, b: str, by: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in by])


def _in_order(x: str, at: str) -> Column:
    """The values of a group by what orders them; the values themselves need no order."""
    less = lambda a, b: F.when(a[at] < b[at], -1).when(a[at] > b[at], 1).otherwise(0)
    return F.array_sort(F.collect_list(F.struct(F.col(at).alias(at), F.col(x).alias(x))), less)


#: Aggregates by name: the mean and the sum that skip nulls (null without a value), values by their place, and
#: the values as they are. Each takes a value and the column that orders it.
AGGREGATES: dict[str, Callable[[str, str], Column]] = {
    "avg": lambda x, at: F.avg(x),
    "sum": lambda x, at: F.sum(x),
    "min": lambda x, at: F.min(x),
    "max": lambda x, at: F.max(x),
    "count": lambda x, at: F.count(F.lit(1)),
    "index": lambda x, at: F.map_from_entries(F.transform(_in_order(x, at), lambda v, i: F.struct(i, v[x]))),
    "noop": lambda x, at: F.transform(_in_order(x, at), lambda v: v[x]),
}


def seconds_between(start: Column | str, end: Column | str) -> Column:
    """Seconds from one timestamp to another as a double; null if either is."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    return F.timestamp_diff("MICROSECOND", col(start), col(end)) / 1e6


def sql_statistics(x: str, digits: int = 6) -> str:
    """The same as SQL text for DuckDB."""
    sd = f"CASE WHEN count({x}) = 1 THEN 0.0 ELSE stddev_samp({x}) END"
    return (
        f"round(min({x})::DOUBLE, {digits}) AS min, round(max({x})::DOUBLE, {digits}) AS max, round(avg({x}), {digits}) AS mean, round(quantile_cont({x}::DOUBLE, 0.5), {digits}) AS median, "
        f"count(*) AS n, count({x}) AS n_not_none, round(quantile_cont({x}::DOUBLE, 0.5), {digits}) AS p50, round(quantile_cont({x}::DOUBLE, 0.95), {digits}) AS p95, "
        f"round({sd}, {digits}) AS stdev, round(CASE WHEN avg({x}) <> 0 THEN ({sd}) / avg({x}) * 100 END, {digits}) AS percentage_variance"
    )
