"""URL rules by a sort-merge range join on reversed-host keys.

A host's canonical key has its labels in reverse order, each ended by a dot: ``www.example.com`` is
``com.example.www.``. A rule for a host is then the interval of keys that begin with the rule's key, and
intervals either nest or are disjoint. Both sides are sorted and swept together; a stack keeps the rules
whose interval holds the present key, outermost first, and the path decides among those.

Rules are few next to urls, so up to ``max_swept_rules`` they travel with the tasks and each task sorts
and sweeps its own urls: no shuffle, so no host is hot. Beyond that bound, the rules stay a table and the
distinct (host, path) pairs are joined to it by each of the host's ancestors.

Defined cases: a null url, or one without ``://``, has an empty host and path and no rule; repeated rows
each give a row; of equally long rules, the one with the longer host wins, then the smaller string, then the
smaller verdict; an empty table gives an empty result; columns other than page_id and url are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweft.llm.common import tidy

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL_PATTERN = r"(?s)^.*?://([^/?#]*)([^?#]*)"

Rule = tuple[str, str, str]
"""Host, path and verdict."""


def host_and_path(pages: DataFrame, url: str = "url") -> DataFrame:
    """page_id, host and path, by the JVM's expressions."""
    u = F.coalesce(F.col(url), F.lit(""))
    part = lambda k: F.regexp_extract(u, URL_PATTERN, k)
    return pages.select("page_id", F.translate(part(1), UPPER, LOWER).alias("host"), part(2).alias("path"))


def host_key(host: str) -> str:
    return "".join(f"{label}." for label in reversed(host.split(".")))


Keyed = tuple[str, list[tuple[int, int, str, str, str]]]
"""A key and its rules: lengths (less is longer), the rule's text, path and verdict, best first."""


def sorted_rules(rules: Iterable[Rule]) -> list[Keyed]:
    """The rules in the order of their keys; made once, for all tasks."""
    by_key: dict[str, list[tuple[int, int, str, str, str]]] = {}
    for host, path, verdict in set(rules):
        by_key.setdefault(host_key(host), []).append((-len(host) - len(path), -len(host), host + path, path, verdict))
    return sorted((key, sorted(own)) for key, own in by_key.items())


class Sweep:
    """Rules in key order, and the stack of those whose interval holds the key last asked for.
    Keys must come in ascending order."""

    def __init__(self, rules: list[Keyed]):
        self.rules = rules
        self.next = 0
        self.stack: list[Keyed] = []

    def move_to(self, key: str) -> None:
        while self.next < len(self.rules) and self.rules[self.next][0] <= key:
            self._close(self.rules[self.next][0])
            self.stack.append(self.rules[self.next])
            self.next += 1
        self._close(key)

    def _close(self, key: str) -> None:
        while self.stack and not key.startswith(self.stack[-1][0]):
            self.stack.pop()

    def best(self, path: str) -> tuple[str, str] | None:
        found = None
        for _, own in self.stack:
            for rule in own:
                if path.startswith(rule[3]):
                    found = min(found, rule) if found else rule
                    break
        return (found[2], found[4]) if found else None


def judge_batch(hosts: list[str], paths: list[str], rules: list[Keyed], default: str) -> tuple[list[str | None], list[str]]:
    """Rule and verdict of each (host, path), by one sorted sweep."""
    names: list[str | None] = [None] * len(hosts)
    verdicts = [default] * len(hosts)
    keys = {h: host_key(h) for h in set(hosts)}
    sweep = Sweep(rules)
    for i in sorted(range(len(hosts)), key=lambda i: keys[hosts[i]]):
        sweep.move_to(keys[hosts[i]])
        if found := sweep.best(paths[i]):
            names[i], verdicts[i] = found
    return names, verdicts


def filter_urls(pages: DataFrame, rules: list[Rule] | DataFrame, default: str = "allow", max_swept_rules: int = 200_000) -> DataFrame:
    """page_id, host, path, rule and verdict of each row of ``pages``.

    ``rules``: a list, or a table with host, path and verdict. ``default`` is the verdict without a rule.
    """
    parts = host_and_path(pages)
    if isinstance(rules, DataFrame):
        some = [tuple(r) for r in rules.select("host", "path", "verdict").limit(max_swept_rules + 1).collect()]
        if len(some) > max_swept_rules:
            return _joined(parts, rules, default)
        rules = some
    elif len(rules) > max_swept_rules:
        return _joined(parts, pages.sparkSession.createDataFrame(rules, "host string, path string, verdict string"), default)
    shipped = pages.sparkSession.sparkContext.broadcast(sorted_rules(rules))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, verdicts = judge_batch(b.column(1).to_pylist(), b.column(2).to_pylist(), shipped.value, default)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(names, pa.string()), pa.array(verdicts, pa.string())], ["page_id", "host", "path", "rule", "verdict"])

    return parts.mapInArrow(tidy(run), f"page_id {dict(parts.dtypes)['page_id']}, host string, path string, rule string, verdict string")


def _joined(parts: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """The same result where the rules are too many to travel: each distinct (host, path) meets the rules
    of its host and of the host's ancestors by an equi-join, whose skewed sides Spark splits."""
    labels = F.split("host", r"\.")
    ancestors = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    r = rules.select(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), F.col("verdict").alias("rule_verdict")).distinct()
    asked = parts.select("host", "path").distinct().select("host", "path", F.explode(ancestors).alias("rule_host"))
    # longer first, then the smaller text and verdict, as in the sweep
    rank = F.struct((-F.length("rule_host") - F.length("rule_path")).alias("n"), (-F.length("rule_host")).alias("h"), F.concat("rule_host", "rule_path").alias("text"), F.col("rule_verdict").alias("v"))
    best = (
        asked.join(r, "rule_host")
        .where(F.startswith(F.col("path"), F.col("rule_path")))
        .groupBy("host", "path")
        .agg(F.min_by(F.struct(F.concat("rule_host", "rule_path").alias("rule"), F.col("rule_verdict").alias("verdict")), rank).alias("best"))
    )
    return parts.join(best, ["host", "path"], "left").select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


PRODUCTION_RULES: list[Rule] = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]

ORACLE_SQL = """
WITH numbered AS (SELECT page_id, url, row_number() OVER () AS row_id FROM pages),
parts AS (
  SELECT page_id, row_id,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
  FROM numbered),
rules(rule_host, rule_path, rule_verdict) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
best AS (
  SELECT row_id, arg_max(rule_host || rule_path, length(rule_host) + length(rule_path)) AS rule,
    arg_max(rule_verdict, length(rule_host) + length(rule_path)) AS verdict
  FROM parts JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY row_id)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM parts LEFT JOIN best USING (row_id)
"""
