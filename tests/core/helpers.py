"""Small logs for the core tests, random ones, and their relations by definition."""

import datetime
import random

ORIGIN = datetime.datetime(2024, 1, 1)
LOG = "case_id int, pos int, activity string, start_ts timestamp_ntz, end_ts timestamp_ntz"

#: Labels with the signs that texts, JSON and lists are made of.
ODD_LABELS = ["cut", "weld", "pack, ship", 'test "b"', "check [10]", "a\\b"]


def in_order(events):
    return sorted(events, key=lambda e: e[1])


def log_of(spark, cases):
    """{case: [(activity, first hour, last hour), ...]} as an interval log."""
    rows = []
    for case, events in cases.items():
        for pos, (a, s, t) in enumerate(in_order(events), 1):
            rows.append((case, pos, a, ORIGIN + datetime.timedelta(hours=s), ORIGIN + datetime.timedelta(hours=t)))
    return spark.createDataFrame(rows, LOG)


def instant(labels):
    """Events one after another, without duration."""
    return [(a, i, i) for i, a in enumerate(labels)]


def random_cases(n=60, seed=4, labels="uvw", most=7, width=12, longest=None):
    rng = random.Random(seed)
    out = {}
    for case in range(n):
        events = []
        for _ in range(rng.randrange(1, most + 1)):
            s = rng.randrange(width)
            events.append((rng.choice(labels), s, s + rng.randrange(longest or width // 2)))
        out[case] = events
    return out


def relations_of(events):
    """Pairs of numbers, from 0, of instances in their order: eventually followed, directly followed, parallel."""
    e = in_order(events)
    every = [(i, j) for i in range(len(e)) for j in range(i + 1, len(e))]
    ef = {(i, j) for i, j in every if e[i][2] < e[j][1]}
    df = {(i, j) for i, j in ef if not any((i, k) in ef and e[k][2] < e[j][1] for k in range(len(e)))}
    return ef, df, set(every) - ef


def borders_of(events):
    """Numbers of the instances that start the case, and of those that end it."""
    ef, _, par = relations_of(events)
    n = len(events)
    first = min((i for i, _ in ef), default=n)
    head = {i for i in range(n) if i <= first}
    return head | {j for i, j in par if i in head}, {i for i in range(n) if not any(a == i for a, _ in ef)}
