"""Pairs of labels by case, without pairs of instances."""

from chronoweft.operators import relations as R
from tests.core.helpers import in_order, log_of, random_cases, relations_of


def test_labels_that_follow_are_counted_without_pairs(spark):
    cases = random_cases(80, seed=9)
    counted = R.relation_counts(log_of(spark, cases), "EF", occurrences=False)
    expected = {}
    for events in cases.values():
        e = in_order(events)
        for pair in {(e[i][0], e[j][0]) for i, j in relations_of(events)[0]}:
            expected[pair] = expected.get(pair, 0) + 1
    assert {(a, b): n for a, b, n in counted.collect()} == expected
    assert "Join" not in counted._jdf.queryExecution().executedPlan().toString()
