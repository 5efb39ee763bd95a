"""The share of a task in logs that grow."""

import datetime

import pytest
from pyspark.sql import functions as F

from chronoweft import session
from chronoweft.operators import relations as R
from chronoweft.plans import vql
from chronoweft.sources import logs
from tests.core.helpers import ORIGIN, random_cases


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    """Line items of 300 orders, and of four times as many."""
    out = {}
    for times in (1, 4):
        rows = [(case, 1, 1, i, float(t - s + 1), 1.0, "ARN"[ord(a) % 3], "FO"[ord(a) % 2], ORIGIN + datetime.timedelta(days=10 * s)) for case, events in random_cases(300 * times).items() for i, (a, s, t) in enumerate(events)]
        out[times] = str(tmp_path_factory.mktemp("growth"))
        kinds = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
        spark.createDataFrame(rows, kinds).coalesce(1).write.parquet(f"{out[times]}/lineitem.parquet")
    return out


def _rows(df):
    return sorted(map(tuple, df.collect()))


def test_a_larger_log_has_more_partitions(spark, folders, monkeypatch):
    monkeypatch.setattr(session, "PART_BYTES", 200)
    few, many = (logs.lineitem_log(spark, folders[k]).rdd.getNumPartitions() for k in (1, 4))
    assert few > spark.sparkContext.defaultParallelism
    assert many > 2 * few


@pytest.mark.parametrize("dealt", [200, 1 << 40])
def test_partitions_leave_results_alone(spark, folders, monkeypatch, dealt):
    log = logs.lineitem_log(spark, folders[1])
    monkeypatch.setattr(session, "PART_BYTES", 1 << 40)
    text = "'AF' isC -> 'AF' isDF 'RO';"
    expected = [_rows(R.relation_counts(log, r, occurrences=o)) for r in R.RELATIONS for o in (True, False)], _rows(vql.query_cases(log, text)), _rows(logs.to_interval(logs.to_lifecycle(log)))
    monkeypatch.setattr(session, "PART_BYTES", dealt)
    log = logs.lineitem_log(spark, folders[1])
    assert ([_rows(R.relation_counts(log, r, occurrences=o)) for r in R.RELATIONS for o in (True, False)], _rows(vql.query_cases(log, text)), _rows(logs.to_interval(logs.to_lifecycle(log)))) == expected


def test_the_number_of_partitions_is_by_the_tables_size(spark, folders, monkeypatch):
    monkeypatch.setattr(session, "PART_BYTES", 200)
    log = logs.lineitem_log(spark, folders[1])
    twice = log.join(log.select("case_id", F.col("pos").alias("other")), "case_id")
    assert session.n_parts(twice) < 5 * session.n_parts(log)  # not by the product that Spark takes for a join's size
    assert session.n_parts(spark.createDataFrame(spark.sparkContext.parallelize([(1,)]), "x int")) is None
