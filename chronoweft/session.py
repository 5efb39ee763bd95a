"""Session helpers: shipping the package to executors, reading the driver's tables."""

from __future__ import annotations

import os
import re
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors once per application, as ``--py-files`` would."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        root = Path(__file__).resolve().parent
        target = os.path.join(tempfile.mkdtemp(prefix="chronoweft-"), "chronoweft.zip")
        with zipfile.ZipFile(target, "w") as archive:
            for path in sorted(root.rglob("*.py")):
                archive.write(path, str(path.relative_to(root.parent)))
        sc.addPyFile(target)
        _shipped.add(sc.applicationId)
    return spark


_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which all executors share. Only where the whole of Spark runs
    on this machine, as in tests, may it be unset: a folder of this machine's is taken then."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own_dirs:
            _own_dirs[app] = f"file://{tempfile.mkdtemp(prefix='chronoweft-shared-')}"
        found = _own_dirs[app]
    return found.rstrip("/")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables, by a path that only Spark has to understand."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


PART_BYTES = 2 << 20
"""The share of a partition in the estimated size of a table that is dealt by :func:`dealt`."""
MOST_PARTS = 20_000
_UNKNOWN = 1 << 60


def n_parts(df: DataFrame) -> int | None:
    """Over how many partitions to deal ``df``, so that a task's share, and the memory of its sorts, stays as it is
    when tables grow. None where Spark's own number will do: without an estimate of the size, or for few partitions.

    Spark would put partitions together up to a size in the shuffle, and a task with several sorts takes many times
    that. The estimate is Spark's, or what the tables below take if that is less: joins multiply estimates."""
    plan = df._jdf.queryExecution().optimizedPlan()
    leaves = plan.collectLeaves()
    bytes_of = lambda p: int(str(p.stats().sizeInBytes()))
    size = min(bytes_of(plan), sum(bytes_of(leaves.apply(i)) for i in range(leaves.size())))
    n = min(-(-size // PART_BYTES), MOST_PARTS)
    return n if size < _UNKNOWN and n > df.sparkSession.sparkContext.defaultParallelism else None


def dealt(df: DataFrame, *by: str) -> DataFrame:
    """``df`` in :func:`n_parts` partitions by columns, or as it is."""
    n = n_parts(df)
    return df.repartition(n, *by) if n else df


def together(df: DataFrame, column: str) -> DataFrame:
    """``df`` with all rows of each value in one partition: as it is if that is how it was dealt, and rows were only
    projected since."""
    plan = df.select(column)._jdf.queryExecution().optimizedPlan()
    own = plan.output().apply(0).toString()
    while plan.nodeName() == "Project":
        plan = plan.children().apply(0)
    by = plan.partitionExpressions() if plan.nodeName() == "RepartitionByExpression" else None
    return df if by is not None and by.size() == 1 and by.apply(0).toString() == own else df.repartition(column)


def local_session(cores: int | str = 8, partitions: int = 8) -> SparkSession:
    """A session for tests and the benchmark on one machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("chronoweft")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
