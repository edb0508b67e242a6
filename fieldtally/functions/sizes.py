"""Broadcasts behind a check of the size."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that are broadcast at most; a larger side is joined as Spark sees fit.
MOST_ROWS = 100_000


def small(rows: DataFrame, most: int = MOST_ROWS) -> DataFrame:
    """The rows, marked for a broadcast if there are few enough."""
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows


def meeting(rows: DataFrame, most: int = MOST_ROWS) -> DataFrame:
    """The rows, marked for a broadcast if there are few enough, else for a merge: rows that come from a small file, or out of Python, look smaller to Spark than they are, and it would broadcast millions of them."""
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows.hint("merge")


#: Rows and bytes that go to a Python worker at a time where rows are texts or become many tokens or numbers.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 256, "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20}


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Lowers the session's Arrow batches for what is executed inside, so that a worker's memory doesn't grow with the rows of a task."""
    before = {name: spark.conf.get(name, None) for name in BATCH}
    try:
        for name, most in BATCH.items():
            old = before[name]
            if old is None or not old.isdigit() or not 0 < int(old) <= most:
                spark.conf.set(name, str(most))
        yield
    finally:
        for name, old in before.items():
            spark.conf.unset(name) if old is None else spark.conf.set(name, old)
