"""Tables of a folder of Parquet files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..shipping import bound_batches, ship


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table; times without a zone are in UTC, which the session is set to."""
    ship(spark)
    bound_batches(spark)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    rows = spark.read.parquet(f"{folder}/{name}.parquet")
    return rows.withColumns({c: rows[c].cast("timestamp") for c, kind in rows.dtypes if kind == "timestamp_ntz"})


def splits(rows: DataFrame) -> int | None:
    """The tasks that ``rows`` is read by, found from the listing of its files alone; None behind a shuffle."""
    run = rows._jdf.queryExecution()
    if run.executedPlan().getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        return None
    return run.toRdd().getNumPartitions()


def spread(rows: DataFrame) -> DataFrame:
    """Rows that fewer tasks than there are cores would read, dealt out over all cores; others as they are.

    A file of one row group is one task, however many splits it has, and so is a small one. The rule looks
    at the layout only: a table that has a split for each core is never shuffled, whatever its size.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    found = splits(rows)
    return rows.repartition(cores) if found is not None and found < cores else rows
