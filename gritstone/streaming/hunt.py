"""The hunt over a stream: the same steps, uniqueness within a watermark."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.events import KEY
from ..plans import sigma
from ..plans.hunt import hunt, normalise
from ..schemas import EVENT_ROWS


def read_events(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """A stream of normalised events from the Parquet files that arrive in a folder."""
    rows = spark.readStream.schema(EVENT_ROWS).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    return normalise(rows)


def hunt_stream(events: DataFrame, rule: dict | str | None = sigma.CRITICAL, unique_within: str | None = None) -> DataFrame:
    """Passing events; with ``unique_within`` repeats of a key inside that time are dropped, before the rule.

    The state is bounded by the watermark: a repeat that comes later than it is a new event.
    """
    if unique_within:
        events = events.withWatermark("time", unique_within).dropDuplicatesWithinWatermark(list(KEY))
    return hunt(events, rule)


def severity_windows(events: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Counts by severity in windows of event time; what comes later than ``late`` is dropped."""
    return events.withWatermark("time", late).groupBy(F.window("time", width), "severity").agg(F.count("*").alias("n"))


def start(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False) -> StreamingQuery:
    """Give every batch to ``sink`` with its number, so that a repeated batch can be told and replaced."""
    writer = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
