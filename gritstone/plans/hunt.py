"""The hunt: normalised events, judged by a rule, made unique, cut to a time range and put in order.

The order of the steps is part of the meaning: an event that repeats an earlier one is dropped even
if the earlier one does not pass the rule or the range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import events as E
from . import sigma


def normalise(table: DataFrame) -> DataFrame:
    """Events of the engine's schema from rows (event_id, ts, user_id, event_type, value, props).

    The event type stands for the level of an event log, and ``k`` of the properties for its id.
    """
    level = F.when(F.col("event_type") == "error", 1).when(F.col("event_type") == "purchase", 2).when(F.col("event_type") == "signup", 3).when(F.col("event_type") == "click", 4).otherwise(5)
    k = F.get_json_object("props", "$.k")
    return table.select(
        F.col("ts").alias("time"), (F.unix_micros("ts") * 1000).alias("time_ns"), F.concat(F.lit("host"), (F.col("user_id") % 10).cast("string")).alias("host"),
        F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("user"), F.concat(F.col("event_type"), F.lit(" by "), F.col("user_id").cast("string")).alias("message"),
        E.eventlog_severity(level).alias("severity"), F.col("user_id").cast("string").alias("sequence"), F.lit("eventlog").alias("source"), F.col("event_type").alias("category"),
        F.when(F.col("user_id") % 7 == 0, "").otherwise(F.concat(F.lit("service"), (F.col("user_id") % 3).cast("string"))).alias("service"),
        F.create_map(F.lit("EventID"), F.concat(F.lit(46), F.lpad(k, 2, "0")), F.lit("k"), k, F.lit("EventType"), F.col("event_type")).alias("fields"),
    ).withColumn("service", E.known_service(F.col("service")))


def hunt(events: DataFrame, rule: dict | str | None = sigma.CRITICAL, unique: bool = False, least_ns: int | None = None, most_ns: int | None = None, order: bool = False) -> DataFrame:
    """Events that pass; without a rule all do."""
    if rule is not None:
        events = events.withColumn("_match", sigma.compile_rule(rule))
    if unique:
        events = E.uniq(events, "user", "category")
    if rule is not None:
        events = events.where("_match").drop("_match")
    events = E.in_time_range(events, least_ns, most_ns)
    return E.ordered(events) if order else events
