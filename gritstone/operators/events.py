"""Log events: severity, services, messages, uniqueness, time ranges and field names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import title_key
from .lines import first_of_each

KEY = ("host", "message", "sequence")

# The severity, 0 to 10, of each level of the binary event log.
EVENTLOG_SEVERITY = {0: 10, 1: 10, 2: 8, 3: 6, 4: 3, 5: 1}


def eventlog_severity(level: Column) -> Column:
    out = F.lit(0)
    for known, severity in EVENTLOG_SEVERITY.items():
        out = F.when(level == known, severity).otherwise(out)
    return out.cast("int")


def journal_severity(priority: Column) -> Column:
    """The lower a priority the more severe; above 7 counts as most severe, none as 0."""
    return F.when(priority.isNull(), 0).when(priority <= 7, 10 - priority).otherwise(10).cast("int")


def known_service(service: Column) -> Column:
    return F.coalesce(F.nullif(service, F.lit("")), F.lit("unknown"))


def journal_fields(fields: Column) -> Column:
    """Field names in title case; names that start with a bracket go."""
    kept = F.map_filter(fields, lambda k, v: ~F.startswith(k, F.lit("(")))
    return F.map_from_entries(F.transform(F.map_entries(kept), lambda e: F.struct(title_key(e["key"]).alias("key"), e["value"].alias("value"))))


def translate(events: DataFrame, templates: DataFrame, event_id: Column) -> DataFrame:
    """``message`` from the template of (service, event id); without one it says which id is not described.

    The templates are a dictionary table; whether it is small enough to be sent to all tasks is
    left to the optimiser, which knows its size.
    """
    told = templates.select(F.col("service").alias("_service"), F.col("event_id").alias("_event_id"), F.col("template").alias("_template"))
    keyed = events.withColumn("_id", event_id.try_cast("long"))
    joined = keyed.join(told, (keyed["service"] == told["_service"]) & (keyed["_id"] == told["_event_id"]), "left")
    message = F.coalesce("_template", F.concat(F.lit("Undescribed event: "), F.coalesce(F.col("_id").cast("string"), F.lit(""))))
    return joined.withColumn("message", message).drop("_id", "_service", "_event_id", "_template")


def expand_params(message: Column, fields: Column) -> Column:
    """``$1``, ``$2`` … replaced by the fields param1, param2 … up to the first that is missing.

    A number is replaced as a whole, so ``$1`` leaves ``$10`` alone. Messages without ``$1`` stay as
    they are.
    """
    # there are no more numbers without a gap than there are such fields
    numbers = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(F.map_filter(fields, lambda k, v: F.rlike(k, F.lit("^param[0-9]+$"))))))
    name = lambda k: F.concat(F.lit("param"), k.cast("string"))
    given = F.aggregate(numbers, F.lit(0), lambda n, k: F.when((n == k - 1) & F.map_contains_key(fields, name(k)), k).otherwise(n))

    def fill(text: Column, k: Column) -> Column:
        # a replacement's own dollars and backslashes are plain text
        value = F.regexp_replace(F.try_element_at(fields, name(k)), r"([\\$])", r"\\$1")
        return F.when(k <= given, F.regexp_replace(text, F.concat(F.lit(r"\$"), k.cast("string"), F.lit(r"(?!\d)")), value)).otherwise(text)

    filled = F.aggregate(numbers, message, fill)
    return F.when(F.contains(message, F.lit("$1")), filled).otherwise(message)


def uniq(events: DataFrame, *ties: str) -> DataFrame:
    """The first event, by time, of each (host, message, sequence).

    It stands before any filter: a first occurrence that a filter drops later still hides its
    repeats. See :func:`.lines.first_of_each`.
    """
    return first_of_each(events, KEY, "time_ns", *ties)


def in_time_range(events: DataFrame, least_ns: int | None = None, most_ns: int | None = None) -> DataFrame:
    """Events within the range, both ends included."""
    if least_ns is not None and most_ns is not None and least_ns > most_ns:
        raise ValueError("invalid range")
    if least_ns is not None:
        events = events.where(F.col("time_ns") >= least_ns)
    return events if most_ns is None else events.where(F.col("time_ns") <= most_ns)


def ordered(events: DataFrame) -> DataFrame:
    """By time, then by key: a range-partitioned, spilling sort."""
    return events.orderBy("time_ns", *KEY)
