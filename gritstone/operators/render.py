"""Events as text: triage lines, CEF, JSON, and the shapes of two log indexes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.digests import digests
from ..functions.scalars import sanitize, truncate

VENDOR, PRODUCT, VERSION = "Gritstone", "gritstone", "1.0.0"

# Fixed value: the version of the common schema that :func:`ecs` follows.
ECS_VERSION = "9.1.0"


def output_match(rows: DataFrame, rendered: Column, pattern: str) -> DataFrame:
    """Rows in whose rendered text, as it would be printed, the pattern is found."""
    return rows.where(F.rlike(rendered, F.lit(pattern)))


def triage() -> Column:
    """``time user@host [sequence] category: message`` with microseconds."""
    time = F.date_format("time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    clean = lambda name: sanitize(F.col(name))
    sequence = F.when(F.length("sequence") < 8, F.lpad(clean("sequence"), 8, "0")).otherwise(clean("sequence"))
    return F.trim(F.concat(time, F.lit(" "), clean("user"), F.lit("@"), clean("host"), F.lit(" ["), sequence, F.lit("] "), clean("category"), F.lit(": "), clean("message")))


def cef_escape(text: Column) -> Column:
    """White space other than blanks as blanks; backslashes, pipes and equal signs masked."""
    return F.regexp_replace(F.translate(text, "\t\n\r", "   "), r"([\\|=])", r"\\$1")


def cef() -> Column:
    """Common event format: the header, and the fields in order of their names."""
    head = F.concat(F.date_format("time", "MMM dd yyyy HH:mm:ss.SSS"), F.lit(" "), cef_escape(F.col("host")), F.lit(f" CEF:1|{VENDOR}|{PRODUCT}|{VERSION}|100|"))
    message = cef_escape(sanitize(truncate(F.col("message"), 512)))
    some = F.array_sort(F.map_entries(F.map_filter("fields", lambda k, v: v != "")))
    pairs = F.array_join(F.transform(some, lambda e: F.concat(cef_escape(e["key"]), F.lit("="), cef_escape(e["value"]))), " ")
    return F.trim(F.concat(head, message, F.lit("|"), F.col("severity").cast("string"), F.lit("|"), pairs))


def sorted_fields(fields: str = "fields") -> Column:
    """The map with its keys in order, as JSON wants it."""
    return F.map_from_entries(F.array_sort(F.map_entries(fields)))


def _given(name: str) -> Column:
    return F.nullif(F.col(name), F.lit(""))


def json_line() -> Column:
    """One JSON object per event; empty values are left out."""
    time = F.date_format("time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    names = ("host", "user", "message")
    more = ("sequence", "source", "category", "service")
    fields = F.when(F.size("fields") > 0, sorted_fields())
    return F.to_json(F.struct(time.alias("time"), *[_given(n).alias(n) for n in names], F.when(F.col("severity") != 0, F.col("severity")).alias("severity"), *[_given(n).alias(n) for n in more], fields.alias("fields")))


def ecs(original: Column | None = None) -> Column:
    """The nested struct of the common schema; ``to_json`` of it is a document."""
    original = json_line() if original is None else original
    event = F.struct(
        _given("sequence").alias("id"), F.lit("event").alias("kind"), _given("source").alias("module"), F.concat_ws(".", "source", "category").alias("dataset"),
        F.when(F.col("severity") != 0, F.col("severity").cast("long")).alias("severity"), _given("service").alias("provider"), original.alias("original"),
        digests(F.encode(original, "UTF-8"), ["MURMUR3"])["MURMUR3"].alias("hash"), F.when(F.col("source") == "eventlog", F.try_element_at("fields", F.lit("EventID"))).alias("code"),
    )
    return F.struct(
        F.struct(F.lit(ECS_VERSION).alias("version")).alias("ecs"), F.struct(F.lit(PRODUCT).alias("type"), F.lit(VERSION).alias("version")).alias("agent"),
        F.struct(_given("host").alias("hostname")).alias("host"), F.struct(_given("user").alias("id")).alias("user"), event.alias("event"),
        F.when(F.size("fields") > 0, sorted_fields()).alias("labels"), F.date_format("time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("@timestamp"), F.col("message").alias("message"),
    )


def hec_severity(severity: Column) -> Column:
    return F.when(severity >= 9, "CRITICAL").when(severity >= 7, "HIGH").when(severity >= 4, "MEDIUM").otherwise("LOW")


def hec() -> Column:
    """The struct of an HTTP event collector's entry."""
    return F.struct(
        F.unix_millis("time").alias("time"), _given("host").alias("host"), F.lit(f"{PRODUCT} {VERSION}").alias("source"), F.lit("_json").alias("sourcetype"), F.lit("main").alias("index"),
        F.when(F.size("fields") > 0, sorted_fields()).alias("fields"), F.struct(F.col("message").alias("message"), hec_severity(F.col("severity")).alias("severity")).alias("event"),
    )
