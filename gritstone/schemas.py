"""The schemas of what the engine reads and makes."""

from __future__ import annotations

from pyspark.sql import types as T

KINDS = {
    "string": T.StringType(), "long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "binary": T.BinaryType(), "timestamp": T.TimestampType(),
    "strings": T.ArrayType(T.StringType()), "fields": T.MapType(T.StringType(), T.StringType()),
}


def struct(columns: str) -> T.StructType:
    """A schema from ``name kind`` pairs, which needs no running session."""
    return T.StructType([T.StructField(name, KINDS[kind]) for name, kind in (x.split() for x in columns.split(","))])


BLOBS = struct("path string, part string, hint string, size long, content binary, error string")
LINES = struct("path string, line long, grp long, text string")
STRINGS = struct("path string, offset long, address string, value string, classes strings")
EVENTS = struct("time timestamp, time_ns long, host string, user string, message string, severity int, sequence string, source string, category string, service string, fields fields")
TIMELINE = struct("name string, inode string, size long, mode string, m_time timestamp, a_time timestamp, c_time timestamp, b_time timestamp, anomaly boolean")
FILE_INFO = struct("file string, bytes long, lines long, offset long, entropy double, is_block boolean")
TEMPLATES = struct("service string, event_id long, template string")
WORDLIST = struct("digest string, word string")
#: Rows of the event stream as they arrive.
EVENT_ROWS = struct("event_id long, ts timestamp, user_id long, event_type string, value double, props string")
