"""Every query with SQL against DuckDB on the smallest tables, and all others for rows."""

import math
import os

import pytest

import __spark_entry__ as entry
from gritstone.plans.queries import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for file in os.listdir(FOLDER):
        con.execute(f"create view {file[:-8]} as select * from '{FOLDER}/{file}'")
    return con


def plain(rows):
    return sorted(tuple(f"{x:.9g}" if isinstance(x, float) and not math.isnan(x) else str(x) for x in r) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, duck, name):
    found = QUERIES[name](spark, FOLDER)
    columns = sorted(found.columns)
    told = duck.sql(SQL[name])
    assert sorted(told.columns) == columns
    assert plain(map(tuple, found.select(columns).collect())) == plain(told.select(*[f'"{c}"' for c in columns]).fetchall())


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - SQL.keys()))
def test_has_rows(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_windows_of_a_stream(spark):
    from gritstone.streaming import hunt as stream

    rows = spark.readStream.schema(stream.EVENT_ROWS).option("pathGlobFilter", "events.parquet").parquet(FOLDER)
    counted = stream.severity_windows(stream.normalise(rows), "1 day", "1 day")
    counted.writeStream.format("memory").queryName("by_day").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert spark.sql("select sum(n) from by_day").first()[0] == 1000


def test_stream_drops_repeats_within_the_watermark(spark):
    from gritstone.streaming import hunt as stream

    rows = spark.readStream.schema(stream.EVENT_ROWS).option("pathGlobFilter", "events.parquet").parquet(FOLDER)
    unique = stream.hunt_stream(stream.normalise(rows), None, "60 days")
    unique.writeStream.format("memory").queryName("unique_events").trigger(availableNow=True).start().awaitTermination()
    keys = QUERIES["hunt_all"](spark, FOLDER).select("host", "message", "sequence").distinct().count()
    assert spark.sql("select count(*) from unique_events").first()[0] == keys
