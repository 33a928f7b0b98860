import pytest
from pyspark.sql import functions as F

from gritstone.operators import directory, events, render, timeline
from gritstone.plans import sigma
from gritstone.plans.hunt import hunt
from gritstone.schemas import EVENTS


def event(spark, *rows):
    base = {"time": None, "time_ns": 0, "host": "h", "user": "u", "message": "m", "severity": 1, "sequence": "1", "source": "eventlog", "category": "c", "service": "s", "fields": {}}
    from datetime import datetime

    return spark.createDataFrame([tuple((base | {"time": datetime(2024, 1, 2, 3, 4, 5, 678901)} | x)[n] for n in EVENTS.names) for x in rows], EVENTS)


def test_uniqueness_comes_before_rule_and_range(spark):
    data = event(spark, {"time_ns": 1, "fields": {"EventID": "1"}}, {"time_ns": 2, "fields": {"EventID": "4624"}}, {"time_ns": 3, "sequence": "2", "fields": {"EventID": "4624"}})
    assert [x["time_ns"] for x in hunt(data, unique=True).collect()] == [3]
    assert [x["time_ns"] for x in hunt(data, unique=False, order=True).collect()] == [2, 3]
    assert [x["time_ns"] for x in hunt(data, None, unique=True, least_ns=2).collect()] == [3]
    with pytest.raises(ValueError):
        events.in_time_range(data, 2, 1)


def test_severities(spark):
    levels = spark.createDataFrame([(x,) for x in (0, 1, 2, 3, 4, 5, 9, None)], "l int")
    assert [x[0] for x in levels.select(events.eventlog_severity(F.col("l"))).collect()] == [10, 10, 8, 6, 3, 1, 0, 0]
    assert [x[0] for x in levels.select(events.journal_severity(F.col("l"))).collect()] == [10, 9, 8, 7, 6, 5, 10, 0]


def test_params_stop_at_the_first_gap(spark):
    data = spark.createDataFrame([("$1 $2 $3 $10 $1", {"param1": "a$b\\", "param2": "$1", "param4": "x"}), ("none $2", {"param1": "a"}), ("$1", {})], "m string, f map<string,string>")
    found = [x[0] for x in data.select(events.expand_params(F.col("m"), F.col("f"))).collect()]
    assert found[1:] == ["none $2", "$1"] and found[0].startswith("a$b\\ ") and "$3 $10" in found[0]


def test_translation(spark):
    table = spark.createDataFrame([("s", 5, "told")], "service string, event_id long, template string")
    data = event(spark, {"fields": {"EventID": "5"}}, {"fields": {"EventID": "6"}, "sequence": "2"})
    assert sorted(x["message"] for x in events.translate(data, table, F.col("fields")["EventID"]).collect()) == ["Undescribed event: 6", "told"]


def test_journal_fields(spark):
    data = spark.createDataFrame([({"_SOURCE_REALTIME_TIMESTAMP": "1", "PRIORITY": "2", "(null)": "x"},)], "f map<string,string>")
    assert data.select(events.journal_fields(F.col("f"))).first()[0] == {"SourceRealtimeTimestamp": "1", "Priority": "2"}


@pytest.mark.parametrize(
    ("detection", "expected"),
    [
        ({"s": {"eventid": 7}, "condition": "s"}, True),
        ({"s": {"EventID": [1, 7]}, "condition": "s"}, True),
        ({"s": [{"EventID": 1}, {"Name": "C:\\\\Tools\\\\*"}], "condition": "s"}, True),
        ({"s": {"Name|endswith": "cmd.EXE"}, "condition": "s"}, True),
        ({"s": {"Name|contains|all": ["tools", "cmd"]}, "condition": "s"}, True),
        ({"s": {"Name|contains|all": ["tools", "nope"]}, "condition": "s"}, False),
        ({"s": {"Name|re": "cmd\\.exe$"}, "condition": "s"}, True),
        ({"s": {"Name|cased|startswith": "c:"}, "condition": "s"}, False),
        ({"s": {"Ip|cidr": "10.0.0.0/8"}, "condition": "s"}, True),
        ({"s": {"Ip|cidr": "10.2.0.0/16"}, "condition": "s"}, False),
        ({"s": {"Count|gt": 9, "Count|lte": 10}, "condition": "s"}, True),
        ({"s": {"Missing": 1}, "condition": "not s"}, True),
        ({"s": {"Missing|exists": True}, "condition": "s"}, False),
        ({"s": {"Name|exists": True}, "condition": "s"}, True),
        ({"s": {"Empty": None}, "condition": "s"}, True),
        ({"a1": {"EventID": 1}, "a2": {"EventID": 7}, "b": {"Count": 10}, "condition": "1 of a* and b"}, True),
        ({"a1": {"EventID": 1}, "a2": {"EventID": 7}, "condition": "all of a*"}, False),
        ({"a1": {"EventID": 1}, "a2": {"EventID": 7}, "condition": "all of them or (a2 and not a1)"}, True),
        ({"s": ["wh?t"], "condition": "s"}, True),
        ({"s": {"Host": "H"}, "condition": "s"}, True),
    ],
)
def test_rules(spark, detection, expected):
    data = event(spark, {"message": "say what", "fields": {"EventID": "7", "Name": "C:\\Tools\\cmd.exe", "Ip": "10.1.2.3", "Count": "10", "Empty": ""}})
    assert data.select(sigma.compile_rule({"detection": detection})).first()[0] is expected


def test_rule_errors():
    for condition in ("s and", "(s", "t", "s s"):
        with pytest.raises(ValueError):
            sigma.compile_rule({"detection": {"s": {"a": 1}, "condition": condition}})


def test_renderings(spark):
    data = event(spark, {"message": "a|b=c\\\n", "user": "u\u202e", "fields": {"b": "2", "a": "x=y", "empty": ""}})
    row = data.select(render.triage(), render.cef(), render.json_line(), F.to_json(render.hec()), F.to_json(render.ecs())).first()
    assert row[0].startswith("2024-01-02T03:04:05.678901Z u×@h [00000001] c: a|b=c\\")
    assert row[1] == "Jan 02 2024 03:04:05.678 h CEF:1|Gritstone|gritstone|1.0.0|100|a\\|b\\=c\\\\ |1|a=x\\=y b=2"
    assert '"fields":{"a":"x=y","b":"2","empty":""}' in row[2] and '"severity":1' in row[2]
    assert '"severity":"LOW"' in row[3] and '"time":1704164645678' in row[3]
    assert '"dataset":"eventlog.c"' in row[4] and '"@timestamp":"2024-01-02T03:04:05.678901Z"' in row[4]


def test_timeline(spark):
    data = spark.sql("""SELECT * FROM VALUES
      ('a|b/c:d\\\\', '1-1', 5L, '-rwxrwxrwx', timestamp'2024-01-01 00:00:01', CAST(NULL AS timestamp), CAST(NULL AS timestamp), timestamp'2024-01-01 00:00:03')
      AS t(name, inode, size, mode, m_time, a_time, c_time, b_time)""")
    row = data.select(timeline.bodyfile(), timeline.sort_time()).first()
    assert row[0] == "0|a\\|b\\/c\\:d\\\\|1-1|-rwxrwxrwx|0|0|5|0|1704067201|0|1704067203"
    assert str(row[1]) == "2024-01-01 00:00:01"
    pairs = spark.sql("SELECT timestamp'2024-01-01 00:00:01' AS whole, timestamp'2024-01-01 00:00:01.5' AS part, timestamp'2024-01-01 00:00:00' AS early")
    check = lambda a, b: pairs.select(timeline.stomped(F.col(a), F.col(b))).first()[0]
    assert (check("whole", "part"), check("part", "part"), check("whole", "early"), check("whole", "whole")) == (True, False, False, True)


def test_history_fills_the_shorter_list(spark):
    data = spark.createDataFrame([("u", 1, ["l0"], ["n0", "n1"]), ("v", 2, [], [])], "sam_account_name string, rid long, lm_hash_history array<string>, nt_hash_history array<string>")
    found = [tuple(x) for x in directory.history_rows(data).orderBy("sam_account_name").collect()]
    assert found == [("u_history0", 1, "l0", "n0"), ("u_history1", 1, directory.EMPTY_LM, "n1")]


def test_lookup_in_word_tables(spark):
    data = spark.createDataFrame([("u", 1, "aa", "bb"), ("v", 2, "", "cc")], "sam_account_name string, rid long, lm_hash string, nt_hash string")
    words = spark.createDataFrame([("bb", "secret")], "digest string, word string")
    found = sorted(x[0] for x in directory.look_up(data, words, "lm_hash", "nt_hash").select(directory.secret_line()).collect())
    assert found == ["u:1:aa:secret:::", f"v:2:{directory.EMPTY_LM}:cc:::"]


def test_params_have_no_upper_number(spark):
    fields = F.map_from_entries(F.transform(F.sequence(F.lit(1), F.lit(40)), lambda k: F.struct(F.concat(F.lit("param"), k.cast("string")), F.concat(F.lit("v"), k.cast("string")))))
    told = spark.range(1).select(events.expand_params(F.lit("$1 $10 $21 $40 $41"), fields)).first()[0]
    assert told == "v1 v10 v21 v40 $41"


def test_carved_messages_are_told_by_templates(spark):
    from gritstone.sources import evtx

    raw = spark.createDataFrame([("eventlog", 1, "1", {"EventID": "4625", "ProviderName": "audit", "param1": "ann"}), ("eventlog", 2, "2", {"EventID": "x"}), ("journal", 3, "3", {"MESSAGE": "kept $1"})], "source string, time_ns long, sequence string, fields map<string,string>")
    templates = spark.createDataFrame([("audit", 4625, "no logon for $1 by $2")], "service string, event_id long, template string")
    found = {r["sequence"]: r["message"] for r in evtx.normalise(raw, templates).collect()}
    assert found == {"1": "no logon for ann by $2", "2": "Undescribed event: ", "3": "kept $1"}
    assert evtx.journal_ns({"SYSLOG_TIMESTAMP": "Jan  2 03:04:05"}, 1_704_000_000_000_000) == 1_672_628_645_000_000_000
    assert evtx.journal_ns({"_SOURCE_REALTIME_TIMESTAMP": "17", "Timestamp": "2024-01-01"}, 5) == 17_000
    assert evtx.journal_ns({"SYSLOG_TIMESTAMP": "soon", "Timestamp": "2024-01-01T00:00:00.5Z"}, 5) == 1_704_067_200_500_000_000 and evtx.journal_ns({}, 5) == 5_000


def test_common_schema_carries_the_digest_of_its_document(spark):
    from gritstone.functions.digests import murmur3
    from gritstone.operators import render
    from gritstone.plans.queries import hunted

    doc = hunted(spark, "/root/testdata/sf0.001").limit(5).select(render.ecs().alias("e")).select("e.event.original", "e.event.hash").collect()
    assert len(doc) == 5 and all(r["hash"] == murmur3(r["original"].encode()) for r in doc)


def test_timeline_of_files(spark):
    import struct
    from datetime import datetime

    from gritstone.operators import timeline

    def filetime(seconds):
        return (seconds + 11_644_473_600) * 10_000_000

    rows = [("t", 0, "mft", '{"name":"a","inode":"7-1","size":-3,"mode":"-rwxrwxrwx","m_time":"2024-01-02T03:04:05.1234567Z","a_time":null,"c_time":null,"b_time":null,"anomaly":true}'), ("p", 0, "pf", '{"name":"RUN.EXE","size":9,"run_count":0,"run_times":["2024-01-03T00:00:00Z","2024-01-01T00:00:00Z"],"files":["x","y"]}'), ("e", 0, "elf", "{}")]
    found = timeline.ordered(timeline.entries(spark.createDataFrame(rows, "path string, nth long, kind string, row string")), "path", "nth").collect()
    assert [(r["path"], r["name"], r["size"], r["anomaly"]) for r in found] == [("p", "RUN.EXE", 9, True), ("p", "x", 0, False), ("p", "y", 0, False)] * 2 + [("t", "a", 0, True)]
    assert found[0]["a_time"] == datetime(2024, 1, 1) and found[6]["m_time"] == datetime(2024, 1, 2, 3, 4, 5, 123456) and found[6]["inode"] == "7-1"
    link = bytearray(76)
    struct.pack_into("<I", link, 0, 0x4C)
    struct.pack_into("<3Q", link, 28, filetime(1000), filetime(2000), filetime(3000))
    one = timeline.file_timeline(spark.createDataFrame([("l", bytearray(link)), ("none", None)], "path string, content binary")).collect()
    assert [(r["b_time"].timestamp(), r["a_time"].timestamp(), r["c_time"]) for r in one] == [(1000, 2000, None)]


def odd_files():
    """Blobs of file tables, shortcuts and program runs: whole, with odd times and sizes, and broken."""
    import random
    import struct

    import pandas as pd

    from gritstone.plans import containers

    names, numbers = pd.Series(["order5.txt", "é" * 3, "", "x\U0001d11ey"]), pd.Series([5, 6, 7, (1 << 32) - 1])
    tables = list(containers.file_record.func(names, numbers, pd.Series([500, 0, 1 << 40, 3]), pd.Series([1_700_000_000, -5, 0, 10**10]), pd.Series([60, -60, 0, 5])))
    links = list(containers.shortcut.func(pd.Series(["C:\\x.lnk", "é", ""]), pd.Series([5, 6, 7]), pd.Series([0, 1, 1]), pd.Series([1_700_000_000, -5, 10**10])))
    table = bytearray(b"".join(tables))
    struct.pack_into("<4Q", table, 80, 1, (1 << 64) - 1, 0, 133_000_000_000_000_007)
    table[128 + 112 + 48 : 128 + 112 + 56] = b"\xff" * 8
    runs = bytearray(300)
    runs[:8], runs[16:24] = (23).to_bytes(4, "little") + b"SCCA", "RUN\0".encode("utf-16-le")
    struct.pack_into("<2I", runs, 100, 250, 8)
    runs[250:258] = "x\0y\0".encode("utf-16-le")
    struct.pack_into("<Q", runs, 128, 133_000_000_000_000_007)
    whole = [*tables, bytes(table), *links, bytes(runs), b"", b"no format"]
    some = random.Random(3)
    broken = [x[: some.randrange(len(x))] for x in whole if x for _ in range(3)]
    for data in [x for x in whole if x for _ in range(10)]:
        data = bytearray(data)
        data[some.randrange(len(data))] = some.randrange(256)
        broken.append(bytes(data))
    return [(f"f{k:03}", bytearray(x)) for k, x in enumerate(whole + broken)]


def test_timelines_are_those_of_the_parsed_files(spark):
    from gritstone.sources import binary

    blobs = spark.createDataFrame([*odd_files(), ("none", None)], "path string, content binary")
    kept = timeline.ordered(timeline.entries(binary.parse(blobs)), "path", "nth").collect()
    assert timeline.file_timeline(blobs).collect() == kept and {"RUN", "x", "y", "order5.txt", "C:\\x.lnk"} <= {x["name"] for x in kept}
    assert sorted(timeline.file_timeline(blobs, sort=False).collect(), key=str) == sorted(kept, key=str)


def test_files_are_made_once_for_an_ordered_timeline(spark):
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    files = odd_files()
    blobs = spark.createDataFrame(files, "path string, content binary").repartition(3).mapInArrow(count, "path string, content binary")
    assert timeline.file_timeline(blobs).count() and timeline.file_timeline(blobs).select("name", "path").collect()
    assert made.value == 2 * len(files)


def test_shortcuts_are_told_without_times_as_text(monkeypatch):
    from gritstone.sources import binary

    links = [bytes(x) for _, x in odd_files() if bytes(x[:4]) == b"L\0\0\0"]
    told = [binary.shortcut(x) for x in links[:3]]
    monkeypatch.setattr(binary, "filetime", None)
    monkeypatch.setattr(binary, "json", None)
    found = [list(binary.timeline_entries(x)) for x in links[:3]]
    assert [(x[0][0], x[0][2], x[0][3]) for x in found] == [(x["name"], x["size"], x["mode"]) for x in told]
    assert [x[0][4:8] for x in found] == [(1_700_000_002_000_000, 1_700_000_001_000_000, None, 1_700_000_000_000_000), (-3_000_000, -4_000_000, None, -5_000_000), (10_000_000_002_000_000, 10_000_000_001_000_000, None, 10_000_000_000_000_000)]


def test_output_filters(spark):
    from gritstone.operators import hexdump, render

    data = spark.createDataFrame([(1, bytearray(b"0123456789abcdef" * 2)), (2, bytearray(b"x"))], "id long, content binary")
    rows = hexdump.pretty(hexdump.rows_of(data, "id"))
    assert [r["id"] for r in hexdump.grep(rows, "37  38").collect()] == [1, 1] and hexdump.grep(rows, "37 38").count() == 0
    assert [r["id"] for r in render.output_match(data, F.concat(F.lit("row "), F.col("id").cast("string")), "^row 2$").collect()] == [2]
