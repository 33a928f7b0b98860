from pyspark.sql import functions as F

from gritstone.functions.classes import classify, names, table
from gritstone.operators import stats, strings

VALUES = [
    "plain letters", "smile \U0001f600 here", "192.0.2.4", "fd12:3456:789a:0001:0002:00ff:fe00:0042", "0a:1b:2c:3d:4e:5f", "files.example", "someone@mail.example", "http://archive.example", r"\\depot\team\notes.doc",
    "3f2a9c1e-7b64-4d0f-9a58-c2e1d4b7a690", "111111-222222-333333-444444-555555-666666-077777-088888", "S-1-5-21-1410065408-2115098112-1000000007-1001", r"D:\Data\Reports\2024", r"HKEY_CURRENT_USER\Software\Example\Settings",
]
CLASSES = [[], [], ["IPv4"], ["IPv6"], ["MAC"], ["DNS"], ["Mail"], ["URL"], ["UNC", "Windows"], ["UUID"], ["BitLocker", "Credit Card"], ["SID", "Credit Card"], ["Windows"], ["Registry", "Windows"]]


def blob(spark, *contents):
    return spark.createDataFrame([(f"f{k}", bytearray(c)) for k, c in enumerate(contents)], "path string, content binary")


def carved(df):
    return [(x["offset"], x["value"]) for x in df.orderBy("path", "offset").collect()]


def test_carving_gives_offsets_and_addresses(spark):
    data = "\0".join(VALUES).encode()
    found = strings.carve_bytes(blob(spark, data), "path")
    assert [x["value"] for x in found.orderBy("offset").collect()] == VALUES
    assert found.orderBy("offset").collect()[1]["address"] == "0000000e"


def test_carving_cuts_long_runs_and_drops_short_ends(spark):
    found = carved(strings.carve_bytes(blob(spark, "3f2a9c1e-7b64-4d0f-9a58-c2e1d4b7a690\0\U0001f600 smiles".encode()), "path", least=6, most=8))
    assert [v for _, v in found] == ["3f2a9c1e", "-7b64-4d", "0f-9a58-", "c2e1d4b7", "\U0001f600 smiles"]


def test_carving_ascii_and_trim(spark):
    data = "Faces \U0001f600 smiles".encode()
    assert carved(strings.carve_bytes(blob(spark, data), "path", ascii_only=True)) == [(0, "Faces "), (10, " smiles")]
    assert carved(strings.carve_bytes(blob(spark, data), "path", ascii_only=True, trim=True)) == [(0, "Faces"), (11, "smiles")]


def test_carving_never_fails_on_any_bytes(spark):
    import random

    random.seed(5)
    data = [random.randbytes(n) for n in range(10)] + [bytes(range(256)), b"", b"\xed\xa0\x80abc", b"\xf5\x80abcd"]
    assert strings.carve_bytes(blob(spark, *data), "path", least=1).count() > 0


def test_classes_of_each_kind(spark):
    data = spark.createDataFrame([(k, v) for k, v in enumerate(VALUES)], "k long, value string")
    found = [x[1] for x in data.select("k", classify(F.col("value"), 2)).orderBy("k").collect()]
    assert found == CLASSES


def test_class_filter_ignores_case_and_implies_all_levels(spark):
    data = spark.createDataFrame([(v,) for v in [*VALUES, "d41d8cd98f00b204e9800998ecf8427e"]], "value string")
    assert sorted(x["value"] for x in strings.with_classes(data, 1, ("ipv4", "md5")).collect()) == ["192.0.2.4", "d41d8cd98f00b204e9800998ecf8427e"]


def test_names_are_sorted_without_case():
    assert names(1) == sorted(names(1), key=str.lower) and len(names(1)) == 12 and len(table(2)) == 21 and len(names()) > 40


def test_entropy_and_counts(spark):
    data = blob(spark, b"", b"a", b"a" * 4096, bytes(range(256)), b"ab\ncd\n")
    found = {x["path"]: x for x in stats.file_stats(data, "path").collect()}
    assert [found[f"f{k}"]["entropy"] for k in range(4)] == [0.0, 0.0, 0.0, 8.0]
    assert (found["f4"]["lines"], found["f4"]["bytes"]) == (2, 6)
    assert [x["path"] for x in stats.in_entropy_range(stats.file_stats(data, "path"), 0.0, 0.0).orderBy("path").collect()] == ["f0", "f1", "f2"]
    assert [x["path"] for x in stats.in_entropy_range(stats.file_stats(data, "path"), 0.5, 8.0).orderBy("path").collect()] == ["f3", "f4"]


def test_entropy_of_a_long_file_takes_no_copies_of_it():
    import tracemalloc

    import pandas as pd

    data = pd.Series([bytes(range(256)) * (1 << 17), b"", None, b"ab" * 3_000_001])
    tracemalloc.start()
    try:
        assert list(stats._entropy.func(data)) == [8.0, 0.0, 0.0, 1.0]
        assert tracemalloc.get_traced_memory()[1] < 24 << 20
    finally:
        tracemalloc.stop()


def test_blocks(spark):
    found = stats.block_stats(blob(spark, b"a" * 10 + b"\n" * 10, b""), "path", 8).orderBy("offset").collect()
    assert [(x["offset"], x["bytes"], x["lines"], x["is_block"]) for x in found] == [(0, 8, 0, True), (8, 8, 6, True), (16, 4, 4, True)]


def test_render(spark):
    row = spark.range(1).select(stats.render(F.lit(68), F.lit(0), F.lit(4.872327))).first()[0]
    assert row == "      0l     68b  4.9e [■■■■■■■■■■      ]"


def test_stored_passwords_by_their_marks(spark):
    values = {
        "$apr1$abcdefgh$" + "A" * 22: "MD5(APR)", "$P$" + "B" * 31: "phpass", "0x0200" + "AB" * 68: "MSSQL(2012)", "SCRAM-SHA-256$4096:x": "PostgreSQL SCRAM", "$krb5tgs$23$*u": "Kerberos 5 TGS-REP",
        "{SSHA512}" + "a" * 96: "SSHA-512", "$y$j9T$salt$" + "c" * 43: "yescrypt", "u::d:" + "a" * 16 + ":" + "b" * 32 + ":0101": "NetNTLMv2", "ab" * 40: "RIPEMD-320", "beef": "CRC-16", "24:AbC:dEf": "Fuzzy hash",
    }
    data = spark.createDataFrame([(v,) for v in values], "value string")
    found = {r["value"]: r["c"] for r in data.select("value", classify(F.col("value"), 3).alias("c")).collect()}
    assert all(name in found[v] for v, name in values.items()) and len(set(names())) == len(names())
