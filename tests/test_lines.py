import pytest
from pyspark.sql import functions as F

from gritstone.functions.scalars import Limit, humanize, is_text, mechanize, sanitize, split_part, title_key, truncate
from gritstone.operators import hexdump, lines


def texts(spark, *values):
    return spark.createDataFrame([(k, v) for k, v in enumerate(values)], "id long, text string")


def rows(df, *order):
    return [tuple(x) for x in df.orderBy(*order).collect()]


def test_lines_end_with_a_break_or_the_text(spark):
    found = rows(lines.number_lines(texts(spark, "", "\n", "a\nb", "a\r\nb\r\n", "x" * 5000, None, "a\n\nb"), "id"), "id", "line")
    assert found == [(1, 1, ""), (2, 1, "a"), (2, 2, "b"), (3, 1, "a"), (3, 2, "b"), (4, 1, "x" * 5000), (6, 1, "a"), (6, 2, ""), (6, 3, "b")]


def test_context_is_clipped_and_repeats_overlaps(spark):
    found = rows(lines.grep_context(texts(spark, "hit 1\nno\nhit 2\nno", "none", ""), "id", "hit", 1, 1), "id", "grp", "line")
    assert found == [(0, 1, 1, "hit 1"), (0, 1, 2, "no"), (0, 2, 2, "no"), (0, 2, 3, "hit 2"), (0, 2, 4, "no")]
    marked = lines.mark_groups(lines.grep_context(texts(spark, "hit\nhit"), "id", "hit"), "id")
    assert [x["starts_group"] for x in marked.orderBy("grp").collect()] == [False, True]


def test_first_of_each_takes_the_least(spark):
    data = spark.createDataFrame([("b", 2, 1), ("a", 3, 1), ("a", 1, 7), ("a", 1, 2)], "text string, id long, line long")
    assert rows(lines.first_of_each(data, "text", "id", "line"), "text") == [("a", 1, 2), ("b", 2, 1)]


def test_head_and_tail(spark):
    t = texts(spark, "a\nb\nc\n", "", "\nx")
    assert rows(lines.tail_lines(t, "id", 2), "id", "line") == [(0, 2, "b"), (0, 3, "c"), (2, 1, ""), (2, 2, "x")]
    assert rows(lines.head_lines(lines.number_lines(t, "id"), 1), "id") == [(0, 1, "a"), (2, 1, "")]


def test_limits():
    assert Limit.parse("") == Limit()
    assert Limit.parse("10") == Limit.parse("10b") == Limit(10)
    assert Limit.parse("1fh") == Limit(31)
    assert Limit.parse("-3L") == Limit(3, True, True)
    for wrong in ("ff", "-9223372036854775808", "1x", "--1"):
        with pytest.raises(ValueError):
            Limit.parse(wrong)


def test_limit_of_bytes(spark):
    data = spark.createDataFrame([(bytearray(b"abcdef"),), (bytearray(b"a"),), (bytearray(b""),)], "content binary")
    cut = lambda limit: [bytes(x[0]) for x in lines.limit_bytes(data, Limit.parse(limit)).collect()]
    assert cut("2") == [b"ab", b"a", b""]
    assert cut("-2") == [b"ef", b"a", b""]
    assert cut("-1l") == [b"abcdef", b"a", b""]


def test_sizes(spark):
    sizes = spark.createDataFrame([(0,), (1023,), (1024,), (1280,), (1536 * 1024,)], "n long")
    assert [x[0] for x in sizes.select(humanize(F.col("n"))).collect()] == ["0b", "1023b", "1.0k", "1.2k", "1.5m"]
    assert mechanize("4k") == 4096 and mechanize("7") == 7
    for wrong in ("-1", "1x", "9999999z"):
        with pytest.raises(ValueError):
            mechanize(wrong)


def test_scalars(spark):
    controls = "".join(map(chr, [*range(0x202A, 0x202F), *range(0x2066, 0x206A)]))
    data = spark.createDataFrame([(controls + "x", "a.zip!b!c", "_SOURCE_REALTIME_TIMESTAMP", "äöü€")], "t string, p string, k string, u string")
    row = data.select(sanitize(F.col("t")), *split_part(F.col("p")), title_key(F.col("k")), truncate(F.col("u"), 5), truncate(F.col("u"), 8), truncate(F.col("u"), 100)).first()
    assert tuple(row) == ("×" * 9 + "x", "a.zip", "b!c", "SourceRealtimeTimestamp", "äö", "äöü", "äöü€")


def test_text_sniff(spark):
    data = spark.createDataFrame([(bytearray(x),) for x in (b"", b"a", b"\0a", b"a" * 4096 + b"\0")], "c binary")
    assert [x[0] for x in data.select(is_text(F.col("c"))).collect()] == [False, True, False, True]


def test_hexdump_squeezes_runs(spark):
    row, other = b"U" * 16, b"0123456789abcdef"
    data = spark.createDataFrame([(0, bytearray(row * 3 + other + row * 2 + b"end")), (1, bytearray(b""))], "id long, content binary")
    plain = hexdump.plain(hexdump.rows_of(data, "id", before=2))
    squeezed = [(x["offset"], x["values"]) for x in hexdump.squeeze(plain).orderBy("offset").collect()]
    u = "55 " * 16
    assert squeezed == [(0, u), (16, "*"), (48, "30 31 32 33 34 35 36 37 38 39 61 62 63 64 65 66 "), (64, u), (80, "*"), (96, "65 6e 64 ")]


def test_hexdump_pretty(spark):
    data = spark.createDataFrame([(0, bytearray(b"ROW\n4567 VVVVVVVW")), (1, bytearray(b"\xff" * 8))], "id long, content binary")
    found = hexdump.pretty(hexdump.rows_of(data, "id")).orderBy("id", "offset").select("address", "values", "chars").collect()
    assert tuple(found[0]) == ("00000000", "52 4f 57 0a 34 35 36 37  20 56 56 56 56 56 56 56  ", "ROW·4567 VVVVVVV")
    assert found[1]["values"] == "57 ".ljust(50) and found[1]["address"] == "00000010"
    assert found[2]["values"] == ("ff " * 8).ljust(50) and found[2]["chars"] == "·" * 8
