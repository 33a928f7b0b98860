import bz2
import gzip
import http.server
import io
import json
import lzma
import struct
import tarfile
import threading
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from gritstone.functions.digests import NATIVE, OTHER, digest, digests, known_bad, known_good, matching
from gritstone.sources import binary, blobs, codecs, formats, sinks

SAMPLE = b"first line\n" + b"0123456789 " * 7 + b"\nlast line"


def zipped(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, data in members.items():
            archive.writestr(name, data)
    return out.getvalue()


def tarred(**members):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w", format=tarfile.USTAR_FORMAT) as archive:
        for name, data in members.items():
            info = tarfile.TarInfo(name)
            info.size = len(data)
            archive.addfile(info, io.BytesIO(data))
    return out.getvalue()


def cpio(**members):
    out = b""
    for name, data in [*members.items(), ("TRAILER!!!", b"")]:
        fields = [1, 0o100644, 0, 0, 1, 0, len(data), 0, 0, 0, 0, len(name) + 1, 0]
        head = b"070701" + b"".join(b"%08x" % x for x in fields) + name.encode() + b"\0"
        out += head + bytes(-len(head) % 4) + data + bytes(-len(data) % 4)
    return out


def ar(**members):
    out = b"!<arch>\n"
    for name, data in members.items():
        out += f"{name + '/':<16}{0:<12}{0:<6}{0:<6}{'644':<8}{len(data):<10}`\n".encode() + data + bytes(len(data) % 2)
    return out


def zstd(data):
    import zstandard

    return zstandard.ZstdCompressor().compress(data)


def lzip(data):
    body = lzma.compress(data, lzma.FORMAT_RAW, filters=[{"id": lzma.FILTER_LZMA1, "dict_size": 1 << 20, "lc": 3, "lp": 0, "pb": 2}])
    return b"LZIP\x01" + bytes([20]) + body + struct.pack("<IQQ", zlib.crc32(data), len(data), len(body) + 26)


@pytest.mark.parametrize("pack", [gzip.compress, bz2.compress, lzma.compress, zlib.compress, zstd, lzip])
def test_compressions(pack):
    assert codecs.inflate(pack(SAMPLE)) == SAMPLE
    assert codecs.inflate(pack(pack(SAMPLE))) == SAMPLE
    with pytest.raises(ValueError):
        codecs.inflate(pack(pack(pack(SAMPLE))))


def test_old_unix_compression():
    # the empty dictionary's codes of "aaa": a (97) and then the first new code (257), nine bits each
    assert codecs.inflate(b"\x1f\x9d\x90" + (97 | 257 << 9).to_bytes(3, "little")) == b"aaa"


def test_expansion_is_cut_at_the_limit():
    assert len(codecs.inflate(gzip.compress(bytes(10_000_000)))) == 100 * len(gzip.compress(bytes(10_000_000)))


@pytest.mark.parametrize("pack", [zipped, tarred, cpio, ar])
def test_archives(pack):
    assert list(codecs.expand("x", pack(**{"note.txt": SAMPLE, "b": b"2"}))) == [("x!note.txt", SAMPLE), ("x!b", b"2")]


def test_packages_expand_up_to_the_limit():
    from gritstone.plans.containers import ARCHIVES

    text = b"Et " * 100_000
    members = [("a.txt", text), ("b.txt", b"2")]
    package = ARCHIVES["rpm"](members)
    assert len(text) > 100 * len(package)
    assert list(codecs.unpack("x", package, codecs.Limits(expansion=10_000))) == [("x!a.txt", text, None), ("x!b.txt", b"2", None)]
    first, rest = codecs.unpack("x", package)
    assert first[0] == "x!a.txt" and text.startswith(first[1]) and len(first[1]) > 99 * len(package) and first[2] == codecs.CUT
    assert rest == ("x", package, codecs.CUT)
    head = package[: package.index(b"\x1f\x8b")]
    alone = head + lzma.compress(cpio(a=text, b=b"2"), lzma.FORMAT_ALONE)
    assert [(n, e) for n, _, e in codecs.unpack("x", alone, codecs.Limits(expansion=10_000))] == [("x!a", None), ("x!b", None)]
    assert [(n, e) for n, _, e in codecs.unpack("x", alone)] == [("x!a", codecs.CUT), ("x", codecs.CUT)]
    assert [e for *_, e in codecs.unpack("x", (head + lzma.compress(cpio(a=SAMPLE), lzma.FORMAT_ALONE))[:-9])] == [codecs.BROKEN]


def test_nests_are_bounded():
    data = SAMPLE
    for _ in range(4):
        data = zipped(a=data)
    assert list(codecs.expand("x", data)) == [("x!a!a!a!a", SAMPLE)]
    path, rest, error = next(codecs.unpack("x", zipped(a=data)))
    assert path == "x!a!a!a!a" and rest[:2] == b"PK" and error == codecs.NESTED


def test_what_is_not_unpacked_is_given_with_the_reason(spark):
    deep = gzip.compress(gzip.compress(gzip.compress(SAMPLE)))
    bomb = zipped(a=bytes(1_000_000))
    rows = spark.createDataFrame([("deep", bytearray(deep)), ("bomb", bytearray(bomb)), ("broken", bytearray(zipped(a=SAMPLE)[:40])), ("plain", bytearray(SAMPLE)), ("none", None)], "path string, content binary")
    found = {x["path"]: x for x in codecs.expand_blobs(rows).collect()}
    assert {k: x["error"] for k, x in found.items()} == {"deep": codecs.DEEP, "bomb!a": codecs.CUT, "broken": codecs.BROKEN, "plain": None, "none": None}
    assert bytes(found["deep"]["content"]) == deep and len(found["bomb!a"]["content"]) == 100 * len(bomb) and found["bomb!a"]["part"] == "a"


def test_batches_for_python_are_bounded_in_bytes(spark):
    from gritstone.shipping import BATCHES, THEIRS

    spark.conf.set(BATCHES, THEIRS[0])
    blobs = spark.range(0, 24, 1, 1).select(F.col("id").cast("string").alias("path"), F.encode(F.repeat(F.lit("x"), 1 << 20), "UTF-8").alias("content"))
    assert codecs.expand_blobs(blobs).agg(F.sum("size")).first()[0] == 24 << 20

    def sizes(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["n"])

    assert max(x[0] for x in blobs.mapInArrow(sizes, "n long").collect()) < 6 << 20
    spark.conf.set(BATCHES, "1m")
    codecs.expand_blobs(blobs)
    assert spark.conf.get(BATCHES) == "1m"
    spark.conf.unset(BATCHES)


def test_each_path_is_read_by_its_own_pattern(spark, tmp_path):
    for name in ("a/one.dd", "a/b/two.dd", "a/b/c/three.dd", "a/b/two.log", "y/two.evtx", "y/+ %41.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(SAMPLE)
    (tmp_path / "y" / "m.zip").write_bytes(zipped(x=b"1", z=b"2"))
    (tmp_path / "y" / "empty.dd").write_bytes(b"")
    root = str(tmp_path)
    names = lambda rows: sorted(x["path"].removeprefix(root) for x in rows.select("path").collect())
    assert names(blobs.scan(spark, f"{root}/a/**/*.dd", f"{root}/y/two.evtx")) == ["/a/b/c/three.dd", "/a/b/two.dd", "/a/one.dd", "/y/two.evtx"]
    assert names(blobs.scan(spark, f"{root}/**/b/*.dd")) == ["/a/b/two.dd"]
    assert names(blobs.scan(spark, f"{root}/a/b", f"{root}/a/**", f"{root}/a/one.dd", f"{root}/no/such", f"{root}/no*")) == ["/a/b/c/three.dd", "/a/b/two.dd", "/a/b/two.log", "/a/one.dd"]
    assert names(blobs.scan(spark, f"{root}/{{a,y}}/*.[de]*")) == ["/a/one.dd", "/y/empty.dd", "/y/two.evtx"]
    assert blobs.scan(spark, f"{root}/none").count() == 0 and names(blobs.scan(spark, f"{root}/a", depth=1)) == ["/a/b/two.dd", "/a/b/two.log", "/a/one.dd"]
    assert names(blobs.load(spark, f"{root}/y/m.zip!x", f"{root}/a/one.dd")) == ["/a/one.dd", "/y/m.zip!x"]
    assert names(blobs.load(spark, f"{root}/y/m.zip!x", f"{root}/y/m.zip")) == ["/y/m.zip!x", "/y/m.zip!z"]
    assert tuple(blobs.total_size(blobs.scan(spark, f"{root}/y/two.evtx", f"{root}/y/empty.dd")).first()) == (2, len(SAMPLE))
    # no exchange carries content
    plan = blobs.load(spark, f"{root}/a", f"{root}/y")._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.split("\n") if "Exchange" in x and "content" in x] and "Aggregate" not in plan


def test_standard_input_is_a_path(spark, monkeypatch):
    class Input:
        buffer = io.BytesIO(SAMPLE)

    monkeypatch.setattr("sys.stdin", Input())
    assert [(x["path"], bytes(x["content"])) for x in blobs.load(spark, "-").collect()] == [("-", SAMPLE)]


def test_broken_input_never_raises():
    import random

    random.seed(3)
    for data in [random.randbytes(n) for n in range(10)] + [zipped(a=SAMPLE)[:40], m + random.randbytes(50) if (m := b"") else b""] + [o * b"\0" + m + random.randbytes(60) for _, o, m in [*codecs.DEFLATES, *codecs.ARCHIVES] if o < 300]:
        list(codecs.expand("x", data))
    for _, offset, magic in codecs.CONVERTERS:
        list(binary.rows_of(bytes(offset) + magic + random.randbytes(200)))
        list(binary.rows_of(bytes(offset) + magic))


def test_detection_is_the_same_in_the_plan(spark):
    for table in (codecs.DEFLATES, codecs.ARCHIVES, codecs.CONVERTERS):
        data = [bytes(o) + m for _, o, m in table] + [bytes(o) + m[:-1] for _, o, m in table] + [b""]
        rows = spark.createDataFrame([(k, bytearray(d)) for k, d in enumerate(data)], "k long, c binary").select("k", codecs.detect(F.col("c"), table))
        assert [x[1] for x in sorted(rows.collect())] == [codecs.kind_of(d, table) for d in data]


def test_loading(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "a.zip").write_bytes(zipped(**{"x.txt": gzip.compress(SAMPLE), "y": b"\0"}))
    (tmp_path / "in" / "deep" / "b.txt").write_bytes(SAMPLE)
    (tmp_path / "in" / "empty").write_bytes(b"")
    root = str(tmp_path / "in")
    found = {x["path"].removeprefix(root): x for x in blobs.load(spark, root).collect()}
    assert set(found) == {"/a.zip!x.txt", "/a.zip!y", "/deep/b.txt", "/empty"}
    assert bytes(found["/a.zip!x.txt"]["content"]) == SAMPLE and found["/a.zip!x.txt"]["hint"] == "text" and found["/a.zip!y"]["hint"] == ""
    assert [x["path"].removeprefix(root) for x in blobs.load(spark, f"{root}/a.zip!x.txt").collect()] == ["/a.zip!x.txt"]
    assert [x["path"].removeprefix(root) for x in blobs.load(spark, f"{root}/a.zip", raw=3).collect()] == ["/a.zip"]
    (tmp_path / "in" / "t.mft").write_bytes(record(7, "notes.txt", [filetime(9)] * 4, [filetime(9)] * 4))
    (tmp_path / "in" / "j.json").write_bytes(b'{"a":1}')
    laid = {x["path"].removeprefix(root): x for x in blobs.load(spark, root, raw=0).collect()}
    assert laid["/t.mft"]["hint"] == "json" and json.loads(laid["/t.mft"]["content"])["name"] == "notes.txt" and bytes(laid["/j.json"]["content"]) == b'{\n  "a": 1\n}'
    assert "/a.zip" in {x["path"].removeprefix(root) for x in blobs.load(spark, root, raw=4, files=1).collect()}
    with pytest.raises(ValueError):
        blobs.load(spark, root, files=2)
    (tmp_path / "in" / "t.mft").unlink()
    (tmp_path / "in" / "j.json").unlink()
    assert blobs.scan(spark, f"{root}/**/*.txt").count() == 1
    assert blobs.within_depth(blobs.scan(spark, root), root, 0).count() == 2
    assert "content" not in blobs.paths_only(spark, root)._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError):
        blobs.capped(blobs.scan(spark, root), 2)
    assert blobs.from_bytes(spark, b"x").first()["path"] == "-" and blobs.path_list("a\r\n\nb") == ["a", "b"]


def test_formats(spark):
    values = ['{"a": [1]}', "[1, 2", '{"a": 1}\n{"b"', "123\nx", '<?xml version="1.0"?><a><b> x </b></a>', "plain", "", '{"a":1}}', "1,2"]
    data = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k long, t string")
    rows = sorted(data.select("k", formats.kind(F.col("t")), formats.pretty(F.col("t"))).collect())
    assert [x[1] for x in rows] == ["json", None, "jsonl", "jsonl", "xml", None, None, None, None]
    assert rows[0][2] == '{\n  "a": [\n    1\n  ]\n}' and rows[2][2] == '{\n  "a": 1\n}\n{"b"' and "<b>x</b>" in rows[4][2]


VECTORS = {
    "ADLER32": "091e01de", "CRC32-C": "e3069283", "CRC16-CCITT": "29b1", "CRC64-ECMA": "995dc9bbdf1939fa", "CRC64-ISO": "b90956c775a41001", "CRC32-K": "2d3dd0ae",
}


def test_digest_vectors(spark):
    assert {k: digest(k, b"123456789") for k in VECTORS} == VECTORS
    assert digest("MD4", b"abc") == "a448017aaf21d8525fc10ae87aa6729d" and digest("NT", b"password") == "8846f7eaee8fb117ad06bdd830b7586c"
    assert digest("MURMUR3", b"hello") == "cbd8a7b341bd9b02" and digest("FNV-1A", b"a") == "d228cb696f1a8caf78912b704e4a8964"
    assert digest("SM3", b"abc") == "66c7f0f462eeedd9d1f2d46bdc10e4e24167c4875cf2f7a2297da02b8f4ba8e0" and digest("RIPEMD-160", b"abc") == "8eb208f7e05d987a9b044a8e98c6b087f15a0bfc"
    assert digest("LUHN", b"x") == "could not parse number" and digest("LUHN", b"7992739871") == "3" and digest("PE", b"x") == "DOS Header magic not found"
    names = [*NATIVE, *OTHER]
    data = spark.createDataFrame([(bytearray(x),) for x in (b"", b"abc", b"123456789")], "c binary")
    found = [x[0] for x in data.select(digests(F.col("c"), names)).collect()]
    assert all(len(x) == len(names) for x in found) and found[2]["CRC32-IEEE"] == "cbf43926" and found[1]["MD5"] == "900150983cd24fb0d6963f7d28e17f72"
    some = data.select(matching(digests(F.col("c"), ["MD5", "CRC32-IEEE"]), "^9001")).collect()
    assert [sorted(x[0]) for x in some] == [[], ["MD5"], []]
    with pytest.raises(ValueError):
        digests(F.col("c"), ["nope"])


def test_checksums_of_many_values_are_those_of_each_byte():
    import random
    from time import process_time

    from gritstone.functions import crc
    from gritstone.functions.digests import CRCS, crc_each

    def of_bits(data):
        value = 0xFFFF
        for byte in data:
            value ^= byte << 8
            for _ in range(8):
                value = (value << 1 ^ (0x1021 if value & 0x8000 else 0)) & 0xFFFF
        return f"{value:04x}"

    def turned(data):
        value = 0
        for byte in data:
            value = ((value >> 1) + ((value & 1) << 15) + byte) & 0xFFFF
        return f"{value:05d}"

    some = random.Random(1)
    values = [some.randbytes(n) for n in (0, 1, 3, 4, 7, 8, 9, 255, 256, 257, 511, 512, 513, 0, 5000, 65_537, 2)] + [b"\xff" * 3000, bytes(700)]
    for name, (poly, width) in CRCS.items():
        assert crc_each(name, values) == [f"{crc._plain(x, poly, width):0{width // 4}x}" for x in values]
    assert [digest("CRC16-CCITT", x) for x in values] == [of_bits(x) for x in values] and [digest("BSD", x) for x in values] == [turned(x) for x in values]
    assert digest("SYSV", b"") == "00000" and digest("SYSV", b"\xff" * 3000) == f"{sum([255] * 3000) % 65536 + sum([255] * 3000) // 65536:05d}"

    def seconds(f):
        start = process_time()
        f()
        return process_time() - start

    large, one = some.randbytes(4 << 20), some.randbytes(1 << 20)
    byte_by_byte = seconds(lambda: crc._plain(one, *CRCS["CRC32-C"]))
    assert sum(seconds(lambda n=n: digest(n, large)) for n in ("CRC32-C", "CRC32-K", "CRC16-CCITT", "SYSV")) < 2 * byte_by_byte


def test_known_files(spark):
    files = spark.createDataFrame([("a", "AA"), ("b", "bb"), ("c", "")], "file string, d string")
    known = spark.createDataFrame([("aa",)], "d string")
    assert [x["file"] for x in known_bad(files, "d", known).collect()] == ["a"]
    assert [x["file"] for x in known_good(files, "d", known).collect()] == ["b"]


def filetime(seconds):
    return (seconds * 10_000_000) + binary.EPOCH


def record(number, name, shown, kept):
    """A file record with both time attributes and resident data."""
    standard = struct.pack("<4QI", *shown, 0) + bytes(12)
    title = name.encode("utf-16-le")
    naming = bytes(8) + struct.pack("<4Q", *kept) + bytes(24) + bytes([len(name), 1]) + title
    out = b""
    for kind, body in ((0x10, standard), (0x30, naming), (0x80, b"12345")):
        total = -(-(24 + len(body)) // 8) * 8
        out += struct.pack("<IIBBHHHIH", kind, total, 0, 0, 0, 0, 0, len(body), 24) + b"\0\0" + body + bytes(total - 24 - len(body))
    head = b"FILE" + struct.pack("<HHQHHHHIIQHHI", 48, 0, 0, 3, 1, 56, 1, 0, 1024, 0, 0, 0, number)
    return (head.ljust(56, b"\0") + out + b"\xff\xff\xff\xff").ljust(1024, b"\0")


def test_file_table(spark):
    late, early = filetime(1_700_000_000) + 5, filetime(1_600_000_000)
    data = record(7, "notes.txt", [late] * 4, [late] * 4) + record(8, "set.txt", [early] * 4, [late] * 4) + bytes(1024)
    rows = list(binary.file_table(data))
    assert [(x["name"], x["inode"], x["size"], x["anomaly"], x["mode"]) for x in rows] == [("notes.txt", "7-3", 5, False, "-rwxrwxrwx"), ("set.txt", "8-3", 5, True, "-rwxrwxrwx")]
    assert rows[0]["m_time"] == "2023-11-14T22:13:20.0000005Z" and rows[1]["b_time"] == "2020-09-13T12:26:40Z"
    parsed = binary.parse(spark.createDataFrame([("t", bytearray(data)), ("u", bytearray(b"no"))], "path string, content binary")).collect()
    assert [json.loads(x["row"])["name"] for x in parsed] == ["notes.txt", "set.txt"]


def test_shortcut():
    base, suffix = b"C:\\Data\\", b"a.txt\0"
    head = struct.pack("<I16sII3QI", 76, bytes(16), 2, 1, filetime(10), filetime(20), filetime(30), 99).ljust(76, b"\0")
    info = struct.pack("<7I", 28 + len(base) + 1 + len(suffix), 28, 1, 0, 28, 0, 28 + len(base) + 1) + base + b"\0" + suffix
    row = binary.shortcut(head + info)
    assert (row["name"], row["size"], row["mode"], row["b_time"], row["m_time"], row["c_time"]) == ("C:\\Data\\a.txt", 99, "-r-xr-xr-x", "1970-01-01T00:00:10Z", "1970-01-01T00:00:30Z", None)


def test_journal():
    def item(kind, body, flags=0):
        data = bytes([kind, flags]) + bytes(6) + struct.pack("<Q", 16 + len(body)) + body
        return data + bytes(-len(data) % 8)

    header = (b"LPKSHHRH" + bytes(80) + struct.pack("<Q", 240)).ljust(240, b"\0")
    field = item(1, bytes(48) + b"MESSAGE=hello")
    packed = item(1, bytes(48) + zstd(b"PRIORITY=3"), 4)
    entry = item(3, struct.pack("<3Q", 9, 1_700_000_000_000_000, 5) + bytes(24) + struct.pack("<4Q", 240, 0, 240 + len(field), 0))
    rows = list(binary.journal(header + field + packed + entry))
    assert rows == [{"realtime": 1_700_000_000_000_000, "monotonic": 5, "sequence": 9, "fields": {"MESSAGE": "hello", "PRIORITY": "3"}}]


def test_own_interpreter_is_an_executable():
    import sys

    with open(sys.executable, "rb") as file:
        row = binary.elf(file.read())
    assert row["class"] == 64 and ".text" in [x["name"] for x in row["sections"]]


def test_offsets(spark):
    data = b"x" + b"ElfChnk\0" * 2 + b"LPKSHHRH"
    found = binary.carve_offsets(spark.createDataFrame([("d", bytearray(data))], "path string, content binary"))
    assert sorted((x["kind"], x["offset"]) for x in found.collect()) == [("evtx", 1), ("evtx", 9), ("journal", 17)]


class Collector(http.server.BaseHTTPRequestHandler):
    got: list = []
    answers: list = []

    def do_POST(self):
        body = self.rfile.read(int(self.headers["Content-Length"]))
        type(self).got.append((body, self.headers.get("Authorization"), self.headers["Content-Type"]))
        self.send_response(type(self).answers.pop(0) if type(self).answers else 200)
        self.end_headers()

    def log_message(self, *args):
        pass


@pytest.fixture
def collector():
    Collector.got, Collector.answers = [], []
    server = http.server.HTTPServer(("127.0.0.1", 0), Collector)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/"
    server.shutdown()


def test_posts_are_tried_again_on_server_errors_only(collector):
    import urllib.error

    Collector.answers = [500, 503]
    assert sinks.post(collector, b"{}", "t", wait=lambda s: None) == 200
    assert Collector.got[-1] == (b"{}", "Splunk t", "application/json") and len(Collector.got) == 3
    Collector.answers = [403]
    with pytest.raises(urllib.error.HTTPError):
        sinks.post(collector, b"{}")
    assert len(Collector.got) == 4


def test_rows_are_posted_from_tasks(spark, collector):
    rows = spark.createDataFrame([("a",), ("b",)], "body string")
    assert tuple(sinks.post_rows(rows, "body", collector).first()) == (2, 0)
    assert sorted(x[0] for x in Collector.got) == [b"a", b"b"]


def test_parquet_and_receipt(spark, tmp_path):
    path = sinks.write_parquet(spark.range(3), str(tmp_path))
    assert spark.read.parquet(path).count() == 3
    told = json.loads(sinks.receipt(path, "hunt").read_text())
    assert told["files"] and all(len(x["sha256"]) == 64 for x in told["files"])
    out = sinks.fan_out(spark.range(3), [lambda d: d.count(), lambda d: 1 / 0, lambda d: d.count()])
    assert out[0] == out[2] == 3 and isinstance(out[1], ZeroDivisionError)
    with pytest.raises(ValueError):
        sinks.check_options("http://x", None)


def test_journal_fields_packed_with_lz4():
    import struct

    from gritstone.sources import binary

    packed = struct.pack("<Q", 28) + b"\x9fMESSAGE=a\x01\x00\x00"  # nine letters, the last one 19 times more
    for head, compact in ((64, False), (72, True)):
        data = b"\0" * 8 + bytes([1, 2]) + b"\0" * 6 + struct.pack("<Q", head + len(packed)) + b"\0" * (head - 16) + packed
        assert binary._journal_field(data, 8, compact) == b"MESSAGE=" + b"a" * 20


def test_further_digests_by_published_vectors():
    from gritstone.functions.more_digests import blake3

    assert digest("BLAKE3-256", b"abc") == "6437b3ac38465133ffb63b75273a8db548c558465d79db03fd359c6cd5bd9d85" and digest("BLAKE3-512", b"abc").startswith(digest("BLAKE3-256", b"abc"))
    assert blake3(bytes(k % 251 for k in range(2049))) == "5f4d72f40d7a5f82b15ca2b2e44b1de3c2ef86c426c95c1af0b6879522563030"
    assert digest("WHIRLPOOL", b"abc").startswith("4e2448a4c6f486bb16b6562c73b4020bf3043e3a731bce721ae1b303d97e6d4c")
    assert digest("HAS-160", b"") == "307964ef34151d37c8047adec7ab50f4ff89762d" and digest("HAS-160", b"abc") == "975e810488cf2a3d49838478124afce4b1c78804"
    assert digest("MD2", b"") == "8350e5a3e24c153df2275c9f80692773" and digest("MD2", b"abc") == "da853b0d3f88d99b30283a69e6ded6bb"
    # similar files have similar signatures
    one = bytes(zlib.crc32(b"%d" % k) & 255 for k in range(5000))
    size, sign, _ = digest("SSDEEP", one).split(":")
    assert digest("SSDEEP", b"") == "3::" and 32 <= len(sign) <= 64 and digest("SSDEEP", one[:2500] + b"x" + one[2500:]).split(":")[1][:20] == sign[:20]


def test_files_without_digest_stay_only_without_lists(spark):
    from gritstone.functions.digests import chosen

    files = spark.createDataFrame([(1, "aa"), (2, ""), (3, None), (4, "bb")], "id long, digest string")
    listed = spark.createDataFrame([("AA",)], "digest string")
    ids = lambda rows: sorted(r["id"] for r in rows.collect())
    assert ids(chosen(files, "digest")) == [1, 2, 3, 4] and ids(chosen(files, "digest", good=listed)) == [4] and ids(chosen(files, "digest", bad=listed)) == [1]


def portable(imports):
    """A 32-bit executable of one section that holds an import table: library -> names or ordinals."""
    base, body = 0x1000, bytearray(20 * (len(imports) + 1))
    def put(data):
        body.extend(data)
        return base + len(body) - len(data)
    for k, (library, names) in enumerate(imports.items()):
        thunks = [x | 1 << 31 if isinstance(x, int) else put(b"\0\0" + x.encode() + b"\0") for x in names]
        table = put(struct.pack(f"<{len(thunks) + 1}I", *thunks, 0))
        struct.pack_into("<5I", body, 20 * k, table, 0, 0, put(library.encode() + b"\0"), table)
    head = bytearray(0x200)
    head[:2], head[60:64], head[64:68] = b"MZ", struct.pack("<I", 64), b"PE\0\0"
    struct.pack_into("<2H3I2H", head, 68, 0x14C, 1, 0, 0, 0, 224, 2)
    struct.pack_into("<H", head, 88, 0x10B)
    struct.pack_into("<2I", head, 88 + 96 + 8, base, len(body))
    head[88 + 224 : 88 + 230] = b".idata"
    struct.pack_into("<4I", head, 88 + 224 + 8, len(body), base, len(body), 0x200)
    return bytes(head + body)


def test_digests_of_imports():
    import hashlib

    data = portable({"KERNEL32.dll": ["WriteFile", "CreateFileW"], "odd.name": [7]})
    listed = ["kernel32.writefile", "kernel32.createfilew", "odd.name.ord7"]
    assert digest("IMPHASHO", data) == hashlib.md5(",".join(listed).encode()).hexdigest()
    assert digest("IMPHASHS", data) == hashlib.md5(",".join(sorted(listed)).encode()).hexdigest()
    assert digest("IMPFUZZY", data).startswith("3:") and digest("IMPHASHO", b"text") == "DOS Header magic not found"
