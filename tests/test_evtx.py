"""Event logs from synthetic chunks, and journals, as normalised events."""

import struct

from pyspark.sql import functions as F

from gritstone.plans.hunt import hunt
from gritstone.sources import binary, evtx
from tests_helpers import item


class Builder:
    """Writes one chunk: names and the template are stored where they are first used."""

    def __init__(self):
        self.out = bytearray(b"ElfChnk\0".ljust(512, b"\0"))
        self.names, self.template = {}, None

    def name(self, text):
        at = len(self.out)
        if text in self.names:
            self.out += struct.pack("<I", self.names[text])
        else:
            self.names[text] = at + 4
            self.out += struct.pack("<I", at + 4) + struct.pack("<IHH", 0, 0, len(text)) + text.encode("utf-16-le") + b"\0\0"

    def element(self, name, attributes=(), children=()):
        self.out += bytes([0x41 if attributes else 0x01]) + struct.pack("<HI", 0xFFFF, 0)
        self.name(name)
        if attributes:
            self.out += struct.pack("<I", 0)
            for k, v in attributes:
                self.out += b"\x06"
                self.name(k)
                self.content(v)
        if not children:
            self.out += b"\x03"
            return
        self.out += b"\x02"
        for child in children:
            if isinstance(child, tuple):
                self.element(*child)
            else:
                self.content(child)
        self.out += b"\x04"

    def content(self, value):
        if isinstance(value, int):
            self.out += b"\x0e" + struct.pack("<HB", value, 1)
        else:
            self.out += b"\x05\x01" + struct.pack("<H", len(value)) + value.encode("utf-16-le")

    def record(self, number, written, values):
        start = len(self.out)
        self.out += b"\x2a\x2a\0\0" + struct.pack("<IQQ", 0, number, written) + b"\x0f\x01\x01\0" + b"\x0c\x01" + struct.pack("<I", 7)
        if self.template is None:
            self.template = len(self.out) + 4
            self.out += struct.pack("<I", self.template) + struct.pack("<I", 0) + bytes(16)
            size_at = len(self.out)
            self.out += bytes(4) + b"\x0f\x01\x01\0"
            data = [("Data", [("Name", "Target")], [3]), ("Data", (), [4])]
            system = [("Provider", [("Name", 0)]), ("EventID", (), [1]), ("Level", (), ["2"]), ("TimeCreated", [("SystemTime", 5)]), ("Computer", (), ["box"]), ("Security", [("UserID", 2)])]
            self.element("Event", [("xmlns", "urn")], [("System", (), system), ("EventData", (), data)])
            self.out += b"\0"
            struct.pack_into("<I", self.out, size_at, len(self.out) - size_at - 4)
        else:
            self.out += struct.pack("<I", self.template)
        self.out += struct.pack("<I", len(values)) + b"".join(struct.pack("<HBB", len(v), k, 0) for k, v in values) + b"".join(v for _, v in values) + b"\0"
        size = len(self.out) - start + 4
        self.out += struct.pack("<I", size)
        struct.pack_into("<I", self.out, start + 4, size)

    def done(self):
        return bytes(self.out).ljust(evtx.CHUNK, b"\0")


def chunk():
    b = Builder()
    sid = bytes([1, 2]) + (5).to_bytes(6, "big") + struct.pack("<2I", 21, 500)
    for k in range(3):
        time = binary.EPOCH + 17_000_000_000_000_000 + k
        b.record(10 + k, time, [(1, "Prov".encode("utf-16-le")), (6, struct.pack("<H", 4624 + k)), (19, sid), (1, f"user{k}".encode("utf-16-le")), (0, b""), (17, struct.pack("<Q", time))])
    return b.done()


def test_records_and_fields():
    rows = list(evtx.records(chunk()))
    assert [(n, f["EventID"], f["Target"]) for n, _, f in rows] == [(10, "4624", "user0"), (11, "4625", "user1"), (12, "4626", "user2")]
    assert rows[0][2] == {"ProviderName": "Prov", "EventID": "4624", "Level": "2", "TimeCreated": "2023-11-14T22:13:20Z", "Computer": "box", "UserID": "S-1-5-21-500", "Target": "user0", "param2": ""}
    assert rows[1][2]["TimeCreated"] == "2023-11-14T22:13:20.0000001Z"


def test_broken_chunks_never_raise():
    import random

    random.seed(1)
    good = chunk()
    for _ in range(50):
        bad = bytearray(good)
        for _ in range(20):
            bad[random.randrange(512, 2500)] = random.randrange(256)
        list(evtx.records(bytes(bad)))
    assert list(evtx.raw_events(b"ElfChnk\0")) == []


def test_carving_to_a_hunt(spark):
    header = (b"LPKSHHRH" + bytes(80) + struct.pack("<Q", 240)).ljust(240, b"\0")
    fields = [item(1, bytes(48) + x) for x in (b"MESSAGE=hello", b"PRIORITY=3", b"_HOSTNAME=linux", b"_COMM=sshd", b"_TRANSPORT=syslog")]
    places, at = [], 240
    for f in fields:
        places += [at, 0]
        at += len(f)
    entry = item(3, struct.pack("<3Q", 9, 1_700_000_000_000_000, 5) + bytes(24) + struct.pack(f"<{len(places)}Q", *places))
    image = b"\1" * 777 + chunk() + b"junk" + header + b"".join(fields) + entry
    blobs = spark.createDataFrame([("disk", bytearray(image)), ("none", bytearray(b""))], "path string, content binary")
    rows = evtx.carve_events(blobs).orderBy(F.col("source").desc(), "time_ns").collect()
    assert [(r["source"], r["host"], r["service"], r["severity"], r["sequence"]) for r in rows] == [("journal", "linux", "sshd", 7, "9"), *[("eventlog", "box", "Prov", 8, str(10 + k)) for k in range(3)]]
    assert rows[0]["message"] == "hello" and rows[0]["fields"]["Priority"] == "3" and rows[1]["user"] == "S-1-5-21-500" and rows[1]["message"] == "Undescribed event: 4624"
    assert rows[1]["time_ns"] == 1_700_000_000_000_000_000 and rows[2]["time_ns"] == 1_700_000_000_000_000_100
    # the default rule names priorities in capitals; fields are looked up without regard to case
    assert hunt(evtx.carve_events(blobs)).count() == 3
    assert len(list(binary.rows_of(b"ElfFile\0".ljust(4096, b"\0") + chunk()))) == 3
