"""Block and container formats from hand-made input, and from Arrow's own encoders where it has them."""

import lzma
import random
import struct
import zlib

import pyarrow as pa
import pytest

from gritstone.sources import blocks, codecs

TEXT = b"grey stones in a wall " * 40 + bytes(range(256)) + b"aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa"


def test_lz4_frames():
    packed = pa.Codec("lz4").compress(TEXT, asbytes=True)
    assert codecs.kind_of(packed, codecs.DEFLATES) == "lz4" and codecs.inflate(packed) == TEXT
    big = random.Random(1).randbytes(300_000) + TEXT * 100
    assert codecs.inflate(pa.Codec("lz4").compress(big, asbytes=True)) == big


def test_snappy_frames():
    def frame(kind, body):
        return bytes([kind]) + len(body).to_bytes(3, "little") + body

    packed = b"\xff\x06\x00\x00sNaPpY" + frame(0, bytes(4) + pa.Codec("snappy").compress(TEXT, asbytes=True)) + frame(0xFE, b"pad") + frame(1, bytes(4) + b"plain")
    assert codecs.inflate(packed) == TEXT + b"plain"
    # a literal of four bytes, a copy of four from four back, then the same distance again for nine
    repeat = bytes([17, 3 << 2]) + b"abcd" + bytes([0 << 2 | 1, 4]) + bytes([5 << 2 | 1, 0, 1])
    assert blocks.snappy_block(repeat) == b"abcdabcd" + (b"abcd" * 3)[:9]


def test_lzo_blocks():
    # 18 + 4 literals, then a match of length 5 at distance 4 with two literals behind it, then the end
    body = bytes([17 + 4]) + b"abcd" + bytes([32 | 3, 3 << 2 | 2, 0]) + b"xy" + bytes([17, 0, 0])
    assert blocks.lzo_block(body) == b"abcdabcdaxy"
    short = bytes([17 + 4]) + b"abcd" + bytes([64 | 3 << 2, 0, 17, 0, 0])
    assert blocks.lzo_block(short) == b"abcdabc"
    header = (b"\x89LZO\x00\r\n\x1a\n".ljust(33, b"\0") + b"\x01f" + bytes(4))[:34] + b"f" + bytes(4)
    packed = header[:39] + struct.pack(">3I", 11, len(body), 0) + body + struct.pack(">3I", 3, 3, 0) + b"end" + bytes(4)
    assert codecs.inflate(packed) == b"abcdabcdaxyend"


def test_cabinets():
    one, two = TEXT, b"second" * 10
    whole = one + two
    first = zlib.compressobj(9, zlib.DEFLATED, -15)
    cut = 700
    pieces = [first.compress(whole[:cut]) + first.flush()]
    second = zlib.compressobj(9, zlib.DEFLATED, -15, zdict=whole[:cut])
    pieces.append(second.compress(whole[cut:]) + second.flush())
    data_at = 36 + 8 + 16 + 2 + 16 + 2
    out = b"MSCF" + bytes(12) + struct.pack("<I", 44) + bytes(6) + struct.pack("<3H", 1, 2, 0) + bytes(4) + struct.pack("<I2H", data_at, 2, 1)
    out += struct.pack("<2I4H", len(one), 0, 0, 0, 0, 0) + b"a\0" + struct.pack("<2I4H", len(two), len(one), 0, 0, 0, 0) + b"b\0"
    for piece, size in zip(pieces, (cut, len(whole) - cut)):
        out += struct.pack("<I2H", 0, len(piece) + 2, size) + b"CK" + piece
    assert list(codecs.expand("x", out)) == [("x!a", one), ("x!b", two)]


def test_compound_files():
    long, short = TEXT * 5, b"tiny stream"
    sectors, links = [], []

    def put(body):
        start = len(sectors)
        parts = [body[k : k + 512].ljust(512, b"\0") for k in range(0, len(body), 512)]
        sectors.extend(parts)
        links.extend([*range(start + 1, start + len(parts)), 0xFFFFFFFE])
        return start

    def entry(name, kind, start, size):
        raw = name.encode("utf-16-le") + b"\0\0"
        return (raw.ljust(64, b"\0") + struct.pack("<HB", len(raw), kind)).ljust(116, b"\0") + struct.pack("<2I", start, size) + bytes(4)

    pool = put(short.ljust(64, b"\0"))
    mini = put(struct.pack("<I", 0xFFFFFFFE).ljust(512, b"\xff"))
    big = put(long)
    folder = put(entry("Root Entry", 5, pool, 64) + entry("Long", 2, big, len(long)) + entry("Short", 2, 0, len(short)))
    table = len(sectors)
    links.append(0xFFFFFFFD)
    sectors.append(struct.pack(f"<{len(links)}I", *links).ljust(512, b"\xff"))
    head = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + bytes(22) + struct.pack("<2H", 9, 6) + bytes(14) + struct.pack("<I", folder) + bytes(4) + struct.pack("<2I", 4096, mini) + struct.pack("<I", 1) + struct.pack("<2I", 0xFFFFFFFE, 0) + struct.pack("<109I", table, *[0xFFFFFFFF] * 108)
    assert len(head) == 512 and len(long) >= 4096
    assert list(codecs.expand("x", head + b"".join(sectors))) == [("x!Long", long), ("x!Short", short)]


def seven(body, coder, size, names, sizes, packed_header=False):
    number = lambda n: bytes([n]) if n < 128 else bytes([0x80 | n >> 8, n & 255])
    streams = b"\x06" + number(0) + number(1) + b"\x09" + number(len(body)) + b"\0" + b"\x07\x0b" + number(1) + b"\0" + number(1) + coder + b"\x0c" + number(size) + b"\0"
    streams += b"\x08\x0d" + number(len(sizes)) + (b"\x09" + b"".join(number(s) for s in sizes[:-1]) if len(sizes) > 1 else b"") + b"\0\0"
    text = b"\0" + "".join(n + "\0" for n in names).encode("utf-16-le")
    header = b"\x01\x04" + streams + b"\x05" + number(len(names)) + b"\x11" + number(len(text)) + text + b"\0\0"
    out = body
    start = len(body)
    if packed_header:
        raw = lzma.compress(header, lzma.FORMAT_RAW, filters=[{"id": lzma.FILTER_LZMA1, "dict_size": 1 << 16}])
        out, start = body + raw, len(body) + len(raw)
        plain = len(header)
        header = b"\x17\x06" + number(len(body)) + number(1) + b"\x09" + number(len(raw)) + b"\0\x07\x0b" + number(1) + b"\0" + number(1) + b"\x23\x03\x01\x01\x05\x5d" + struct.pack("<I", 1 << 16) + b"\x0c" + number(plain) + b"\0\0"
    return b"7z\xbc\xaf\x27\x1c\0\x04" + bytes(4) + struct.pack("<2QI", start, len(header), 0) + out + header


@pytest.mark.parametrize("packed_header", [False, True])
def test_seven_zip(packed_header):
    one, two = TEXT, b"second" * 10
    body = lzma.compress(one + two, lzma.FORMAT_RAW, filters=[{"id": lzma.FILTER_LZMA2, "dict_size": 1 << 16}])
    archive = seven(body, b"\x21\x21\x01\x08", len(one + two), ["a", "b"], [len(one), len(two)], packed_header)
    assert list(codecs.expand("x", archive)) == [("x!a", one), ("x!b", two)]
    plain = seven(b"hello", b"\x01\x00", 5, ["c"], [5], packed_header)
    assert list(codecs.expand("x", plain)) == [("x!c", b"hello")]


def test_damage_never_raises():
    rng = random.Random(4)
    good = [pa.Codec("lz4").compress(TEXT, asbytes=True), b"\xff\x06\x00\x00sNaPpY\0\x50\0\0" + rng.randbytes(80), seven(b"hello", b"\x01\x00", 5, ["c"], [5], True)]
    for data in good:
        for _ in range(60):
            bad = bytearray(data)
            bad[rng.randrange(4, len(bad))] = rng.randrange(256)
            list(codecs.expand("x", bytes(bad)))


def test_packed_prefetch_files_are_unpacked():
    from gritstone.sources import binary
    from gritstone.sources.blocks import xpress_huffman

    def packed(symbols):
        """Chunks of codes that are all nine bits long: (symbol, extra bits, their count)."""
        bits = "".join(f"{s:09b}" + (f"{extra:0{count}b}" if count else "") for s, extra, count in symbols)
        bits += "0" * (-len(bits) % 16 + 32)
        return bytes([0x99]) * 256 + b"".join(int(bits[k : k + 16], 2).to_bytes(2, "little") for k in range(0, len(bits), 16))

    # "abcabcabcab" and then ten copies of the last byte: distance 3 takes one extra bit, distance 1 none
    text = b"abc" + b"abcabcab" + b"b" * 10
    data = packed([(97, 0, 0), (98, 0, 0), (99, 0, 0), (256 + (1 << 4 | 5), 1, 1), (256 + 7, 0, 0)])
    assert xpress_huffman(data, len(text)) == text
    plain = bytearray(300)
    plain[0:8] = (17).to_bytes(4, "little") + b"SCCA"
    plain[16:24] = "RUN\0".encode("utf-16-le")
    file = b"MAM\x04" + len(plain).to_bytes(4, "little") + packed([(x, 0, 0) for x in plain])
    assert binary.prefetch(file) == binary.prefetch(bytes(plain)) and binary.prefetch(file)["name"] == "RUN"
    assert [k for k, _ in binary.rows_of(file)] == ["pf"] and list(binary.rows_of(file[:100])) == []
