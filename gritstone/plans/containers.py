"""Containers made of the tables' rows, for queries that read them back."""

from __future__ import annotations

import bz2
import gzip
import io
import lzma
import struct
import tarfile
import zipfile
import zlib
from collections.abc import Callable
from functools import cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.binary import EPOCH


def _bgzf(data: bytes) -> bytes:
    """Members of at most 65,280 bytes that carry their packed size, and an empty one at the end."""
    out = b""
    for at in [*range(0, len(data), 65_280), len(data)]:
        part = data[at : at + 65_280]
        packer = zlib.compressobj(1, zlib.DEFLATED, -15)
        body = packer.compress(part) + packer.flush()
        out += b"\x1f\x8b\x08\x04" + bytes(5) + b"\xff" + struct.pack("<H2sHH", 6, b"BC", 2, len(body) + 25) + body + struct.pack("<2I", zlib.crc32(part), len(part))
    return out


def _lzip(data: bytes) -> bytes:
    body = lzma.compress(data, lzma.FORMAT_RAW, filters=[{"id": lzma.FILTER_LZMA1, "dict_size": 1 << 20, "lc": 3, "lp": 0, "pb": 2}])
    return b"LZIP\x01" + bytes([20]) + body + struct.pack("<I2Q", zlib.crc32(data), len(data), len(body) + 26)


def _arrow(codec: str, head: bytes = b"") -> Callable[[bytes], bytes]:
    def pack(data: bytes) -> bytes:
        import pyarrow as pa

        return head + pa.compress(data, codec=codec, asbytes=True)

    return pack


def _chunked(head: bytes) -> Callable[[bytes], bytes]:
    """Packed chunks of at most 65,536 bytes; the checksums are left at zero, as readers here pass them over."""

    def pack(data: bytes) -> bytes:
        chunk = _arrow("snappy")
        bodies = [bytes(4) + chunk(data[at : at + 65_536]) for at in range(0, len(data), 65_536)]
        return head + b"".join(b"\0" + len(x).to_bytes(3, "little") + x for x in bodies)

    return pack


def _zstd(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor().compress(data)


COMPRESSIONS: dict[str, Callable[[bytes], bytes]] = {
    "bgzf": _bgzf, "br": _arrow("brotli", b"\xce\xb2\xcf\x81"), "bzip2": bz2.compress, "gzip": gzip.compress, "lz4": _arrow("lz4"), "lzip": _lzip,
    "s2": _chunked(b"\xff\x06\x00\x00S2sTwO"), "snappy": _chunked(b"\xff\x06\x00\x00sNaPpY"), "xz": lzma.compress, "zlib": zlib.compress, "zstd": _zstd,
}

Members = list[tuple[str, bytes]]


def _zip(members: Members) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, body in members:
            archive.writestr(name, body)
    return out.getvalue()


def _tar(members: Members) -> bytes:
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as archive:
        for name, body in members:
            entry = tarfile.TarInfo(name)
            entry.size = len(body)
            archive.addfile(entry, io.BytesIO(body))
    return out.getvalue()


def _ar(members: Members) -> bytes:
    return b"!<arch>\n" + b"".join(f"{name + '/':<16}{0:<12}{0:<6}{0:<6}{644:<8}{len(body):<10}`\n".encode() + body + b"\n" * (len(body) % 2) for name, body in members)


def _cpio(members: Members) -> bytes:
    out = b""
    for name, body in [*members, ("TRAILER!!!", b"")]:
        fields = [0, 0o100644, 0, 0, 1, 0, len(body), 0, 0, 0, 0, len(name) + 1, 0]
        out += b"070701" + b"".join(b"%08X" % x for x in fields) + name.encode() + b"\0"
        out += bytes(-len(out) % 4) + body
        out += bytes(-len(out) % 4)
    return out


def _rpm(members: Members) -> bytes:
    section = b"\x8e\xad\xe8\x01" + bytes(12)
    return b"\xed\xab\xee\xdb".ljust(96, b"\0") + 2 * section + gzip.compress(_cpio(members))


def _iso(members: Members) -> bytes:
    """A primary volume at block 16, its root folder at 17 and on, then the files."""

    def record(name: bytes, block: int, size: int, flags: int) -> bytes:
        body = struct.pack("<BI", 0, block) + struct.pack(">I", block) + struct.pack("<I", size) + struct.pack(">I", size) + bytes(7) + bytes([flags]) + bytes(6) + bytes([len(name)]) + name
        body += bytes((len(body) + 1) % 2)
        return bytes([len(body) + 1]) + body

    root, files, block = record(b"\0", 17, 2048, 2) + record(b"\1", 17, 2048, 2), b"", 18
    for name, data in members:
        root += record(name.encode() + b";1", block, len(data), 0)
        files += data + bytes(-len(data) % 2048)
        block += -(-len(data) // 2048)
    volume = b"\x01CD001\x01".ljust(156, b"\0") + record(b"\0", 17, 2048, 2)
    return bytes(0x8000) + volume.ljust(2048, b"\0") + root.ljust(2048, b"\0") + files


def _xar(members: Members) -> bytes:
    toc, heap = "", b""
    for name, body in members:
        packed = zlib.compress(body)
        toc += f'<file><name>{name}</name><type>file</type><data><offset>{len(heap)}</offset><length>{len(packed)}</length><size>{len(body)}</size><encoding style="application/x-gzip"/></data></file>'
        heap += packed
    text = f"<xar><toc>{toc}</toc></xar>".encode()
    head = zlib.compress(text)
    return b"xar!" + struct.pack(">2H2QI", 28, 1, len(head), len(text), 0) + head + heap


def _cab(members: Members) -> bytes:
    """One folder of plain blocks."""
    whole = b"".join(body for _, body in members)
    blocks = [whole[at : at + 32_768] for at in range(0, len(whole), 32_768)]
    entries, at = b"", 0
    for name, body in members:
        entries += struct.pack("<2I4H", len(body), at, 0, 0, 0, 0) + name.encode() + b"\0"
        at += len(body)
    data = b"".join(struct.pack("<I2H", 0, len(x), len(x)) + x for x in blocks)
    start = 36 + 8 + len(entries)
    head = b"MSCF" + struct.pack("<5I2B5H", 0, start + len(data), 0, 44, 0, 3, 1, 1, len(members), 0, 0, 0)
    return head + struct.pack("<I2H", start, len(blocks), 0) + entries + data


ARCHIVES: dict[str, Callable[[Members], bytes]] = {"ar": _ar, "cab": _cab, "cpio": _cpio, "iso": _iso, "rpm": _rpm, "tar": _tar, "xar": _xar, "zip": _zip}


@F.pandas_udf(T.BinaryType())
def compressed(data: pd.Series, kind: pd.Series) -> pd.Series:
    return pd.Series([COMPRESSIONS[k](bytes(d)) for d, k in zip(data, kind, strict=True)], dtype=object)


@F.pandas_udf(T.BinaryType())
def archived(first: pd.Series, second: pd.Series, kind: pd.Series) -> pd.Series:
    """An archive with the members ``a.txt`` and ``b.txt``."""
    return pd.Series([ARCHIVES[k]([("a.txt", bytes(a)), ("b.txt", bytes(b))]) for a, b, k in zip(first, second, kind, strict=True)], dtype=object)


def _ticks(seconds: int) -> int:
    return EPOCH + 10_000_000 * int(seconds)


@F.pandas_udf(T.BinaryType())
def shortcut(name: pd.Series, size: pd.Series, read_only: pd.Series, seconds: pd.Series) -> pd.Series:
    """A shell link: born at the second, used a second later, changed two later."""

    def one(n, s, r, t) -> bytes:
        base, born = n.encode("latin-1") + b"\0\0", _ticks(t)
        return struct.pack("<I16x2I3QI20x", 0x4C, 2, int(r), born, born + 10_000_000, born + 20_000_000, s) + struct.pack("<7I", 28 + len(base), 28, 1, 0, 28, 0, 28 + len(base) - 1) + base

    return pd.Series([one(*x) for x in zip(name, size, read_only, seconds, strict=True)], dtype=object)


@cache
def _blank_record(letters: int, size: int) -> tuple[bytes, int]:
    """A record without number, times, name and size for a name of so many letters and bytes, and where its size goes."""

    def attribute(kind: int, body: bytes) -> bytes:
        total = -(-(24 + len(body)) // 8) * 8
        return (struct.pack("<2I2B3HIH2x", kind, total, 0, 0, 0, 0, 0, len(body), 24) + body).ljust(total, b"\0")

    body = attribute(0x10, bytes(48)) + attribute(0x30, bytes(64) + bytes([letters, 1]) + bytes(size))
    at = 56 + len(body) + 48
    body += struct.pack("<2I2B3H", 0x80, 72, 1, 0, 64, 0, 0).ljust(48, b"\0") + bytes(24) + b"\xff" * 4
    head = b"FILE" + struct.pack("<2HQ4H2IQ2HI", 48, 3, 0, 1, 1, 56, 1, 0, 1024, 0, 0, 0, 0)
    return (head.ljust(48, b"\0") + b"\x07\0" + bytes(6) + body).ljust(1024, b"\0"), at


@F.pandas_udf(T.BinaryType())
def file_record(name: pd.Series, number: pd.Series, size: pd.Series, seconds: pd.Series, later: pd.Series) -> pd.Series:
    """A record of a file table whose second set of times lies ``later`` seconds after the first."""
    second = 10_000_000

    def one(n, k, s, t, more) -> bytes:
        wide, born = n.encode("utf-16-le"), _ticks(t)
        kept = born + second * more
        blank, at = _blank_record(len(n), len(wide))
        record = bytearray(blank)
        struct.pack_into("<I", record, 44, k)
        struct.pack_into("<4Q", record, 80, born, born + second, born + 2 * second, born + 3 * second)
        struct.pack_into("<4Q", record, 160, kept, kept + second, kept + 2 * second, kept + 3 * second)
        record[218 : 218 + len(wide)] = wide
        struct.pack_into("<2Q", record, at, s, s)
        record[510:512] = record[1022:1024] = b"\x07\0"
        return bytes(record)

    return pd.Series([one(*x) for x in zip(name, number, size, seconds, later, strict=True)], dtype=object)


@F.pandas_udf(T.BinaryType())
def journal(fields: pd.Series, number: pd.Series, micros: pd.Series) -> pd.Series:
    """A journal of one entry with the given ``NAME=value`` fields."""

    def thing(kind: int, body: bytes) -> bytes:
        data = bytes([kind]) + bytes(7) + struct.pack("<Q", 16 + len(body)) + body
        return data + bytes(-len(data) % 8)

    def one(items, n, t) -> bytes:
        out, places = (b"LPKSHHRH" + bytes(80) + struct.pack("<Q", 240)).ljust(240, b"\0"), b""
        for x in items:
            places += struct.pack("<2Q", len(out), 0)
            out += thing(1, bytes(48) + x.encode())
        return out + thing(3, struct.pack("<3Q", n, t, 0) + bytes(24) + places)

    return pd.Series([one(*x) for x in zip(fields, number, micros, strict=True)], dtype=object)
