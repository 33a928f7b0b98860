"""Compressed files and archives: detection by magic numbers, bounded unpacking.

Detection is a Column and runs in the JVM. Unpacking is one Arrow pass over the blobs that need it:
each row is expanded depth first on an explicit stack, so a nest of archives is one task's work and
no level is a job of its own.
"""

from __future__ import annotations

import bz2
import gzip
import io
import lzma
import struct
import tarfile
import zipfile
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import bound_batches
from . import blocks

# The magic numbers (name, offset, bytes), in the order in which they are tried.
DEFLATES = [
    ("bgzf", 0, b"\x1f\x8b\x08\x04"), ("br", 0, b"\xce\xb2\xcf\x81"), ("bzip2", 0, b"BZh"), ("gzip", 0, b"\x1f\x8b\x08"), ("kanzi", 0, b"KANZ"), ("lz4", 0, b"\x04\x22\x4d\x18"),
    ("lzip", 0, b"LZIP"), ("lzo", 0, b"\x89LZO\x00\r\n\x1a\n"), ("lzfse", 0, b"bvx$"), ("lzfse", 0, b"bvx-"), ("lzfse", 0, b"bvx1"), ("lzfse", 0, b"bvx2"), ("lzfse", 0, b"bvxn"), ("lzw", 0, b"\x1f\x9d"),
    ("minlz", 0, b"\xff\x06\x00\x00MinLz"), ("s2", 0, b"\xff\x06\x00\x00S2sTwO"), ("snappy", 0, b"\xff\x06\x00\x00sNaPpY"), ("xz", 0, b"\xfd7zXZ\x00"),
    ("zlib", 0, b"\x78\x01"), ("zlib", 0, b"\x78\x5e"), ("zlib", 0, b"\x78\x9c"), ("zlib", 0, b"\x78\xda"), ("zstd", 0, b"\x28\xb5\x2f\xfd"),
]
ARCHIVES = [
    ("7z", 0, b"7z\xbc\xaf\x27\x1c"), ("ar", 0, b"!<arch>\n"), ("cab", 0, b"MSCF"), ("cpio", 0, b"070701"), ("cpio", 0, b"070702"), ("iso", 0x8001, b"CD001"), ("iso", 0x8801, b"CD001"), ("iso", 0x9001, b"CD001"),
    ("msi", 0, b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"), ("rar", 0, b"Rar!\x1a\x07"), ("rpm", 0, b"\xed\xab\xee\xdb"), ("tar", 257, b"ustar"), ("xar", 0, b"xar!"), ("zip", 0, b"PK\x03\x04"), ("zip", 0, b"PK\x05\x06"), ("zip", 0, b"PK\x03\x06"),
]
CONVERTERS = [
    ("elf", 0, b"\x7fELF"), ("ese", 4, b"\xef\xcd\xab\x89"), ("lnk", 0, b"L\x00\x00\x00"), ("mft", 0, b"FILE"), ("pe", 0, b"MZ"), ("pf", 4, b"SCCA"), ("pf", 0, b"MAM\x04"), ("pst", 0, b"!BDN"),
    ("evtx", 0, b"ElfFile\x00"), ("fortinet", 0, b"\xec\xce"), ("fortinet", 0, b"\xec\xcf"), ("fortinet", 0, b"\xec\xdf"), ("fortinet", 0, b"\xaa\x01"), ("journal", 0, b"LPKSHHRH"), ("reg", 0, b"regf"),
]


@dataclass(frozen=True)
class Limits:
    """What unpacking never exceeds: bytes per byte of input, layers of compression, levels of archives."""

    expansion: int = 100
    layers: int = 2
    levels: int = 4


def detect(content: Column, table: list[tuple[str, int, bytes]]) -> Column:
    """The name of the first entry whose bytes are there, null if none is."""
    out = F.lit(None).cast("string")
    for name, offset, magic in reversed(table):
        out = F.when(F.substring(content, offset + 1, len(magic)) == F.lit(magic), name).otherwise(out)
    return out


def kind_of(data: bytes, table: list[tuple[str, int, bytes]]) -> str | None:
    return next((name for name, offset, magic in table if data[offset : offset + len(magic)] == magic), None)


def _stream(opened, most: int) -> bytes:
    """At most ``most`` bytes; a stream that breaks off gives what came before."""
    out, size = [], 0
    try:
        while size < most and (part := opened.read(min(1 << 20, most - size))):
            out.append(part)
            size += len(part)
    except (EOFError, OSError, lzma.LZMAError, zlib.error):
        if not out:
            raise
    return b"".join(out)


def _lzip(data: bytes, most: int) -> bytes:
    """Members of a header with the dictionary size, raw LZMA and a trailer of 20 bytes."""
    out = b""
    while data[:4] == b"LZIP" and len(out) < most:
        size = 1 << (data[5] & 31)
        size -= (data[5] >> 5) * (size // 16)
        decoder = lzma.LZMADecompressor(lzma.FORMAT_RAW, filters=[{"id": lzma.FILTER_LZMA1, "dict_size": max(size, 4096), "lc": 3, "lp": 0, "pb": 2}])
        out += decoder.decompress(data[6:], most - len(out))
        if not decoder.eof:
            break
        data = decoder.unused_data[20:]
    return out


def _lzw(data: bytes, most: int) -> bytes:
    """Codes of growing width, low bits first, as the old Unix tool writes them."""
    top, blocks = data[2] & 31, data[2] & 128
    table = [bytes([k]) for k in range(256)] + ([b""] if blocks else [])
    out, width, bits, held, last, read = [], 9, 0, 0, b"", 0
    size, at, start = 0, 3, 3
    while size < most:
        while bits < width and at < len(data):
            held |= data[at] << bits
            bits, at = bits + 8, at + 1
        if bits < width:
            break
        code, held, bits, read = held & (1 << width) - 1, held >> width, bits - width, read + 1
        if code == 256 and blocks:
            # codes come in groups of eight; the rest of a group is skipped when the width is set back
            used = -(-read // 8) * width
            at, held, bits, read, start = start + used, 0, 0, 0, start + used
            table, width, last = table[:257], 9, b""
            continue
        if code > len(table) or code == len(table) and not last:
            raise ValueError("code out of range")
        entry = table[code] if code < len(table) else last + last[:1]
        out.append(entry)
        size += len(entry)
        if last and len(table) < 1 << top:
            table.append(last + entry[:1])
        last = entry
        if len(table) >= 1 << width and width < top:
            used = -(-read // 8) * width
            at, held, bits, read, start = start + used, 0, 0, 0, start + used
            width += 1
    return b"".join(out)[:most]


def _brotli(data: bytes, most: int) -> bytes:
    """A bare stream behind four bytes that mark it."""
    import pyarrow as pa

    return _stream(pa.CompressedInputStream(pa.BufferReader(data[4:]), "brotli"), most)


def _zstd(data: bytes, most: int) -> bytes:
    import zstandard

    return _stream(zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True), most)


def _zlib(data: bytes, most: int) -> bytes:
    return zlib.decompressobj().decompress(data, most)


#: How each compression is undone; names that are missing are detected only.
INFLATE: dict[str, Callable[[bytes, int], bytes]] = {
    "bgzf": lambda d, m: _stream(gzip.GzipFile(fileobj=io.BytesIO(d)), m), "gzip": lambda d, m: _stream(gzip.GzipFile(fileobj=io.BytesIO(d)), m),
    "bzip2": lambda d, m: _stream(bz2.BZ2File(io.BytesIO(d)), m), "xz": lambda d, m: _stream(lzma.LZMAFile(io.BytesIO(d)), m), "lzip": _lzip, "lzw": _lzw, "zlib": _zlib, "zstd": _zstd,
    "br": _brotli, "lz4": blocks.lz4, "lzo": blocks.lzo, "snappy": blocks.snappy, "s2": blocks.snappy,
}


def _members_zip(data: bytes, password: bytes | None, most: int) -> Iterator[tuple[str, bytes]]:
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        for entry in archive.infolist():
            if not entry.is_dir():
                try:
                    with archive.open(entry, pwd=password) as file:
                        yield entry.filename, _stream(file, most)
                except (RuntimeError, zipfile.BadZipFile, zlib.error, NotImplementedError, EOFError):
                    continue


def _members_tar(data: bytes, password: bytes | None, most: int) -> Iterator[tuple[str, bytes]]:
    with tarfile.open(fileobj=io.BytesIO(data), mode="r:") as archive:
        for entry in archive:
            if entry.isfile() and (file := archive.extractfile(entry)):
                yield entry.name, _stream(file, most)


def _members_ar(data: bytes, password: bytes | None, most: int) -> Iterator[tuple[str, bytes]]:
    """Headers of 60 bytes; long names stand in a member of their own or before the data."""
    at, names = 8, b""
    while at + 60 <= len(data):
        name, size = data[at : at + 16].rstrip(), int(data[at + 48 : at + 58])
        body = data[at + 60 : at + 60 + size]
        at += 60 + size + size % 2
        if name == b"//":
            names = body
        elif name.startswith(b"#1/"):
            long = int(name[3:])
            yield body[:long].rstrip(b"\0").decode("utf-8", "replace"), body[long : long + most]
        elif name not in (b"/", b"/SYM64/"):
            if name[:1] == b"/" and name[1:].isdigit():
                name = names[int(name[1:]) :].split(b"\n")[0]
            yield name.rstrip(b"/").decode("utf-8", "replace"), body[:most]


class Cut(ValueError):
    """Raised while members are listed, when the limit of expansion keeps further ones from being read."""


def _members_cpio(data: bytes, password: bytes | None, most: int, cut: bool = False) -> Iterator[tuple]:
    """Headers of 110 hexadecimal digits; regular files only. Where the data is ``cut``, the member that breaks off is marked."""
    at = 0
    while data[at : at + 6] in (b"070701", b"070702"):
        if cut and len(data) < at + 110:
            break
        field = [int(data[at + 6 + 8 * k : at + 14 + 8 * k], 16) for k in range(13)]
        mode, size, length = field[1], field[6], field[11]
        name = data[at + 110 : at + 110 + length - 1].decode("utf-8", "replace")
        body = at + -(-(110 + length) // 4) * 4
        at = body + -(-size // 4) * 4
        if name == "TRAILER!!!":
            return
        if cut and len(data) < body:
            break
        if mode & 0o170000 == 0o100000:
            yield name, data[body : body + min(size, most)], *([True] if cut and len(data) < body + size else [])
    if cut:
        raise Cut


def _members_rpm(data: bytes, password: bytes | None, most: int) -> Iterator[tuple[str, bytes]]:
    """Past the lead and two header sections lies a compressed cpio archive."""
    at = 96
    for section in range(2):
        if data[at : at + 3] != b"\x8e\xad\xe8":
            raise ValueError("header section missing")
        count, size = struct.unpack_from(">2I", data, at + 8)
        at += 16 + 16 * count + size
        at = -(-at // 8) * 8 if section == 0 else at
    payload = data[at:]
    kind, cut = kind_of(payload, DEFLATES), False
    if kind is None and payload[:6] not in (b"070701", b"070702"):
        decoder = lzma.LZMADecompressor(lzma.FORMAT_ALONE)
        payload = decoder.decompress(payload, most)
        cut = len(payload) >= most
        if not cut and not decoder.eof:
            raise EOFError("payload breaks off")
    elif kind:
        payload = INFLATE[kind](payload, most)
        cut = len(payload) >= most
    yield from _members_cpio(payload, None, most, cut)


def _members_iso(data: bytes, password: bytes | None, most: int) -> Iterator[tuple[str, bytes]]:
    """Directory records from the root of the primary volume."""
    root = struct.unpack_from("<I", data, 0x8000 + 158)[0], struct.unpack_from("<I", data, 0x8000 + 166)[0]
    todo, seen = [("", *root)], set()
    while todo:
        folder, block, size = todo.pop()
        if block in seen:
            continue
        seen.add(block)
        at, end = block * 2048, min(block * 2048 + size, len(data))
        while at < end:
            length = data[at]
            if not length:
                at = (at // 2048 + 1) * 2048
                continue
            start, count = struct.unpack_from("<I", data, at + 2)[0], struct.unpack_from("<I", data, at + 10)[0]
            name = data[at + 33 : at + 33 + data[at + 32]]
            if name not in (b"\0", b"\1"):
                path = folder + name.split(b";")[0].decode("utf-8", "replace")
                if data[at + 25] & 2:
                    todo.append((path + "/", start, count))
                else:
                    yield path, data[start * 2048 : start * 2048 + min(count, most)]
            at += length


def _members_xar(data: bytes, password: bytes | None, most: int) -> Iterator[tuple[str, bytes]]:
    """A compressed XML table of contents, then the heap."""
    from xml.etree import ElementTree

    header, packed = struct.unpack_from(">H", data, 4)[0], struct.unpack_from(">Q", data, 8)[0]
    heap = header + packed
    toc = ElementTree.fromstring(zlib.decompress(data[header:heap]))

    def walk(node, folder: str) -> Iterator[tuple[str, bytes]]:
        for file in node.findall("file"):
            path = folder + (file.findtext("name") or "")
            if file.findtext("type") == "directory":
                yield from walk(file, path + "/")
            elif (part := file.find("data")) is not None:
                at, size = int(part.findtext("offset") or 0), int(part.findtext("length") or 0)
                body = data[heap + at : heap + at + size]
                style = part.find("encoding").get("style", "") if part.find("encoding") is not None else ""
                yield path, (_zlib(body, most) if "gzip" in style else INFLATE["bzip2"](body, most) if "bzip2" in style else body[:most])

    yield from walk(toc.find("toc"), "")


#: How the members of each archive are listed, as (name, content) or, where the limit has cut one, (name, content, True); names that are missing are detected only.
MEMBERS: dict[str, Callable[[bytes, bytes | None, int], Iterator[tuple]]] = {
    "zip": _members_zip, "tar": _members_tar, "ar": _members_ar, "cpio": _members_cpio, "rpm": _members_rpm, "iso": _members_iso, "xar": _members_xar,
    "7z": blocks.seven_zip, "cab": blocks.cabinet, "msi": blocks.compound,
}


def inflate(data: bytes, limits: Limits = Limits()) -> bytes:
    """All layers of compression undone; raises where there are more than the limit allows."""
    for layer in range(limits.layers + 1):
        kind = kind_of(data, DEFLATES)
        if kind is None:
            return data
        try:
            out = INFLATE[kind](data, limits.expansion * len(data))
        except Exception:  # noqa: BLE001  what cannot be undone stays as it is
            return data
        if layer == limits.layers:
            raise ValueError("too many layers of compression")
        data = out
    return data


#: What is said of content that is not whole or not unpacked.
CUT, DEEP, NESTED, BROKEN = "cut at the limit of expansion", "too many layers of compression", "too many levels of archives", "broken archive"


def unpack(path: str, data: bytes, limits: Limits = Limits(), password: bytes | None = None, level: int = 0, error: str | None = None) -> Iterator[tuple[str, bytes, str | None]]:
    """(path, content, error) of what is in a file, ``!`` before each member's name; plain files give themselves.

    Members are given as they are read, so one at a time is held for each level. What a limit or a defect
    keeps from being unpacked is given as it is, with the reason.
    """
    try:
        content = inflate(data, limits)
    except ValueError:
        yield path, data, error or DEEP
        return
    if len(content) > len(data) and len(content) >= limits.expansion * len(data):
        error = error or CUT
    kind = kind_of(content, ARCHIVES)
    if kind is None or kind not in MEMBERS or level >= limits.levels:
        yield path, content, error or (NESTED if kind in MEMBERS else None)
        return
    most, count = limits.expansion * len(content), 0
    try:
        for member, body, *cut in MEMBERS[kind](content, password, most):
            count += 1
            yield from unpack(f"{path}!{member}", body, limits, password, level + 1, CUT if cut or len(body) >= most else None)
    except Cut:
        yield path, content, error or CUT
    except Exception:  # noqa: BLE001  a broken archive gives the members before the break, or itself
        if not count:
            yield path, content, error or BROKEN


def expand(path: str, data: bytes, limits: Limits = Limits(), password: bytes | None = None) -> Iterator[tuple[str, bytes]]:
    """(path, content) as :func:`unpack` gives them."""
    for name, content, _ in unpack(path, data, limits, password):
        yield name, content


#: Bytes and rows of a batch of unpacked content.
BATCH_BYTES, BATCH_ROWS = 1 << 20, 1_000


def expand_blobs(blobs: DataFrame, limits: Limits = Limits(), password: bytes | None = None) -> DataFrame:
    """(path, part, hint, size, content, error): every file or member of ``blobs`` (path, content)."""
    bound_batches(blobs.sparkSession)

    def run(batches) -> Iterator:
        import pyarrow as pa

        held: list[tuple] = []

        def out():
            columns = list(zip(*held, strict=True))
            held.clear()
            kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names=["path", "part", "hint", "size", "content", "error"])

        size = 0
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
                for name, data, error in unpack(path.as_py(), content.as_py() or b"", limits, password):
                    held.append((name, name.partition("!")[2], "", len(data), data, error))
                    size += len(data)
                    if size >= BATCH_BYTES or len(held) >= BATCH_ROWS:
                        yield out()
                        size = 0
        if held:
            yield out()

    return blobs.select("path", "content").mapInArrow(run, "path string, part string, hint string, size long, content binary, error string")
