"""Compressed block formats and container formats that the standard library does not read."""

from __future__ import annotations

import bz2
import lzma
import struct
import zlib
from collections.abc import Iterator


def _copy(out: bytearray, distance: int, length: int) -> None:
    """Repeat what lies ``distance`` back; it may overlap what it writes."""
    if not 0 < distance <= len(out):
        raise ValueError("distance out of range")
    start = len(out) - distance
    if distance >= length:
        out += out[start : start + length]
    else:
        piece = bytes(out[start:])
        out += (piece * (length // distance + 1))[:length]


def lz4_block(data: bytes, out: bytearray) -> None:
    at = 0
    while at < len(data):
        token = data[at]
        at += 1
        count = token >> 4
        if count == 15:
            while True:
                count, at = count + data[at], at + 1
                if data[at - 1] != 255:
                    break
        out += data[at : at + count]
        at += count
        if at >= len(data):
            return
        distance, at = data[at] | data[at + 1] << 8, at + 2
        length = token & 15
        if length == 15:
            while True:
                length, at = length + data[at], at + 1
                if data[at - 1] != 255:
                    break
        _copy(out, distance, length + 4)


def lz4(data: bytes, most: int) -> bytes:
    """A frame: a descriptor, then blocks, each packed or plain."""
    flags, at, out = data[4], 7, bytearray()
    at += 8 * bool(flags & 8) + 4 * bool(flags & 1)
    while at + 4 <= len(data) and len(out) < most:
        size = struct.unpack_from("<I", data, at)[0]
        at += 4
        if not size:
            break
        body = data[at : at + (size & 0x7FFFFFFF)]
        at += len(body) + 4 * bool(flags & 16)
        if size >> 31:
            out += body
        else:
            lz4_block(body, out)
    return bytes(out[:most])


def snappy_block(data: bytes) -> bytes:
    """One block; a distance of zero means the last distance again, as a later dialect has it."""
    at = shift = size = 0
    while True:
        size, at = size | (data[at] & 127) << shift, at + 1
        if data[at - 1] < 128:
            break
        shift += 7
    out, last = bytearray(), 0
    while at < len(data):
        tag = data[at]
        at += 1
        kind = tag & 3
        if kind == 0:
            count = tag >> 2
            if count >= 60:
                extra = count - 59
                count, at = int.from_bytes(data[at : at + extra], "little"), at + extra
            out += data[at : at + count + 1]
            at += count + 1
            continue
        if kind == 1:
            distance, length, at = tag >> 5 << 8 | data[at], tag >> 2 & 7, at + 1
            if distance == 0 and length >= 5:
                extra = length - 4
                length, at = int.from_bytes(data[at : at + extra], "little") + {5: 4, 6: 1 << 8, 7: 1 << 16}[length], at + extra
            length += 4
        else:
            extra = 2 if kind == 2 else 4
            distance, length, at = int.from_bytes(data[at : at + extra], "little"), (tag >> 2) + 1, at + extra
        last = distance or last
        _copy(out, last, length)
    if len(out) != size:
        raise ValueError("block of another size")
    return bytes(out)


def snappy(data: bytes, most: int) -> bytes:
    """Chunks of a type and a length; unknown ones that may be skipped are skipped."""
    at, out = 0, bytearray()
    while at + 4 <= len(data) and len(out) < most:
        kind, size = data[at], int.from_bytes(data[at + 1 : at + 4], "little")
        body = data[at + 4 : at + 4 + size]
        at += 4 + size
        if kind == 0:
            out += snappy_block(body[4:])
        elif kind == 1:
            out += body[4:]
        elif 2 <= kind < 128:
            raise ValueError("chunk that must be known")
    return bytes(out[:most])


def lzo_block(data: bytes) -> bytes:
    """Instructions of four kinds, each followed by up to three literals."""
    out, at, state = bytearray(), 0, 0

    def long(count: int, most: int) -> int:
        """A count that goes on in further bytes if it is zero."""
        nonlocal at
        if count:
            return count
        count = most
        while data[at] == 0:
            count, at = count + 255, at + 1
        at += 1
        return count + data[at - 1]

    if data[0] > 17:
        count, at = data[0] - 17, 1
        out += data[at : at + count]
        at, state = at + count, min(count, 4)
    while True:
        code = data[at]
        at += 1
        if code < 16 and state == 0:
            count = long(code, 15) + 3
            out += data[at : at + count]
            at, state = at + count, 4
            continue
        if code < 16:
            distance, length, tail = (data[at] << 2) + (code >> 2) + (1 if state < 4 else 2049), 2 if state < 4 else 3, code & 3
            at += 1
        elif code >= 64:
            distance, length, tail = (data[at] << 3) + (code >> 2 & 7) + 1, (code >> 5) + 1, code & 3
            at += 1
        else:
            length = long(code & 31, 31) + 2 if code >= 32 else long(code & 7, 7) + 2
            value, at = data[at] | data[at + 1] << 8, at + 2
            distance, tail = (value >> 2) + 1 if code >= 32 else 16384 + ((code & 8) << 11) + (value >> 2), value & 3
            if code < 32 and distance == 16384:
                return bytes(out)
        _copy(out, distance, length)
        out += data[at : at + tail]
        at, state = at + tail, tail


def lzo(data: bytes, most: int) -> bytes:
    """Blocks of sizes, a checksum and data, behind a header with the file's name."""
    at, out = 34 + data[33] + 4, bytearray()
    while at + 12 <= len(data) and len(out) < most:
        plain, packed = struct.unpack_from(">2I", data, at)
        if not plain:
            break
        body = data[at + 12 : at + 12 + packed]
        out += body if packed == plain else lzo_block(body)
        at += 12 + packed
    return bytes(out[:most])


def compound(data: bytes, password: bytes | None, most: int) -> Iterator[tuple[str, bytes]]:
    """The streams of a compound file, by chains of sectors."""
    size, mini = 1 << struct.unpack_from("<H", data, 30)[0], 1 << struct.unpack_from("<H", data, 32)[0]
    directory, cutoff, mini_table, extra = struct.unpack_from("<I", data, 48)[0], *struct.unpack_from("<2I", data, 56), struct.unpack_from("<I", data, 68)[0]
    sector = lambda k: data[(k + 1) * size : (k + 2) * size]
    tables = list(struct.unpack_from("<109I", data, 76))
    while extra < 0xFFFFFFFA and len(tables) < len(data) // 4:
        more = struct.unpack(f"<{size // 4}I", sector(extra))
        tables, extra = tables + list(more[:-1]), more[-1]
    following = [x for t in tables if t < 0xFFFFFFFA for x in struct.unpack(f"<{size // 4}I", sector(t).ljust(size, b"\xff"))]

    def chain(start: int, links) -> Iterator[int]:
        seen = 0
        while start < len(links) and seen <= len(links):
            yield start
            start, seen = links[start], seen + 1

    read = lambda start: b"".join(sector(k) for k in chain(start, following))
    entries = read(directory)
    short = struct.unpack(f"<{len(x) // 4}I", x) if (x := read(mini_table)) else ()
    pool = b""
    for at in range(0, len(entries) - 127, 128):
        length, kind = struct.unpack_from("<HB", entries, at + 64)
        start, count = struct.unpack_from("<II", entries, at + 116)
        name = entries[at : at + max(length - 2, 0)].decode("utf-16-le", "replace")
        if kind == 5:
            pool = read(start)
        elif kind == 2:
            body = b"".join(pool[k * mini : (k + 1) * mini] for k in chain(start, short)) if count < cutoff else read(start)
            yield name, body[: min(count, most)]


def cabinet(data: bytes, password: bytes | None, most: int) -> Iterator[tuple[str, bytes]]:
    """Files of folders, whose blocks are plain or deflated with the block before as dictionary."""
    files_at, folders, files, flags = struct.unpack_from("<I", data, 16)[0], *struct.unpack_from("<3H", data, 26)
    at, per_folder, per_block = 36, 0, 0
    if flags & 4:
        header, per_folder, per_block = struct.unpack_from("<HBB", data, 36)
        at = 40 + header
    for bit in (1, 2):
        for _ in range(2 if flags & bit else 0):
            at = data.index(b"\0", at) + 1
    unpacked = []
    for k in range(folders):
        start, blocks, kind = struct.unpack_from("<I2H", data, at + k * (8 + per_folder))
        out = bytearray()
        for _ in range(blocks):
            packed = struct.unpack_from("<H", data, start + 4)[0]
            body = data[start + 8 + per_block : start + 8 + per_block + packed]
            start += 8 + per_block + packed
            if kind & 15 == 0:
                out += body
            elif kind & 15 == 1:
                out += zlib.decompressobj(-15, bytes(out[-32768:])).decompress(body[2:])
            else:
                raise ValueError("unknown compression")
        unpacked.append(bytes(out))
    at = files_at
    for _ in range(files):
        size, offset, folder = struct.unpack_from("<2IH", data, at)
        end = data.index(b"\0", at + 16)
        if folder < len(unpacked):
            yield data[at + 16 : end].decode("utf-8", "replace"), unpacked[folder][offset : offset + min(size, most)]
        at = end + 1


class _SevenZip:
    """Reads the header of a 7z archive; see :func:`seven_zip`."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def byte(self) -> int:
        self.at += 1
        return self.data[self.at - 1]

    def number(self) -> int:
        """One to nine bytes: leading one bits of the first count the bytes that follow."""
        first, mask, value = self.byte(), 0x80, 0
        for k in range(8):
            if not first & mask:
                return value | (first & mask - 1) << 8 * k
            value |= self.byte() << 8 * k
            mask >>= 1
        return value

    def bits(self, count: int) -> list[bool]:
        if self.byte():
            return [True] * count
        raw = self.data[self.at : self.at + -(-count // 8)]
        self.at += len(raw)
        return [bool(raw[k // 8] & 0x80 >> k % 8) for k in range(count)]

    def streams(self) -> dict:
        """Positions and sizes of packed streams, the coders of folders, sizes of files within them."""
        out: dict = {"position": 0, "packed": [], "folders": [], "files": None}
        while (kind := self.byte()) != 0:
            if kind == 6:
                out["position"], count = self.number(), self.number()
                while (part := self.byte()) != 0:
                    if part == 9:
                        out["packed"] = [self.number() for _ in range(count)]
                    else:
                        self.digests(count)
            elif kind == 7:
                self.folders(out)
            elif kind == 8:
                self.substreams(out)
        return out

    def digests(self, count: int) -> None:
        self.at += 4 * sum(self.bits(count))

    def folders(self, out: dict) -> None:
        self.byte()
        count, _ = self.number(), self.byte()
        for _ in range(count):
            coders = []
            for _ in range(self.number()):
                flags = self.byte()
                method = self.data[self.at : self.at + (flags & 15)]
                self.at += flags & 15
                if flags & 16:
                    raise ValueError("coders with several streams")
                options = b""
                if flags & 32:
                    size = self.number()
                    options = self.data[self.at : self.at + size]
                    self.at += size
                coders.append((method, options))
            for _ in range(len(coders) - 1):
                self.number()
                self.number()
            out["folders"].append({"coders": coders, "sizes": []})
        while (part := self.byte()) != 0:
            if part == 12:
                for folder in out["folders"]:
                    folder["sizes"] = [self.number() for _ in folder["coders"]]
            else:
                self.digests(count)

    def substreams(self, out: dict) -> None:
        counts, part = [1] * len(out["folders"]), self.byte()
        if part == 13:
            counts, part = [self.number() for _ in counts], self.byte()
        out["files"] = []
        for count, folder in zip(counts, out["folders"], strict=True):
            sizes = [self.number() for _ in range(count - 1)] if part == 9 else []
            out["files"].append([*sizes, folder["sizes"][-1] - sum(sizes)] if count else [])
        part = self.byte() if part == 9 else part
        while part != 0:
            self.digests(sum(c for c, f in zip(counts, out["folders"], strict=True)))
            part = self.byte()


def _uncode(coder: tuple[bytes, bytes], data: bytes, size: int) -> bytes:
    method, options = coder
    if method == b"\0":
        return data[:size]
    if method in (b"\x03\x01\x01", b"\x21"):
        if method == b"\x21":
            bits = options[0]
            chosen = {"id": lzma.FILTER_LZMA2, "dict_size": (2 | bits & 1) << bits // 2 + 11 if bits < 40 else 0xFFFFFFFF}
        else:
            first = options[0]
            chosen = {"id": lzma.FILTER_LZMA1, "dict_size": struct.unpack_from("<I", options, 1)[0], "lc": first % 9, "lp": first // 9 % 5, "pb": first // 45}
        return lzma.LZMADecompressor(lzma.FORMAT_RAW, filters=[chosen]).decompress(data, size)
    if method == b"\x04\x01\x08":
        return zlib.decompressobj(-15).decompress(data, size)
    if method == b"\x04\x02\x02":
        return bz2.decompress(data)[:size]
    raise ValueError("unknown method")


def _unfold(data: bytes, streams: dict) -> list[bytes]:
    at, out = 32 + streams["position"], []
    for folder, packed in zip(streams["folders"], streams["packed"], strict=False):
        body = data[at : at + packed]
        at += packed
        for coder, size in reversed(list(zip(folder["coders"], folder["sizes"], strict=True))) if len(folder["coders"]) > 1 else zip(folder["coders"], folder["sizes"], strict=True):
            body = _uncode(coder, body, size)
        out.append(body)
    return out


def seven_zip(data: bytes, password: bytes | None, most: int) -> Iterator[tuple[str, bytes]]:
    """Files of folders of streams; the header itself may be packed. Encrypted archives are not read."""
    start, size = struct.unpack_from("<2Q", data, 12)
    header = data[32 + start : 32 + start + size]
    while header[:1] == b"\x17":
        reader = _SevenZip(header)
        reader.at = 1
        header = _unfold(data, reader.streams())[0]
    reader = _SevenZip(header)
    if not header or reader.byte() != 1:
        return
    streams = {"folders": [], "files": [], "packed": [], "position": 0}
    names, empty = [], []
    while (kind := reader.byte()) != 0:
        if kind == 4:
            streams = reader.streams()
        elif kind == 5:
            count = reader.number()
            while (part := reader.byte()) != 0:
                length = reader.number()
                end = reader.at + length
                if part == 17:
                    names = header[reader.at + 1 : end].decode("utf-16-le", "replace").split("\0")[:count]
                elif part == 14:
                    raw = header[reader.at : end]
                    empty = [bool(raw[k // 8] & 0x80 >> k % 8) for k in range(count)]
                reader.at = end
        else:
            raise ValueError("unknown property")
    sizes = streams["files"] if streams["files"] is not None else [[f["sizes"][-1]] for f in streams["folders"]]
    bodies = []
    for body, each in zip(_unfold(data, streams), sizes, strict=True):
        at = 0
        for n in each:
            bodies.append(body[at : at + n])
            at += n
    empty = empty or [False] * len(names)
    for name, none in zip(names, empty, strict=False):
        if not none and bodies:
            yield name, bodies.pop(0)[:most]


def xpress_huffman(data: bytes, size: int) -> bytes:
    """``size`` bytes from chunks of 64 KB, each with the lengths of its 512 codes: literals, then copies by length and distance."""
    out, at = bytearray(), 0

    def word(place: int) -> int:
        return int.from_bytes(data[place : place + 2], "little")

    while len(out) < size:
        lengths = [x for byte in data[at : at + 256] for x in (byte & 15, byte >> 4)]
        if len(lengths) < 512:
            raise ValueError("table of codes missing")
        symbols = [0] * (1 << 15)
        filled = 0
        for length, symbol in sorted((x, k) for k, x in enumerate(lengths) if x):
            step = 1 << 15 - length
            symbols[filled : filled + step] = [symbol] * step
            filled += step
        held, spare, at = word(at + 256) << 16 | word(at + 258), 16, at + 260
        end = min(size, len(out) + 65536)

        def drop(count: int) -> None:
            nonlocal held, spare, at
            held, spare = held << count & 0xFFFFFFFF, spare - count
            if spare < 0:
                held |= word(at) << -spare
                spare, at = spare + 16, at + 2

        while len(out) < end:
            if at > len(data) + 4:
                raise ValueError("data end early")
            symbol = symbols[held >> 17]
            drop(lengths[symbol] or 15)
            if symbol < 256:
                out.append(symbol)
                continue
            length, bits = symbol & 15, symbol - 256 >> 4
            if length == 15:
                length, at = data[at], at + 1
                if length == 255:
                    length, at = word(at) - 15, at + 2
                length += 15
            distance = (held >> 32 - bits) + (1 << bits) if bits else 1
            drop(bits)
            if not 0 < distance <= len(out):
                raise ValueError("distance out of range")
            for _ in range(length + 3):
                out.append(out[-distance])
    return bytes(out[:size])
