"""Parsers of binary formats: shortcuts, file tables, executables, event logs and journals.

Each is a plain function from bytes to dicts, tested alone; :func:`parse` runs them over blobs in
one Arrow pass. They follow the public descriptions of the formats.
"""

from __future__ import annotations

import json
import math
import struct
from collections.abc import Callable, Iterator
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame

from ..shipping import bound_batches
from .codecs import BATCH_BYTES, BATCH_ROWS, CONVERTERS, kind_of

TIMES = ("m_time", "a_time", "c_time", "b_time")

#: 100-nanosecond steps from 1601 to 1970.
EPOCH = 116_444_736_000_000_000


def filetime(value: int) -> str | None:
    """RFC 3339 with up to seven decimals, None for zero."""
    if value <= 0:
        return None
    ticks = value - EPOCH
    whole, rest = divmod(ticks, 10_000_000)
    try:
        time = datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(seconds=whole)
    except OverflowError:
        return None
    return time.strftime("%Y-%m-%dT%H:%M:%S") + (f".{rest:07d}".rstrip("0") if rest else "") + "Z"


#: Seconds from 1970 to the end of the year 9999.
LAST = 253_402_300_800


def micros(value: int) -> int | None:
    """The same instant in microseconds from 1970, further decimals cut off."""
    ticks = value - EPOCH
    return ticks // 10 if value > 0 and ticks < 10_000_000 * LAST else None


def _text16(data: bytes) -> str:
    return data.decode("utf-16-le", "replace")


def _link(data: bytes) -> tuple:
    """Of a shell link: name, size, mode, times of change, use, none, birth, and strings by name."""
    flags, attributes = struct.unpack_from("<2I", data, 20)
    born, used, changed = struct.unpack_from("<3Q", data, 28)
    size = struct.unpack_from("<I", data, 52)[0]
    at, base, suffix = 76, "", ""
    if flags & 1:
        at += 2 + struct.unpack_from("<H", data, at)[0]
    if flags & 2:
        total, header, kinds, _, base_at = struct.unpack_from("<5I", data, at)
        suffix_at = struct.unpack_from("<I", data, at + 24)[0]
        if kinds & 1:
            base = data[at + base_at :].split(b"\0")[0].decode("latin-1")
        suffix = data[at + suffix_at :].split(b"\0")[0].decode("latin-1")
        if header >= 36:
            wide_base, wide_suffix = struct.unpack_from("<2I", data, at + 28)
            base = _wide(data, at + wide_base) if wide_base else base
            suffix = _wide(data, at + wide_suffix) if wide_suffix else suffix
        at += total
    more = {}
    for bit, name in ((4, "description"), (8, "relative_path"), (16, "working_dir"), (32, "arguments"), (64, "icon")):
        if flags & bit and at + 2 <= len(data):
            count = struct.unpack_from("<H", data, at)[0]
            step = 2 if flags & 128 else 1
            raw = data[at + 2 : at + 2 + count * step]
            more[name] = _text16(raw) if step == 2 else raw.decode("latin-1")
            at += 2 + count * step
    mode = ("d" if attributes & 16 else "-") + ("r-xr-xr-x" if attributes & 1 else "rwxrwxrwx")
    return base + suffix, size, mode, (changed, used, 0, born), more


def shortcut(data: bytes) -> dict:
    """A shell link: times, size, mode and target."""
    name, size, mode, times, more = _link(data)
    return {"name": name, "size": size, "mode": mode, **dict(zip(TIMES, map(filetime, times), strict=True)), **more}


def _wide(data: bytes, at: int) -> str:
    end = at
    while data[end : end + 2] not in (b"\0\0", b"", b"\0"):
        end += 2
    return _text16(data[at:end])


def _file_records(data: bytes, size: int = 1024) -> Iterator[tuple]:
    """Of each record of a master file table: name, number, size, mode, times of change, use, change of the record, birth, and whether they look set."""
    for start in range(0, len(data) - size + 1, size):
        record = bytearray(data[start : start + size])
        if record[:4] != b"FILE":
            continue
        fix_at, fix_count = struct.unpack_from("<2H", record, 4)
        for k in range(1, fix_count):
            # the last two bytes of each sector are kept aside
            end = 512 * k
            if end <= size and fix_at + 2 * k + 2 <= size:
                record[end - 2 : end] = record[fix_at + 2 * k : fix_at + 2 * k + 2]
        sequence, _, at, flags = struct.unpack_from("<4H", record, 16)
        number = struct.unpack_from("<I", record, 44)[0]
        shown = kept = None
        name, length, attributes, rank = "", 0, 0, -1
        while at + 24 <= size:
            kind, total = struct.unpack_from("<2I", record, at)
            if kind == 0xFFFFFFFF or not 24 <= total <= size - at:
                break
            resident = not record[at + 8]
            body = at + struct.unpack_from("<H", record, at + 20)[0]
            if kind == 0x10 and resident:
                shown, attributes = struct.unpack_from("<4Q", record, body), struct.unpack_from("<I", record, body + 32)[0]
            elif kind == 0x30 and resident:
                # a long name is preferred to a short one
                space = record[body + 65]
                if {2: 0, 0: 1}.get(space, 2) > rank:
                    rank = {2: 0, 0: 1}.get(space, 2)
                    name = _text16(bytes(record[body + 66 : body + 66 + 2 * record[body + 64]]))
                    kept = struct.unpack_from("<4Q", record, body + 8)
            elif kind == 0x80 and not record[at + 9]:
                length = struct.unpack_from("<I", record, at + 16)[0] if resident else struct.unpack_from("<Q", record, at + 48)[0]
            at += total
        if not shown:
            continue
        odd = False
        for told, held in zip(shown, kept or (), strict=False):
            odd = odd or told % 10_000_000 == 0 and told // 10_000_000 <= held // 10_000_000
        mode = ("d" if flags & 2 else "l" if attributes & 0x400 else "-") + ("r-xr-xr-x" if attributes & 1 else "rwxrwxrwx")
        born, changed, record_changed, used = shown
        yield name, f"{number}-{sequence}", length, mode, (changed, used, record_changed, born), odd


def file_table(data: bytes, size: int = 1024) -> Iterator[dict]:
    """Records of a master file table: name, number, size and the times of both attributes that have them."""
    for name, inode, length, mode, times, odd in _file_records(data, size):
        yield {"name": name, "inode": inode, "size": length, "mode": mode, **dict(zip(TIMES, map(filetime, times), strict=True)), "anomaly": odd}


def _runs(data: bytes) -> tuple:
    """Of a prefetch file: name, size, count, times and files. Packed files are unpacked first."""
    if data[:4] == b"MAM\x04":
        from .blocks import xpress_huffman

        data = xpress_huffman(data[8:], struct.unpack_from("<I", data, 4)[0])
    if data[4:8] != b"SCCA":
        raise ValueError("no prefetch file")
    version = struct.unpack_from("<I", data, 0)[0]
    name = _wide(data, 16)
    _, _, _, _, names_at, names_size = struct.unpack_from("<6I", data, 84)
    times_at, times, count_at = {17: (120, 1, 144), 23: (128, 1, 152)}.get(version, (128, 8, 208))
    runs = [t for t in struct.unpack_from(f"<{times}Q", data, times_at) if t]
    count = struct.unpack_from("<I", data, count_at)[0]
    files = [x for x in _text16(data[names_at : names_at + names_size]).split("\0") if x]
    return name, struct.unpack_from("<I", data, 12)[0], count, runs, files


def prefetch(data: bytes) -> dict:
    """A program's runs: name, count, times and the files it used."""
    name, size, count, runs, files = _runs(data)
    return {"name": name, "size": size, "run_count": count, "run_times": [filetime(t) for t in runs], "files": files}


def _entropy(data: bytes) -> float:
    counts = [0] * 256
    for byte in data:
        counts[byte] += 1
    return -sum(c / len(data) * math.log2(c / len(data)) for c in counts if c) if data else 0.0


def elf(data: bytes) -> dict:
    """Header and sections of an ELF file."""
    wide, order = data[4] == 2, "<" if data[5] == 1 else ">"
    kind, machine = struct.unpack_from(order + "2H", data, 16)
    start, _, table = struct.unpack_from(order + ("3Q" if wide else "3I"), data, 24)
    entry, count, names = struct.unpack_from(order + "3H", data, 58 if wide else 46)
    sections = []
    for k in range(count):
        at = table + k * entry
        name, form = struct.unpack_from(order + "2I", data, at)
        flags, address, offset, size = struct.unpack_from(order + ("4Q" if wide else "4I"), data, at + 8)
        sections.append({"name": name, "type": form, "flags": flags, "address": address, "offset": offset, "size": size})
    if names < len(sections):
        base = sections[names]["offset"]
        for section in sections:
            section["name"] = data[base + section["name"] :].split(b"\0")[0].decode("latin-1")
    return {"class": 64 if wide else 32, "order": "little" if order == "<" else "big", "type": kind, "machine": machine, "entry": start, "sections": sections}


def executable(data: bytes) -> dict:
    """Header, sections with entropy, and imports of a portable executable."""
    at = struct.unpack_from("<I", data, 60)[0]
    if data[at : at + 4] != b"PE\0\0":
        return {"machine": "dos"}
    machine, count, stamp, _, _, optional, flags = struct.unpack_from("<2H3I2H", data, at + 4)
    wide = struct.unpack_from("<H", data, at + 24)[0] == 0x20B
    entry = struct.unpack_from("<I", data, at + 40)[0]
    sections = []
    for k in range(count):
        here = at + 24 + optional + 40 * k
        size, address, raw, offset = struct.unpack_from("<4I", data, here + 8)
        body = data[offset : offset + raw]
        sections.append({"name": data[here : here + 8].rstrip(b"\0").decode("latin-1"), "virtual_size": size, "virtual_address": address, "size": raw, "offset": offset, "entropy": math.floor(_entropy(body) * 1e6) / 1e6})

    def place(address: int) -> int | None:
        return next((address - s["virtual_address"] + s["offset"] for s in sections if s["virtual_address"] <= address < s["virtual_address"] + max(s["virtual_size"], s["size"])), None)

    imports: dict[str, list[str]] = {}
    listed = at + 24 + (112 if wide else 96) + 8
    if optional >= (120 if wide else 104) and (here := place(struct.unpack_from("<I", data, listed)[0])):
        while here + 20 <= len(data) and any(data[here : here + 20]):
            names, _, _, library, thunks = struct.unpack_from("<5I", data, here)
            title, walk = place(library), place(names or thunks)
            step, top = (8, 1 << 63) if wide else (4, 1 << 31)
            found = []
            while walk and walk + step <= len(data) and (value := int.from_bytes(data[walk : walk + step], "little")):
                spot = place(value) if not value & top else None
                found.append(f"ord{value & 0xFFFF}" if value & top else data[spot + 2 :].split(b"\0")[0].decode("latin-1") if spot else "")
                walk += step
            imports[data[title:].split(b"\0")[0].decode("latin-1") if title else ""] = found
            here += 20
    return {"machine": machine, "time": stamp, "characteristics": flags, "bits": 64 if wide else 32, "entry": entry, "sections": sections, "imports": imports}


def journal(data: bytes) -> Iterator[dict]:
    """Entries of a journal: times and fields, by way of its arrays of entry offsets."""
    # objects follow the header one after another, each at a multiple of eight
    compact, at, tail = struct.unpack_from("<I", data, 12)[0] & 16, struct.unpack_from("<Q", data, 88)[0], len(data)
    while at + 16 <= tail:
        kind, size = data[at], struct.unpack_from("<Q", data, at + 8)[0]
        if size < 16 or at + size > tail:
            return
        if kind == 3:
            real, monotonic = struct.unpack_from("<2Q", data, at + 24)
            step, form = (4, "<I") if compact else (16, "<Q")
            fields = {}
            for item in range(at + 64, at + size - step + 1, step):
                target = struct.unpack_from(form, data, item)[0]
                field = _journal_field(data, target, bool(compact))
                if field:
                    name, _, value = field.partition(b"=")
                    fields[name.decode("utf-8", "replace")] = value.decode("utf-8", "replace")
            yield {"realtime": real, "monotonic": monotonic, "sequence": struct.unpack_from("<Q", data, at + 16)[0], "fields": fields}
        at += -(-size // 8) * 8


def _journal_field(data: bytes, at: int, compact: bool) -> bytes | None:
    """The payload of a data object, unpacked if its flags say so."""
    if not at or at + 64 > len(data) or data[at] != 1:
        return None
    flags, size = data[at + 1], struct.unpack_from("<Q", data, at + 8)[0]
    body = data[at + (72 if compact else 64) : at + size]
    if flags & 1:
        import lzma

        return lzma.decompress(body)
    if flags & 4:
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj().decompress(body)
    if flags & 2:
        from .blocks import lz4_block

        # the unpacked size, then one bare block
        out = bytearray()
        lz4_block(body[8:], out)
        if len(out) != struct.unpack_from("<Q", body)[0]:
            raise ValueError("broken LZ4 field")
        return bytes(out)
    return body


#: What turns each format into rows; formats that are missing are detected only.
PARSERS: dict[str, Callable[[bytes], Iterator[dict]]] = {
    "lnk": lambda d: iter([shortcut(d)]), "mft": file_table, "pf": lambda d: iter([prefetch(d)]), "elf": lambda d: iter([elf(d)]), "pe": lambda d: iter([executable(d)]), "journal": journal,
}


def _event_log(data: bytes) -> Iterator[dict]:
    from .evtx import chunks, records

    for chunk in chunks(data):
        for number, written, fields in records(chunk):
            yield {"record": number, "time": filetime(written), "fields": fields}


PARSERS["evtx"] = _event_log


def rows_of(data: bytes) -> Iterator[tuple[str, dict]]:
    """(format, row) of a file of a known format; what is broken ends the rows."""
    kind = kind_of(data, CONVERTERS)
    if kind in PARSERS:
        try:
            for row in PARSERS[kind](data):
                yield kind, row
        except (struct.error, IndexError, ValueError, EOFError):
            return


def timeline_entries(data: bytes) -> Iterator[tuple]:
    """(name, inode, size, mode, times of change, use, change of the record, birth in microseconds, whether they look set) of a file of a known format."""
    kind = kind_of(data, CONVERTERS)
    try:
        if kind == "mft":
            for name, inode, size, mode, times, odd in _file_records(data):
                # sizes beyond 63 bits are none
                yield name, inode, size if size < 1 << 63 else 0, mode, *map(micros, times), odd
        elif kind == "lnk":
            name, size, mode, times, _ = _link(data)
            yield name, "", size, mode, *map(micros, times), False
        elif kind == "pf":
            program, size, count, runs, files = _runs(data)
            for run in map(micros, runs):
                yield program, "", size, None, None, run, None, None, count == 0
                for name in files:
                    yield name, "", 0, None, None, run, None, None, False
    except (struct.error, IndexError, ValueError, EOFError):
        return


def parse_timeline(blobs: DataFrame) -> DataFrame:
    """(path, nth and what :func:`timeline_entries` gives) of blobs (path, content), numbered in the order of the file."""
    bound_batches(blobs.sparkSession)

    def run(batches) -> Iterator:
        import pyarrow as pa

        names = ["path", "nth", "name", "inode", "size", "mode", *TIMES, "anomaly"]
        kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), *[pa.int64()] * 4, pa.bool_()]
        held: list[tuple] = []
        size = 0

        def out():
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                for k, entry in enumerate(timeline_entries(content or b"")):
                    held.append((path, k, *entry))
                    size += len(path or "") + len(entry[0])
                    if len(held) >= BATCH_ROWS or size >= BATCH_BYTES:
                        yield out()
                        held, size = [], 0
        if held:
            yield out()

    schema = "path string, nth long, name string, inode string, size long, mode string, m_time long, a_time long, c_time long, b_time long, anomaly boolean"
    return blobs.select("path", "content").mapInArrow(run, schema)


def parse(blobs: DataFrame) -> DataFrame:
    """(path, nth, kind, row): each record as JSON, numbered in the order of the file."""
    bound_batches(blobs.sparkSession)

    def run(batches) -> Iterator:
        import pandas as pd

        names, held, size = ["path", "nth", "kind", "row"], [], 0
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                for k, (kind, row) in enumerate(rows_of(bytes(content or b""))):
                    held.append((path, k, kind, json.dumps(row, ensure_ascii=False)))
                    size += len(held[-1][3])
                    if len(held) >= BATCH_ROWS or size >= BATCH_BYTES:
                        yield pd.DataFrame(held, columns=names)
                        held, size = [], 0
        if held:
            yield pd.DataFrame(held, columns=names)

    return blobs.select("path", "content").mapInPandas(run, "path string, nth long, kind string, row string")


# What starts a chunk of events or a journal at any place in a file.
CARVED = {"evtx": b"ElfChnk\x00", "journal": b"LPKSHHRH"}


def carve_offsets(blobs: DataFrame) -> DataFrame:
    """(path, kind, offset) of everything that looks like a chunk of events or a journal."""
    bound_batches(blobs.sparkSession)

    def run(batches) -> Iterator:
        import pandas as pd

        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                data = bytes(content or b"")
                for kind, magic in CARVED.items():
                    at = data.find(magic)
                    while at >= 0:
                        rows.append((path, kind, at))
                        at = data.find(magic, at + len(magic))
            yield pd.DataFrame(rows, columns=["path", "kind", "offset"])

    return blobs.select("path", "content").mapInPandas(run, "path string, kind string, offset long")
