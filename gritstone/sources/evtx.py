"""Binary event logs: chunks, records and their binary XML, as events of the engine's schema.

Follows the public description of the format. A chunk is self-contained, so chunks found at any
offset, in a disk image as well, are read the same way.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import events as E
from ..schemas import EVENTS
from .binary import CARVED, EPOCH, filetime, journal

CHUNK = 65_536


class Fragment:
    """Reads binary XML of one chunk into nested dicts; repeated children become lists."""

    def __init__(self, chunk: bytes):
        self.chunk = chunk
        self.templates: dict[int, list] = {}

    def name(self, at: int) -> tuple[str, int]:
        """A name and where its stored form ends."""
        count = struct.unpack_from("<H", self.chunk, at + 6)[0]
        return self.chunk[at + 8 : at + 8 + 2 * count].decode("utf-16-le", "replace"), at + 10 + 2 * count

    def named(self, at: int) -> tuple[str, int]:
        """A name by its offset; one that is stored right here is stepped over."""
        offset = struct.unpack_from("<I", self.chunk, at)[0]
        text, end = self.name(offset)
        return text, end if offset == at + 4 else at + 4

    def tokens(self, at: int, stop: int) -> tuple[list, int]:
        """The tokens from ``at`` to the end mark: what a template is made of."""
        out, chunk = [], self.chunk
        while at < stop:
            token = chunk[at] & 0x0F if chunk[at] & 0xF0 in (0, 0x40) else -1
            more = chunk[at] & 0x40
            at += 1
            if token == 0:
                break
            if token == 15:
                at += 3
            elif token == 1:
                # dependency and size come before the name, the size of the attributes after it
                text, at = self.named(at + 6)
                at += 4 if more else 0
                out.append(("open", text))
            elif token in (2, 3, 4):
                out.append(({2: "body", 3: "empty", 4: "close"}[token], None))
            elif token == 5:
                count = struct.unpack_from("<H", chunk, at + 1)[0]
                out.append(("text", chunk[at + 3 : at + 3 + 2 * count].decode("utf-16-le", "replace")))
                at += 3 + 2 * count
            elif token == 6:
                text, at = self.named(at)
                out.append(("attribute", text))
            elif token == 7:
                count = struct.unpack_from("<H", chunk, at)[0]
                out.append(("text", chunk[at + 2 : at + 2 + 2 * count].decode("utf-16-le", "replace")))
                at += 2 + 2 * count
            elif token == 8:
                out.append(("text", chr(struct.unpack_from("<H", chunk, at)[0])))
                at += 2
            elif token == 9:
                text, at = self.named(at)
                out.append(("text", {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}.get(text, "")))
            elif token == 10:
                _, at = self.named(at)
            elif token == 11:
                at += 2 + 2 * struct.unpack_from("<H", chunk, at)[0]
            elif token == 12:
                found, at = self.instance(at)
                out += found
            elif token in (13, 14):
                out.append(("slot", struct.unpack_from("<H", chunk, at)[0]))
                at += 3
            else:
                raise ValueError(f"unknown token {chunk[at - 1]:#x}")
        return out, at

    def instance(self, at: int) -> tuple[list, int]:
        """A template with its slots filled, as tokens."""
        offset = struct.unpack_from("<I", self.chunk, at + 5)[0]
        size = struct.unpack_from("<I", self.chunk, offset + 20)[0]
        if offset not in self.templates:
            self.templates[offset] = self.tokens(offset + 24, offset + 24 + size)[0]
        at = offset + 24 + size if offset == at + 9 else at + 9
        count = struct.unpack_from("<I", self.chunk, at)[0]
        kinds = [struct.unpack_from("<HB", self.chunk, at + 4 + 4 * k) for k in range(count)]
        at += 4 + 4 * count
        values = []
        for length, kind in kinds:
            values.append(self.value(at, length, kind))
            at += length
        out = []
        for token, data in self.templates[offset]:
            if token == "slot":
                value = values[data] if data < len(values) else None
                out += value if isinstance(value, list) else [("text", value)] if value is not None else []
            else:
                out.append((token, data))
        return out, at

    def value(self, at: int, length: int, kind: int):
        """A slot's value as text, or as tokens where it is binary XML itself; None for none."""
        data = self.chunk[at : at + length]
        if kind == 0 or not length and kind not in (1, 2):
            return None
        if kind & 0x80:
            base = kind & 0x7F
            if base in (1, 2):
                return " ".join(x for x in (data.decode("utf-16-le", "replace") if base == 1 else data.decode("latin-1")).split("\0") if x)
            step = {3: 1, 4: 1, 5: 2, 6: 2, 7: 4, 8: 4, 9: 8, 10: 8, 11: 4, 12: 8, 13: 4, 15: 16, 17: 8, 18: 16, 20: 4, 21: 8}.get(base, length)
            return " ".join(str(self.value(at + k, step, base)) for k in range(0, length - step + 1, step))
        plain = {3: "<b", 4: "<B", 5: "<h", 6: "<H", 7: "<i", 8: "<I", 9: "<q", 10: "<Q", 11: "<f", 12: "<d"}.get(kind)
        if plain:
            return str(struct.unpack_from(plain, data)[0])
        if kind == 1:
            return data.decode("utf-16-le", "replace").rstrip("\0")
        if kind == 2:
            return data.decode("latin-1").rstrip("\0")
        if kind == 13:
            return "true" if struct.unpack_from("<I", data.ljust(4, b"\0"))[0] else "false"
        if kind == 15:
            return "{" + str(uuid.UUID(bytes_le=data)).upper() + "}"
        if kind in (16, 20, 21):
            return f"{int.from_bytes(data, 'little'):#x}"
        if kind == 17:
            return filetime(struct.unpack("<Q", data)[0]) or ""
        if kind == 18:
            year, month, _, day, hour, minute, second, milli = struct.unpack("<8H", data)
            return f"{year:04}-{month:02}-{day:02}T{hour:02}:{minute:02}:{second:02}.{milli:03}Z"
        if kind == 19:
            authority = int.from_bytes(data[2:8], "big")
            return "-".join(["S", str(data[0]), str(authority), *[str(x[0]) for x in struct.iter_unpack("<I", data[8 : 8 + 4 * data[1]])]])
        if kind == 33:
            return self.tokens(at, at + length)[0]
        return data.hex().upper()


def tree(tokens: list) -> dict:
    """Nested dicts of tokens: attributes and children by name, text under ``Value``."""
    root: dict = {}
    stack: list[tuple[str, dict]] = [("", root)]
    attribute = None
    for token, data in tokens:
        node = stack[-1][1]
        if token == "open":
            attribute = None
            stack.append((data, {}))
        elif token == "attribute":
            attribute = data
        elif token == "text":
            key = attribute or "Value"
            node[key] = node.get(key, "") + data if isinstance(node.get(key, ""), str) else data
        elif token == "body":
            attribute = None
        else:
            attribute = None
            if len(stack) > 1:
                name, done = stack.pop()
                parent = stack[-1][1]
                if name in parent:
                    parent[name] = [*(parent[name] if isinstance(parent[name], list) else [parent[name]]), done]
                else:
                    parent[name] = done
    return root


# Names that add nothing to a field's name, and only children that stand for their parent.
PLAIN_PARENTS = {"Event", "System", "Security", "Execution", "EventData", "UserData"}
ONLY_CHILDREN = {"Guid", "Value", "SystemTime"}


def flatten(node: dict) -> dict[str, str]:
    """Fields by joined names; named data by its name, other data as param1, param2 …"""
    out: dict[str, str] = {}

    def walk(name: str, value) -> None:
        if isinstance(value, str):
            out[name or "Value"] = value
            return
        for k, child in enumerate(value if isinstance(value, list) else [value], 1):
            if isinstance(child, dict) and name == "Data":
                out[child.get("Name") or f"param{k}"] = child.get("Value", "")
                continue
            for key, inner in child.items():
                if key == "xmlns":
                    continue
                prefix = "" if name in PLAIN_PARENTS else name
                if len(child) == 1 and key in ONLY_CHILDREN and prefix:
                    walk(prefix, inner)
                elif key == "Data" or key in PLAIN_PARENTS:
                    walk(key, inner)
                else:
                    walk(prefix + key, inner)

    for name, value in node.items():
        walk(name, value)
    if "EventIDValue" in out:
        out["EventID"] = out["EventIDValue"]
    return out


def records(chunk: bytes) -> Iterator[tuple[int, int, dict[str, str]]]:
    """(record number, file time, fields) of a chunk; a broken record is passed over."""
    reader = Fragment(chunk)
    at = 512
    while at + 28 <= len(chunk) and chunk[at : at + 4] == b"\x2a\x2a\0\0":
        size, number, written = struct.unpack_from("<IQQ", chunk, at + 4)
        if not 28 <= size <= len(chunk) - at:
            return
        try:
            yield number, written, flatten(tree(reader.tokens(at + 24, at + size - 4)[0]))
        except (struct.error, ValueError, IndexError, RecursionError):
            pass
        at += size


def chunks(data: bytes) -> Iterator[bytes]:
    """Every chunk of the data, wherever it starts."""
    at = data.find(CARVED["evtx"])
    while at >= 0:
        yield data[at : at + CHUNK]
        at = data.find(CARVED["evtx"], at + len(CARVED["evtx"]))


# The fields that may hold an entry's time, in the order in which they are asked.
TIME_FIELDS = ("_SOURCE_REALTIME_TIMESTAMP", "SYSLOG_TIMESTAMP", "Timestamp")


def journal_ns(fields: dict[str, str], written: int) -> int:
    """The time of a journal entry: the first field that is a time, in microseconds or written out, else when it was written."""
    from datetime import datetime, timezone

    for name in TIME_FIELDS:
        value = fields.get(name, "").strip()
        if value.isdigit():
            return int(value) * 1000
        for read in (datetime.fromisoformat, lambda x: datetime.strptime(f"{datetime.fromtimestamp(written / 1e6, timezone.utc).year} {x}", "%Y %b %d %H:%M:%S")):
            try:
                time = read(value)
            except ValueError:
                continue
            time = time if time.tzinfo else time.replace(tzinfo=timezone.utc)
            return int(time.timestamp()) * 1_000_000_000 + time.microsecond * 1000
    return int(written) * 1000


def raw_events(data: bytes) -> Iterator[tuple[str, int, str, dict[str, str]]]:
    """(source, nanoseconds, sequence, fields) of all event logs and journals in the data."""
    for chunk in chunks(data):
        for number, written, fields in records(chunk):
            yield "eventlog", (written - EPOCH) * 100, str(number), fields
    at = data.find(CARVED["journal"])
    while at >= 0:
        try:
            for row in journal(data[at:]):
                fields = row["fields"]
                yield "journal", journal_ns(fields, row["realtime"]), str(row["sequence"]), fields
        except (struct.error, IndexError, ValueError):
            pass
        at = data.find(CARVED["journal"], at + len(CARVED["journal"]))


def carve_events(blobs: DataFrame, templates: DataFrame | None = None) -> DataFrame:
    """Events of the engine's schema from blobs (path, content): carved in Python, normalised by Columns.

    ``templates`` (service, event_id, template) describe the events of event logs.
    """

    def run(batches) -> Iterator:
        import pandas as pd

        names, rows = ["source", "time_ns", "sequence", "fields"], []
        for batch in batches:
            for content in batch["content"]:
                for row in raw_events(bytes(content or b"")):
                    rows.append(row)
                    if len(rows) >= 10_000:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
        if rows:
            yield pd.DataFrame(rows, columns=names)

    raw = blobs.select("content").mapInPandas(run, "source string, time_ns long, sequence string, fields map<string,string>")
    return normalise(raw, templates)


def normalise(raw: DataFrame, templates: DataFrame | None = None) -> DataFrame:
    """The schema's columns from (source, time_ns, sequence, fields), messages told by ``templates`` where they can be."""
    given = lambda *names: F.coalesce(*[F.nullif(F.try_element_at("fields", F.lit(n)), F.lit("")) for n in names], F.lit(""))
    log = F.col("source") == "eventlog"
    number = lambda name: F.try_element_at("fields", F.lit(name)).try_cast("int")
    message = F.when(log, F.concat(F.lit("Undescribed event: "), given("EventID"))).otherwise(F.coalesce(F.nullif(given("MESSAGE"), F.lit("")), F.lit("Undescribed event")))
    rows = raw.select(
        F.timestamp_micros(F.floor(F.col("time_ns") / 1000).cast("long")).alias("time"), "time_ns", F.when(log, given("Computer")).otherwise(given("_HOSTNAME")).alias("host"),
        F.when(log, given("UserID")).otherwise(given("_UID")).alias("user"), message.alias("message"),
        F.when(log, E.eventlog_severity(F.coalesce(number("Level"), F.lit(-1)))).otherwise(E.journal_severity(number("PRIORITY"))).alias("severity"),
        F.when(log, F.coalesce(F.nullif(given("EventRecordID"), F.lit("")), "sequence")).otherwise(F.col("sequence")).alias("sequence"), "source",
        F.when(log, given("Channel")).otherwise(given("_TRANSPORT")).alias("category"), E.known_service(F.when(log, given("ProviderName")).otherwise(given("_COMM", "SYSLOG_IDENTIFIER"))).alias("service"),
        F.when(log, F.col("fields")).otherwise(E.journal_fields(F.col("fields"))).alias("fields"),
    )
    rows = rows.select(*EVENTS.names)
    if templates is None:
        return rows
    logs = E.translate(rows.where("source = 'eventlog'"), templates, F.try_element_at("fields", F.lit("EventID")))
    logs = logs.withColumn("message", E.expand_params(F.col("message"), F.col("fields")))
    return logs.select(*EVENTS.names).unionByName(rows.where("source <> 'eventlog'"))
