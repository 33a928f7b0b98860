"""Scalar expressions: sanitising, sizes, limits, key spelling. All are Columns, none runs Python on rows."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# The bidirectional controls that can reorder displayed text, and what replaces them.
BIDI = "\u202a\u202b\u202c\u202d\u202e\u2066\u2067\u2068\u2069"
BIDI_MARK = "×"

UNITS = "bkmgtpez"


def sanitize(text: Column) -> Column:
    """Each bidirectional control replaced by a visible mark."""
    return F.translate(text, BIDI, BIDI_MARK * len(BIDI))


def expand_tabs(text: Column) -> Column:
    """Tabs as two blanks."""
    return F.replace(text, F.lit("\t"), F.lit("  "))


def humanize(size: Column) -> Column:
    """A byte count as ``12b`` or, from 1024 on, with one decimal and the unit that keeps it below 1024."""
    size = size.cast("double")
    out = F.format_string("%.0fb", size)
    for power, unit in enumerate(UNITS[1:], 1):
        # bround, as ties go to the even digit
        out = F.when(size >= 1024.0**power, F.concat(F.format_string("%.1f", F.bround(size / 1024.0**power, 1)), F.lit(unit))).otherwise(out)
    return out


def mechanize(size: str) -> int:
    """The byte count of a size such as ``4k``; raises ValueError for other spellings, signs below zero and overflow."""
    match = re.fullmatch(r"([-+]?\d+)([bkmgtpez]?)", size.strip().lower())
    if not match:
        raise ValueError(f"invalid size: {size!r}")
    count = int(match[1]) * 1024 ** UNITS.index(match[2] or "b")
    if not 0 <= count < 1 << 63:
        raise ValueError(f"size out of range: {size!r}")
    return count


@dataclass(frozen=True)
class Limit:
    """The first or last so many bytes or lines; a count of None is no limit."""

    count: int | None = None
    lines: bool = False
    tail: bool = False

    @classmethod
    def parse(cls, text: str) -> Limit:
        """``10``/``10b`` bytes, ``1fh`` bytes in hexadecimal, ``3l`` lines; a minus counts from the end."""
        text = text.strip().lower()
        if not text:
            return cls()
        if not re.fullmatch(r"-?[0-9a-f]+[bhl]?", text):
            raise ValueError(f"invalid limit syntax: {text!r}")
        unit = text[-1] if text[-1] in "hbl" else ""
        digits = text.removesuffix(unit) if unit else text
        value = int(digits, 16 if unit == "h" else 10)
        if not -(1 << 63) < value < 1 << 63:
            raise ValueError(f"invalid limit: {text!r}")
        return cls(abs(value) or None, unit == "l", text[0] == "-")

    def of_bytes(self, content: Column) -> Column:
        """What the limit leaves of a binary column; a limit of lines leaves bytes as they are."""
        if self.count is None or self.lines:
            return content
        if self.tail:
            return F.substring(content, F.greatest(F.length(content) - self.count, F.lit(0)) + 1, F.lit(self.count))
        return F.substring(content, 1, min(self.count, (1 << 31) - 1))


def truncate(text: Column, size: int) -> Column:
    """The longest prefix of whole characters with at most ``size`` bytes of UTF-8."""
    raw = F.encode(text, "UTF-8")
    # a continuation byte starts with the bits 10; back off to where a character starts
    cut = F.lit(0)
    for back in range(4, 0, -1):
        at = size + 2 - back
        first = F.conv(F.hex(F.substring(raw, at, 1)), 16, 10).cast("int")
        cut = F.when(F.lit(at >= 1) & ((first < 128) | (first > 191)), F.lit(at - 1)).otherwise(cut)
    return F.when(F.length(raw) <= size, text).otherwise(F.decode(F.substring(raw, F.lit(1), cut), "UTF-8"))


def has_magic(content: Column, magic: bytes, offset: int = 0) -> Column:
    """Whether the bytes at ``offset`` are ``magic``; false where the content is too short."""
    return F.coalesce(F.substring(content, offset + 1, len(magic)) == F.lit(magic), F.lit(False))


def is_text(content: Column) -> Column:
    """Not empty, and without a zero byte in the first 4096."""
    return (F.length(content) > 0) & (F.position(F.lit(b"\0"), F.substring(content, 1, 4096)) == 0)


def split_part(path: Column) -> tuple[Column, Column]:
    """A path and the archive member behind its first ``!``, empty if there is none."""
    at = F.instr(path, "!")
    return F.when(at > 0, F.substring(path, F.lit(1), at - 1)).otherwise(path), F.when(at > 0, F.substring(path, at + 1, F.length(path))).otherwise("")


def title_key(key: Column) -> Column:
    """``_SOURCE_REALTIME_TIMESTAMP`` as ``SourceRealtimeTimestamp``: one leading underscore goes."""
    bare = F.when(F.startswith(key, F.lit("_")), F.substring(key, F.lit(2), F.length(key))).otherwise(key)
    return F.replace(F.initcap(F.replace(bare, F.lit("_"), F.lit(" "))), F.lit(" "), F.lit(""))


def filetime_ns(value: Column) -> Column:
    """Nanoseconds since 1970 of a count of 100 ns since 1601."""
    return (value.cast("long") - F.lit(116_444_736_000_000_000)) * 100


def epoch_seconds(time: Column) -> Column:
    """Whole seconds since 1970, 0 for null."""
    return F.coalesce(F.unix_seconds(time), F.lit(0)).cast("long")


def entropy(text: Column) -> Column:
    """Bits per byte of a short binary value, as an expression; see operators.stats for whole files."""
    digits = F.regexp_extract_all(F.hex(text), F.lit("(..)"), F.lit(1))
    size = F.size(digits)
    counts = F.transform(F.array_distinct(digits), lambda d: F.size(F.filter(digits, lambda x: x == d)) / size)
    return F.when(size > 0, -F.aggregate(counts, F.lit(0.0), lambda a, p: a + p * F.log2(p))).otherwise(0.0)
