"""Strings carved from text or bytes, with offset, address and classes."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.classes import classify, has_class
from ..functions.scalars import sanitize

MIN, MAX = 3, 256


def carve_text(texts: DataFrame, key: str, text: str = "text", least: int = MIN, most: int = MAX, ascii_only: bool = True) -> DataFrame:
    """(key, nth, value): printable runs of a text column, cut at ``most`` characters.

    A run's pieces are numbered on; a piece shorter than ``least`` is dropped. Built from JVM
    expressions only: one pass of a pattern, then slices.
    """
    kind = r"[\x20-\x7E]" if ascii_only else r"[^\p{Cc}\p{Cn}\p{Cs}]"
    runs = F.regexp_extract_all(F.col(text), F.lit(f"({kind}{{{least},}})"), F.lit(1))
    cut = F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.length(r), F.lit(most)), lambda a: F.substring(r, a, F.lit(most))))
    pieces = F.filter(F.flatten(cut), lambda p: F.length(p) >= least)
    rows = texts.select(F.col(key), F.posexplode(pieces).alias("nth", "value"))
    return rows.select(key, (F.col("nth") + 1).cast("long").alias("nth"), "value")


def carve_bytes(blobs: DataFrame, key: str, content: str = "content", least: int = MIN, most: int = MAX, ascii_only: bool = False, trim: bool = False) -> DataFrame:
    """(key, offset, address, value): printable runs of bytes with their true offsets.

    UTF-8 is decoded as far as it is valid; with ``ascii_only`` other bytes end a run. Trimming
    moves the offset past the blanks in front only.
    """

    def run(batches) -> Iterator:
        import re

        import pandas as pd

        pattern = re.compile(rb"[\x20-\x7e]+" if ascii_only else rb"(?:[\x20-\x7e]|[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2})+")
        for batch in batches:
            rows = []
            for name, data in zip(batch[key], batch[content], strict=True):
                for found in pattern.finditer(data or b""):
                    text, at = found[0].decode(), found.start()
                    for k in range(0, len(text), most):
                        piece = text[k : k + most]
                        if len(piece) >= least:
                            bare = piece.strip() if trim else piece
                            lead = len(piece) - len(piece.lstrip()) if trim else 0
                            if bare:
                                rows.append((name, at + lead, bare))
                        at += len(piece.encode())
            yield pd.DataFrame(rows, columns=[key, "offset", "value"])

    kind = dict(blobs.dtypes)[key]
    carved = blobs.select(key, content).mapInPandas(run, f"{key} {kind}, offset long, value string")
    return carved.select(key, "offset", F.lpad(F.lower(F.hex("offset")), 8, "0").alias("address"), sanitize(F.col("value")).alias("value"))


def with_classes(strings: DataFrame, level: int, wanted: tuple[str, ...] = ()) -> DataFrame:
    """``classes`` of each value; naming classes implies level 3 and keeps their strings only."""
    out = strings.withColumn("classes", classify(F.col("value"), 3 if wanted else level))
    return out.where(has_class(F.col("classes"), *wanted)) if wanted else out
