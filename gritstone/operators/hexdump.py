"""Hex dumps: rows of 16 bytes, plain or with addresses and characters, repeats squeezed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH = 16


def rows_of(blobs: DataFrame, key: str, content: str = "content", before: int = 0) -> DataFrame:
    """(key, offset, chunk): pieces of 16 bytes, the last may be shorter; empty content has none.

    With ``before``, ``back1`` and so on are the chunks so many rows before, null where there are none.
    """
    some = blobs.where(F.length(content) > 0)
    at = some.select(key, content, F.explode(F.sequence(F.lit(0), F.length(content) - 1, F.lit(WIDTH))).alias("offset"))
    part = lambda k: F.substring(F.col(content), F.col("offset") + 1 - k * WIDTH, F.lit(WIDTH))
    backs = [F.when(F.col("offset") >= k * WIDTH, part(k)).alias(f"back{k}") for k in range(1, before + 1)]
    return at.select(key, F.col("offset").cast("long").alias("offset"), part(0).alias("chunk"), *backs)


def plain(rows: DataFrame) -> DataFrame:
    """``values``: two lower-case digits and a blank for each byte."""
    return rows.withColumn("values", F.regexp_replace(F.lower(F.hex("chunk")), "(..)", "$1 "))


def pretty(rows: DataFrame) -> DataFrame:
    """``address``, ``values`` with a second blank after each 8 bytes, padded to 50, and ``chars``."""
    spaced = F.regexp_replace(F.lower(F.hex("chunk")), "(..)", "$1 ")
    halves = F.concat(F.substring(spaced, 1, 24), F.when(F.length("chunk") >= 8, F.lit(" ")).otherwise(""), F.substring(spaced, 25, 24), F.when(F.length("chunk") == WIDTH, F.lit(" ")).otherwise(""))
    # bytes outside the printable range are dots; read as Latin-1 each byte is one character
    chars = F.regexp_replace(F.decode("chunk", "ISO-8859-1"), "[^\\x20-\\x7E]", "·")
    return rows.select("*", F.lpad(F.lower(F.hex("offset")), 8, "0").alias("address"), F.rpad(halves, 50, " ").alias("values"), chars.alias("chars"))


def squeeze(rows: DataFrame) -> DataFrame:
    """Runs of rows with equal chunks as their first row and, for the rest, one row marked ``*``.

    ``rows`` are those of :func:`rows_of` with two chunks ``before``: each row tells from its own file's bytes
    whether it repeats, so rows need neither a window nor an order.
    """
    same, earlier = (F.coalesce(F.col(a) == F.col(b), F.lit(False)) for a, b in (("chunk", "back1"), ("back1", "back2")))
    kept = rows.where(~(same & earlier))
    return kept.withColumn("values", F.when(same, F.lit("*")).otherwise(F.col("values"))).drop("back1", "back2")


def grep(rows: DataFrame, pattern: str) -> DataFrame:
    """Rows in whose rendered ``values`` the pattern is found; the pretty form has a second blank after each 8 bytes."""
    return rows.where(F.rlike("values", F.lit(pattern)))
