"""Sizes, line counts and entropy of whole files or of blocks of them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import bound_batches


#: Bytes that are counted at once, as numpy counts a copy of eight times their size.
PIECE = 1 << 20


@F.pandas_udf(T.DoubleType())
def _entropy(content: pd.Series) -> pd.Series:
    import numpy as np

    def one(data) -> float:
        if not data:
            return 0.0
        whole = np.frombuffer(data, np.uint8)
        counts = np.zeros(256, np.int64)
        for at in range(0, len(whole), PIECE):
            counts += np.bincount(whole[at : at + PIECE], minlength=256)
        shares = counts[counts > 0] / len(data)
        return float(-(shares * np.log2(shares)).sum())

    return content.map(one)


def entropy(content: Column) -> Column:
    """Bits per byte, 0 to 8, cut off after six decimals."""
    # sums in another order may end just below a whole step; 1e-9 is far below the last decimal
    return F.floor(_entropy(content) * 1e6 + 1e-3) / 1e6


def file_stats(blobs: DataFrame, key: str, content: str = "content") -> DataFrame:
    """(key, bytes, lines, offset, entropy, is_block) of whole files; lines are counted by their ends."""
    bound_batches(blobs.sparkSession)
    data = F.col(content)
    # one latin character stands for each byte, so line ends can be counted as text
    plain = F.decode(data, "ISO-8859-1")
    ends = F.length(plain) - F.length(F.replace(plain, F.lit("\n"), F.lit("")))
    return blobs.select(F.col(key), F.length(data).cast("long").alias("bytes"), ends.cast("long").alias("lines"), F.lit(0).cast("long").alias("offset"), entropy(data).alias("entropy"), F.lit(False).alias("is_block"))


def block_stats(blobs: DataFrame, key: str, size: int, content: str = "content") -> DataFrame:
    """The same for blocks of ``size`` bytes, the last may be shorter; empty files have none."""
    some = blobs.where(F.length(content) > 0)
    cut = some.select(key, content, F.explode(F.sequence(F.lit(0), F.length(content) - 1, F.lit(size))).alias("offset"))
    blocks = cut.select(key, F.col("offset").cast("long").alias("offset"), F.substring(F.col(content), F.col("offset") + 1, F.lit(size)).alias("content"))
    stats = file_stats(blocks.withColumn("_key", F.struct(key, "offset")), "_key")
    return stats.select(F.col(f"_key.{key}").alias(key), "bytes", "lines", F.col("_key.offset").alias("offset"), "entropy", F.lit(True).alias("is_block"))


def in_entropy_range(stats: DataFrame, least: float = 0.0, most: float = 8.0) -> DataFrame:
    """Files within the range, both ends included; an empty file counts as 0 and shows only from 0 on."""
    if least > most:
        raise ValueError("invalid range")
    return stats.where(F.when(F.col("bytes") == 0, F.lit(least == 0)).otherwise(F.col("entropy").between(least, most)))


def render(size: Column, lines: Column, bits: Column) -> Column:
    """Lines, size, entropy and a bar of 16 places."""
    from ..functions.scalars import humanize

    filled = F.round(bits * 2).cast("int")
    bar = F.concat(F.lit("["), F.repeat(F.lit("■"), filled), F.repeat(F.lit(" "), 16 - filled), F.lit("]"))
    return F.concat(F.lpad(lines.cast("string"), 7, " "), F.lit("l "), F.lpad(humanize(size), 7, " "), F.lit("  "), F.format_string("%.1f", F.bround(bits, 1)), F.lit("e "), bar)
