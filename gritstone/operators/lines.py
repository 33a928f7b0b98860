"""Lines of text: numbering, search with context, uniqueness, first and last lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import Limit, sanitize


def split_lines(text: Column) -> Column:
    """The lines of a text: ``\\n`` or ``\\r\\n`` ends one, and no empty line follows the last end."""
    parts = F.split(text, "\n", -1)
    last = F.element_at(parts, -1) == ""
    kept = F.when(last, F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    return F.transform(kept, lambda x: F.regexp_replace(x, "\r$", ""))


def number_lines(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, line, text): one row per line, from 1; null and empty texts have none.

    One row becomes many without a shuffle, and only the two columns named are read.
    """
    numbered = texts.select(F.col(key), F.posexplode(split_lines(F.col(text))).alias("at", "text"))
    return numbered.select(key, (F.col("at") + 1).cast("long").alias("line"), "text")


def grep(lines: DataFrame, pattern: str) -> DataFrame:
    """Lines in which the pattern is found."""
    return lines.where(F.rlike("text", F.lit(pattern)))


def grep_context(texts: DataFrame, key: str, pattern: str, before: int = 0, after: int = 0, text: str = "text") -> DataFrame:
    """(key, grp, line, text): every match with its neighbours, numbered by match from 1.

    Overlapping neighbourhoods repeat their lines, one copy per group. The lines of a text are one
    array, so the neighbourhoods are slices of it and neither a join nor a shuffle is needed.
    """
    # exploding an array of one array splits each text once; inlined, it would be split for every line
    whole = texts.select(F.col(key), F.explode(F.array(split_lines(F.col(text)))).alias("lines"))
    numbered = F.transform("lines", lambda x, k: F.when(F.rlike(x, F.lit(pattern)), k + 1))
    hits = whole.select(key, "lines", F.explode(F.array(F.filter(numbered, lambda k: k.isNotNull()))).alias("hits"))
    first = lambda hit: F.greatest(F.lit(1), hit - before)
    part = lambda hit, k: F.struct((k + 1).alias("grp"), first(hit).alias("first"), F.slice("lines", first(hit), hit + after - first(hit) + 1).alias("part"))
    groups = hits.select(key, F.explode(F.transform("hits", part)).alias("group"))
    rows = groups.select(key, "group.grp", "group.first", F.posexplode("group.part").alias("at", "text"))
    return rows.select(key, F.col("grp").cast("long").alias("grp"), (F.col("first") + F.col("at")).cast("long").alias("line"), "text")


def mark_groups(rows: DataFrame, key: str) -> DataFrame:
    """``starts_group`` for rows of :func:`grep_context`: true where another group of the key came before."""
    before = F.lag("grp").over(Window.partitionBy(key).orderBy("grp", "line"))
    return rows.withColumn("starts_group", F.coalesce(before != F.col("grp"), F.lit(False)))


def first_of_each(rows: DataFrame, value: str | tuple[str, ...], *order: str) -> DataFrame:
    """For each value (of one column or several) the row that comes first in ``order``; make it total.

    The minimum is combined before the shuffle, so a value that most rows have is a few rows a task;
    a window would gather them all. Rows are grouped by two 64-bit hashes of the value, as first-wins
    sets of hashes do: sorting numbers costs a fraction of sorting texts, and two values among 1e12
    share both with a probability of 1e-15.
    """
    keys = [value] if isinstance(value, str) else list(value)
    missing = [F.col(x).isNull() for x in keys]
    names = [F.xxhash64(*keys, *missing).alias("_one"), F.xxhash64(F.lit(1), *reversed(keys), *missing).alias("_two")]
    whole = rows.select(*names, F.struct(*order).alias("_order"), F.struct(*rows.columns).alias("_row"))
    found = whole.groupBy("_one", "_two").agg(F.min_by("_row", "_order").alias("_first"))
    return found.select("_first.*")


def head_lines(lines: DataFrame, count: int) -> DataFrame:
    return lines.where(F.col("line") <= count)


def tail_lines(texts: DataFrame, key: str, count: int, text: str = "text") -> DataFrame:
    """The last lines of each text with their true numbers."""
    whole = texts.select(F.col(key), split_lines(F.col(text)).alias("lines"))
    start = F.greatest(F.size("lines") - count, F.lit(0))
    rows = whole.select(key, start.alias("start"), F.posexplode(F.slice("lines", start + 1, F.lit(max(count, 0)))).alias("at", "text"))
    return rows.select(key, (F.col("start") + F.col("at") + 1).cast("long").alias("line"), "text")


def limit_bytes(blobs: DataFrame, limit: Limit, content: str = "content") -> DataFrame:
    return blobs.withColumn(content, limit.of_bytes(F.col(content)))


def padded_lines(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, line, number, text): lines with ``number``, the line number with zeros in front, as wide as the key's last one.

    The last number is the size of a text's own array of lines, so a long text is no task of its own.
    """
    whole = texts.select(F.col(key), F.explode(F.array(split_lines(F.col(text)))).alias("lines"))
    rows = whole.select(key, F.length(F.size("lines").cast("string")).alias("width"), F.posexplode("lines").alias("at", "text"))
    line = F.col("at") + 1
    return rows.select(key, line.cast("long").alias("line"), F.lpad(line.cast("string"), F.col("width"), F.lit("0")).alias("number"), "text")


def render_lines(lines: DataFrame) -> DataFrame:
    """Text as it is displayed: tabs as two blanks, controls that reorder it made visible."""
    return lines.withColumn("text", sanitize(F.replace(F.col("text"), F.lit("\t"), F.lit("  "))))
