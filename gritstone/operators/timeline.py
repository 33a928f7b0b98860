"""File timelines: four times a file, signs of tampering, order, and body files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import epoch_seconds, sanitize
from ..schemas import TIMELINE
from ..shipping import written_once

TIMES = ("m_time", "a_time", "c_time", "b_time")


def stomped(shown: Column, kept: Column) -> Column:
    """A shown time without fraction that is not after the kept one: it was likely set by a tool."""
    return F.coalesce((F.unix_micros(shown) % 1_000_000 == 0) & (F.unix_seconds(shown) <= F.unix_seconds(kept)), F.lit(False))


def anomaly(pairs: list[tuple[Column, Column]]) -> Column:
    """True if any of the pairs (shown, kept) looks set."""
    out = F.lit(False)
    for shown, kept in pairs:
        out = out | stomped(shown, kept)
    return out


def sort_time() -> Column:
    """The first time there is of access, change of content, change of the record, birth."""
    return F.coalesce("a_time", "m_time", "c_time", "b_time")


def ordered(entries: DataFrame, path: str, *ties: str) -> DataFrame:
    """By file, time and what else makes the order total."""
    return entries.orderBy(path, sort_time().asc_nulls_first(), *ties)


def bodyfile() -> Column:
    """One line of version 3: ``0|name|inode|mode|0|0|size|a|m|c|b``."""
    name = sanitize(F.regexp_replace("name", r"([\\|/:])", r"\\$1"))
    times = [epoch_seconds(F.col(x)).cast("string") for x in ("a_time", "m_time", "c_time", "b_time")]
    return F.concat_ws("|", F.lit("0"), name, F.coalesce("inode", F.lit("")), F.coalesce("mode", F.lit("")), F.lit("0"), F.lit("0"), F.col("size").cast("string"), *times)


def mode(directory: Column, read_only: Column, link: Column | None = None) -> Column:
    """``drwxrwxrwx`` and the like; read-only files cannot be written."""
    kind = F.when(link, "l") if link is not None else F.when(F.lit(False), "l")
    return F.concat(kind.when(directory, "d").otherwise("-"), F.when(read_only, "r-xr-xr-x").otherwise("rwxrwxrwx"))


def run_entries(runs: DataFrame, *keep: str) -> DataFrame:
    """Entries of program runs (name, size, run_count, run_times, files): for each run the program, then its files."""
    each = runs.select(*keep, "name", "size", "run_count", "files", F.posexplode("run_times").alias("run", "a_time"))
    program = F.struct(F.col("name").alias("name"), F.col("size").alias("size"), (F.col("run_count") == 0).alias("anomaly"))
    used = F.transform("files", lambda f: F.struct(f.alias("name"), F.lit(0).cast("long").alias("size"), F.lit(False).alias("anomaly")))
    rows = each.select(*keep, F.size("files").alias("of"), F.col("name").alias("program"), "run", "a_time", F.posexplode(F.concat(F.array(program), used)).alias("nth", "entry"))
    return rows.select(*keep, *(["of"] if keep else []), "program", "run", "nth", "entry.name", "entry.size", "entry.anomaly", "a_time")


def entries(parsed: DataFrame) -> DataFrame:
    """Timeline rows (path, nth and the columns of the schema) of parsed files (path, nth, kind, row as JSON).

    File tables and shortcuts are an entry a record; a prefetch file is, for each run, the program and then
    the files it used, with the time of the run as that of access. Other kinds give nothing.
    """
    names = [x.name for x in TIMELINE]
    shape = "name string, inode string, size long, mode string, m_time string, a_time string, c_time string, b_time string, anomaly boolean"
    one = parsed.where(F.col("kind").isin("mft", "lnk")).select("path", "nth", F.from_json("row", shape).alias("e"))
    time = lambda x: F.col(f"e.{x}").try_cast("timestamp").alias(x)
    files = one.select("path", "nth", "e.name", F.coalesce("e.inode", F.lit("")).alias("inode"), F.greatest(F.coalesce("e.size", F.lit(0)), F.lit(0)).alias("size"), "e.mode", *map(time, TIMES), F.coalesce("e.anomaly", F.lit(False)).alias("anomaly"))
    shape = "name string, size long, run_count long, run_times array<string>, files array<string>"
    run = parsed.where("kind = 'pf'").select("path", F.from_json("row", shape).alias("e"))
    given = run.select("path", "e.name", "e.size", "e.run_count", F.transform("e.run_times", lambda x: x.try_cast("timestamp")).alias("run_times"), F.coalesce("e.files", F.array().cast("array<string>")).alias("files"))
    rows = run_entries(given, "path")
    none = F.lit(None).cast("timestamp")
    runs = rows.select("path", (F.col("run") * (F.lit(1) + F.col("of")) + F.col("nth")).cast("long").alias("nth"), "name", F.lit("").alias("inode"), "size", F.lit(None).cast("string").alias("mode"), none.alias("m_time"), "a_time", none.alias("c_time"), none.alias("b_time"), "anomaly")
    return files.unionByName(runs).select("path", "nth", *names)


def file_timeline(blobs: DataFrame, sort: bool = True) -> DataFrame:
    """The timeline of blobs (path, content): file tables, shortcuts and prefetch files, in order within each file.

    The same as :func:`entries` of the parsed files, with the times as numbers instead of text. A sort reads
    its rows twice, to find the ranges and to sort, so these are written once before it.
    """
    from ..sources.binary import parse_timeline

    rows = parse_timeline(blobs)
    rows = rows.select("path", "nth", *[F.timestamp_micros(x.name).alias(x.name) if x.name in TIMES else F.col(x.name) for x in TIMELINE])
    return ordered(written_once(rows, "timeline"), "path", "nth") if sort else rows
