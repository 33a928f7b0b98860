"""Files as rows: globs, folders, path lists, parts of archives, caps."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.classic.column import Column as ClassicColumn

from ..functions.scalars import is_text
from ..schemas import BLOBS
from . import formats
from .binary import rows_of
from .codecs import CONVERTERS, Limits, detect, expand_blobs

FILES, DEPTH = 8192, 63
LOCAL_PATHS = ("/var/log/journal", "/run/log/journal", "C:\\Windows\\System32\\winevt\\Logs")
COLUMNS = "path string, size long, content binary"


def glob_pattern(glob: str) -> str:
    """A glob as a pattern: ``**/`` is any folders or none, ``*`` and ``?`` stay within a name, ``[…]`` and ``{a,b}`` choose."""
    out, depth, at = [], 0, 0
    while at < len(glob):
        x = glob[at]
        if glob.startswith("**/", at):
            out.append("(?:.*/)?")
            at += 2
        elif glob.startswith("**", at):
            out.append(".*")
            at += 1
        elif x in "*?":
            out.append("[^/]*" if x == "*" else "[^/]")
        elif x == "[" and "]" in glob[at + 2 :]:
            end = glob.index("]", at + 2)
            inner = glob[at + 1 : end].replace("\\", "\\\\")
            out.append("[" + ("^" + inner[1:] if inner[0] in "!^" else inner) + "]")
            at = end
        elif x == "{":
            out.append("(?:")
            depth += 1
        elif x == "}" and depth:
            out.append(")")
            depth -= 1
        elif x == "," and depth:
            out.append("|")
        else:
            out.append(re.escape(x))
        at += 1
    return "".join(out)


@dataclass(frozen=True)
class Spec:
    """One path as it was given: what to read, and which files and members of those are meant."""

    root: str
    name: str | None
    pattern: str
    part: str

    @staticmethod
    def of(path: str) -> Spec:
        file, _, part = path.partition("!")
        file = file.rstrip("/") or "/"
        head, starred, _ = file.partition("**")
        whole = glob_pattern(re.sub("^file:/+", "/", file))
        if not starred:
            # a folder means all that is below it
            return Spec(file, None, f"^{whole}(?:/.*)?$" if file != "/" else "^/.*$", part)
        name = file.rpartition("/")[2]
        return Spec(head.rstrip("/") or "/", None if "**" in name else name, f"^{whole}$", part)

    def has(self, path: Column) -> Column:
        return F.rlike(path, F.lit(self.pattern))


def _there(spark: SparkSession, path: str) -> bool:
    """Whether a path or glob names anything; one that does not is passed over, like an empty folder."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where)
    return found is not None and len(found) > 0


def _file_name(path: Column) -> Column:
    return F.regexp_replace(F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), "^file:/+", "/")


def scan(spark: SparkSession, *paths: str, recursive: bool = True, pattern: str | None = None, depth: int | None = None) -> DataFrame:
    """(path, size, content) of files, folders and globs, each file once; ``content`` is not read unless it is used.

    A path with ``!`` names an archive's member: the archive is read, see :func:`load`. ``**`` stands for any
    folders, ``-`` for standard input. Each path is read by its own pattern, and a file that an earlier path
    has named is left out of later ones by its name alone, so nothing is shuffled. ``depth`` bounds how many
    folders below a path are read.
    """
    found, before = [], []
    for spec in dict.fromkeys(map(Spec.of, paths)):
        if spec.root == "-":
            found.append(from_bytes(spark, sys.stdin.buffer.read()))
            continue
        if not _there(spark, spec.root):
            continue
        reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive or spec.name is not None).lower())
        if (name := spec.name or pattern) is not None:
            reader = reader.option("pathGlobFilter", name)
        files = reader.load(spec.root)
        # the reader passes over empty files, but they are files; its list of all names stays in the JVM
        names = ClassicColumn(spark.sparkContext._jvm.org.apache.spark.sql.functions.lit(files._jdf.inputFiles()))
        listed = spark.range(0, 1, 1, 1).select(F.explode(names).alias("value")).select(_file_name(F.col("value")).alias("path"))
        some = files.select(_file_name(F.col("path")).alias("path"), F.col("length").alias("size"), "content")
        empty = listed.join(some.select("path"), "path", "left_anti").select("path", F.lit(0).cast("long").alias("size"), F.lit(b"").alias("content"))
        wanted = spec.has(F.col("path"))
        for x in before:
            wanted &= ~x.has(F.col("path"))
        if depth is not None:
            wanted &= _below(spec.root) <= depth
        found.append(some.where(wanted).unionByName(empty.where(wanted)))
        before.append(spec)
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], COLUMNS)


def _below(root: str) -> Column:
    """How many folders lie between ``root`` and a file; a glob's own folders count from its first name that is one."""
    fixed = re.split(r"[*?\[{]", re.sub("^file:/+", "/", root))[0]
    base = len([x for x in (fixed if fixed == root else fixed.rpartition("/")[0]).split("/") if x])
    return F.size(F.filter(F.split("path", "/"), lambda x: x != "")) - base - 1


def within_depth(blobs: DataFrame, root: str, most: int = DEPTH) -> DataFrame:
    """Files at most so many folders below ``root``."""
    return blobs.where(_below(root) <= most)


def total_size(blobs: DataFrame) -> DataFrame:
    """(files, bytes) of all blobs, from their sizes alone."""
    return blobs.agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("bytes"))


def from_bytes(spark: SparkSession, content: bytes, name: str = "-") -> DataFrame:
    """One blob from memory, as standard input is."""
    return spark.createDataFrame([(name, len(content), bytearray(content))], COLUMNS)


def path_list(text: str) -> list[str]:
    """The paths of a list with one a line."""
    return [x for x in (line.rstrip("\r") for line in text.split("\n")) if x]


def first_per_path(blobs: DataFrame) -> DataFrame:
    """Each path once, for blobs that :func:`scan` did not read; this shuffles their content."""
    return blobs.dropDuplicates(["path"])


def capped(blobs: DataFrame, most: int = FILES) -> DataFrame:
    """Fails where there are more files than the guard allows; it never drops one silently."""
    count = blobs.select("path").limit(most + 1).count()
    if count > most:
        raise ValueError(f"more than {most} files")
    return blobs


def parts(blobs: DataFrame, part: str) -> DataFrame:
    """Files whose whole path holds ``part``."""
    return blobs.where(F.contains("path", F.lit(part)))


def convert(blobs: DataFrame) -> DataFrame:
    """Binary formats as JSON lines with the hint ``json``; what cannot be read stays as it is."""

    def run(batches) -> Iterator:
        import json

        for batch in batches:
            for k, content in enumerate(batch["content"]):
                rows = [json.dumps(row, ensure_ascii=False) for _, row in rows_of(bytes(content or b""))]
                if rows:
                    batch.at[batch.index[k], "content"] = "\n".join(rows).encode()
                    batch.at[batch.index[k], "hint"] = "json"
            batch["size"] = batch["content"].map(len)
            yield batch[["path", "part", "hint", "size", "content", "error"]]

    return blobs.mapInPandas(run, BLOBS)


def load(spark: SparkSession, *paths: str, raw: int = 2, limits: Limits = Limits(), password: bytes | None = None, files: int | None = None, depth: int = DEPTH) -> DataFrame:
    """(path, part, hint, size, content, error) of files and archive members, each path once.

    ``raw`` leaves steps out: 1 the layout of JSON and XML, 2 the conversion of binary formats as
    well, 3 also unpacking, 4 also the guards on the number and depth of files. ``files`` sets the former and
    is off by default, as a cluster may read any number. ``hint`` names a binary format or text; ``error``
    says why a file was not unpacked or not wholly. ``a.zip!x`` means those members of that archive whose
    path holds ``x``, and does not touch what other paths name.
    """
    found = scan(spark, *paths, depth=depth if raw < 4 else None)
    if files is not None and raw < 4:
        found = capped(found, files)
    if raw < 3:
        rows = expand_blobs(found, limits, password)
    else:
        rows = found.select("path", F.lit("").alias("part"), F.lit("").alias("hint"), "size", "content", F.lit(None).cast("string").alias("error"))
    specs = [Spec.of(p) for p in paths]
    if any(x.part for x in specs):
        file = F.substring_index("path", "!", 1)
        rows = rows.where(reduce(or_, [x.has(file) & F.contains("path", F.lit(x.part)) if x.part else x.has(file) for x in specs]))
    rows = rows.withColumn("hint", F.coalesce(detect(F.col("content"), CONVERTERS), F.when(is_text(F.col("content")), "text"), F.lit("")))
    if raw < 2:
        rows = convert(rows)
    if raw < 1:
        text = F.try_validate_utf8(F.decode("content", "UTF-8"))
        laid = F.encode(formats.pretty(text), "UTF-8")
        rows = rows.withColumn("content", F.when(F.col("hint").isin("text", "json"), laid).otherwise(F.col("content"))).withColumn("size", F.length("content").cast("long"))
    return rows


def paths_only(spark: SparkSession, *paths: str) -> DataFrame:
    """A dry run: the paths alone, so no content is read."""
    return scan(spark, *paths).select("path")

