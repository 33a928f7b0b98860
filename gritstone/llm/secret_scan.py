"""Secret scans with corpus-wide ownership frequency.

Candidates are found by patterns in the whole text. The hash of each candidate's value is summed up
over the corpus by the owners and repositories that hold it: a value that ``many`` owners hold is a
widely copied example, one that a single owner or two hold looks like a live credential. The base
kinds (assign, access, hex) are always reported; the further kinds only where their value is not a
widely copied example, as their patterns are too loose to stand alone.

No pattern has an upper length, and none starts anew within a run that it has failed on, so a scan is
linear in the text. Only hashes travel, and (hash, owner, repository) is combined before each shuffle,
so a value that a third of all documents hold is a few rows per task; values that hot are looked up by
broadcast, and there is a bounded number of them.

Defined cases: a null text is empty; spans count code points, ends exclusive; rows that repeat a
doc_id with other text are kept apart by the text's hash; a null owner or repository is a name of
its own; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import look_up, map_batches, materialise, pieces_of, raw_bytes, spread

#: The base kinds and the further ones, in the order in which spans of one start are listed.
BASE = ("assign", "access", "hex")
FURTHER = {
    "private_key": rb"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:-{0,4}[A-Za-z0-9+/=:,. \t\r\n])*+-----END [A-Z ]*PRIVATE KEY-----",
    "jwt": rb"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
    "prefixed": rb"gh[pousr]_[A-Za-z0-9]{30,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35}",
    "url": rb"://[!-.0-9;-?A-~]+:([!-.0-9;-?A-~]{6,})@",
    "bearer": rb"[Bb][Ee][Aa][Rr][Ee][Rr]\x20+([A-Za-z0-9._~+/-]{20,}=*)",
}
#: What a text must hold for a kind to occur at all.
HINTS = {"private_key": b"-----BEGIN ", "jwt": b"eyJ", "url": b"://"}
#: What may stand before ``://``; the first lower-case letter of such a run begins the span.
_SCHEME = frozenset(b"abcdefghijklmnopqrstuvwxyz0123456789+.-")
KINDS = (*BASE, *FURTHER)
#: A value held by at least so many owners is a widely copied example.
MANY_OWNERS = 3

_ASSIGN = re.compile(rb"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(rb"[0-9a-f]{16,}")
_FURTHER = {k: re.compile(v) for k, v in FURTHER.items()}


def further(kind: str, text: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(start, end, value) of the candidates of one further kind, leftmost first, none overlapping."""
    at = 0
    for m in _FURTHER[kind].finditer(text):
        start = m.start()
        if kind == "url":
            # back over the scheme: runs of two places never overlap, as ``:`` is in none
            first = start
            while first > at and text[first - 1] in _SCHEME:
                first -= 1
            while first < start and not 97 <= text[first] <= 122:
                first += 1
            if start - first < 2:
                continue
            start, at = first, m.end()
        yield start, m.end(), m[m.lastindex or 0]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans with those that overlap as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def scan(text: bytes) -> list[tuple[int, int, int, bytes]]:
    """(start, kind, end, value) of every candidate, in bytes; further kinds where no span before them is."""
    found = [(m.start(), 0, m.end(), m[1]) for m in _ASSIGN.finditer(text) if len(m[1]) >= 12]
    found += [(m.start(), 1, m.end(), m[0]) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end(), m[0]) for m in _HEX.finditer(text)]
    taken = merged([(x[0], x[2]) for x in found])
    for kind, name in enumerate(FURTHER, len(BASE)):
        if HINTS.get(name, b"") not in text:
            continue
        k, new = 0, []
        for start, end, value in further(name, text):
            while k < len(taken) and taken[k][1] <= start:
                k += 1
            if k == len(taken) or taken[k][0] >= end:
                new.append((start, kind, end, value))
        if new:
            found += new
            taken = merged([*taken, *((x[0], x[2]) for x in new)])
    return sorted(found)


SCANNED = "doc_id long, text_key long, owner string, repository string, n_assign long, n_access long, n_hex long, base_sha256 string, found array<struct<start:long,kind:int,end:long,value:long>>"


def candidates(docs: DataFrame) -> DataFrame:
    """One row per document with its base columns and all candidates, in code points."""

    def run(batch) -> Iterator:
        import hashlib

        import pyarrow as pa
        from xxhash import xxh3_64_intdigest

        kind_of = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("value", pa.int64())]))
        for part in pieces_of(batch, "text", 16 << 20):
            keys, counts, digests, lists = [], [[], [], []], [], []
            for text in raw_bytes(part.column("text")):
                text = text or b""
                points = []
                at = done = 0
                for start, kind, end, value in scan(text):
                    done, at = done + len(text[at:start].decode()), start
                    hashed = xxh3_64_intdigest(value)
                    points.append({"start": done, "kind": kind, "end": done + len(text[start:end].decode()), "value": hashed - (1 << 64) if hashed >> 63 else hashed})
                for kind in range(3):
                    counts[kind].append(sum(x["kind"] == kind for x in points))
                named = ",".join(f"{KINDS[x['kind']]}:{x['start']}:{x['end']}" for x in points if x["kind"] < len(BASE))
                digests.append(hashlib.sha256(named.encode()).hexdigest())
                key = xxh3_64_intdigest(text)
                keys.append(key - (1 << 64) if key >> 63 else key)
                lists.append(points)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(keys, pa.int64()), part.column("owner"), part.column("repository"), *[pa.array(x, pa.int64()) for x in counts], pa.array(digests, pa.string()), pa.array(lists, kind_of)], names=["doc_id", "text_key", "owner", "repository", "n_assign", "n_access", "n_hex", "base_sha256", "found"])

    return map_batches(spread(docs.select("doc_id", "text", "owner", "repository")), run, SCANNED)


def ownership(each: DataFrame) -> DataFrame:
    """(value, n_owners, n_repositories, n_rows) over the whole corpus."""
    by_repository = each.groupBy("value", "owner", "repository").agg(F.count("*").alias("n"))
    by_owner = by_repository.groupBy("value", "owner").agg(F.count("*").alias("held"), F.sum("n").alias("n"))
    return by_owner.groupBy("value").agg(F.count("*").alias("n_owners"), F.sum("held").alias("n_repositories"), F.sum("n").alias("n_rows"))


def scan_documents(docs: DataFrame, owner: str = "source", repository: tuple[str, ...] = ("source", "lang"), many: int = MANY_OWNERS) -> DataFrame:
    """doc_id, the base columns, ``spans`` with what the method adds, and how many look live or copied.

    A document's owner is the column ``owner``, its repository the columns ``repository`` together.
    """
    name = lambda x: F.coalesce(F.col(x).cast("string"), F.lit("\0"))
    given = docs.select(F.col("doc_id").cast("long"), "text", name(owner).alias("owner"), F.concat_ws("\1", *map(name, repository)).alias("repository"))
    rows = materialise(candidates(given), "scanned")
    each = rows.select("doc_id", "text_key", "owner", "repository", F.explode("found").alias("x")).select("doc_id", "text_key", "owner", "repository", "x.*")
    held = materialise(ownership(each.select("value", "owner", "repository")), "ownership")
    judged = look_up(each.select("doc_id", "text_key", "start", "kind", "end", "value"), held, "value")
    live = F.col("n_owners") < many
    verdicts = judged.groupBy("doc_id", "text_key").agg(
        F.collect_set(F.when(live & (F.col("kind") >= len(BASE)), F.struct("start", "kind", "end"))).alias("added"),
        F.count_if(live).alias("live"), F.count_if(~live).alias("copied"), F.count("*").alias("all"),
    )
    base = F.filter("found", lambda x: x["kind"] < len(BASE))
    spans = F.array_sort(F.concat(F.transform(base, lambda x: F.struct(x["start"], x["kind"], x["end"])), F.coalesce("added", F.array().cast("array<struct<start:long,kind:int,end:long>>"))))
    names = F.array(*map(F.lit, KINDS))
    joined = rows.join(verdicts, (rows.doc_id.eqNullSafe(verdicts.doc_id)) & (rows.text_key == verdicts.text_key), "left").select(rows["*"], "added", "live", "copied", "all")
    size = F.size("found")
    part = lambda x: (F.coalesce(x, F.lit(0)) * size / F.greatest(F.coalesce("all", F.lit(1)), F.lit(1))).cast("long")  # noqa: E731  repeated rows count once each
    return joined.select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256",
        F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",").alias("spans"),
        part(F.col("live")).alias("n_live"), part(F.col("copied")).alias("n_copied"), "text_key",
    )


def redact(docs: DataFrame, mark: str = "[SECRET]", **options) -> DataFrame:
    """``docs`` with every reported span replaced by ``mark`` and ``n_chars``, if there, brought in line.

    The columns of ``docs`` travel as one, so none of them can clash with the operator's own.
    """
    found = scan_documents(docs, **options).where("spans <> ''").select("doc_id", "text_key", "spans").distinct()

    def key(batch) -> Iterator:
        import pyarrow as pa
        from xxhash import xxh3_64_intdigest

        keys = [xxh3_64_intdigest(x or b"") for x in raw_bytes(batch.column("text"))]
        yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), pa.array([x - (1 << 64) if x >> 63 else x for x in keys], pa.int64())], names=["row", "doc_id", "text_key"])

    def cut(batch) -> Iterator:
        import pyarrow as pa

        row = batch.column("row")
        texts = []
        for text, spans in zip(row.field("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            if spans and text:
                out, at = [], 0
                for start, end in sorted(tuple(map(int, x.split(":")[1:])) for x in spans.split(",")):
                    if end > at:
                        out += [text[at : max(start, at)], mark] if start >= at else []
                        at = end
                text = "".join([*out, text[at:]])
            texts.append(text)
        names = [row.type.field(k).name for k in range(row.type.num_fields)]
        columns = [pa.array(texts, pa.string()) if x == "text" else row.field(x) for x in names]
        yield pa.RecordBatch.from_arrays(columns, names=names)

    packed = docs.select(F.struct(*[docs[x] for x in docs.columns]).alias("row"), docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    keyed = map_batches(packed, key, f"row {packed.schema['row'].dataType.simpleString()}, doc_id long, text_key long").alias("a")
    same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.text_key") == F.col("b.text_key"))
    joined = keyed.join(found.alias("b"), same, "left").select("a.row", "b.spans")
    out = map_batches(joined, cut, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out
