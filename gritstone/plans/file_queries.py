"""Registered queries about files: scans, containers and binary formats made of the tables' rows and read back, sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import digests, scalars
from ..operators import stats, strings, timeline
from ..shipping import shared_folder
from ..sources import binary, blobs, codecs, evtx, formats, sinks
from ..sources.tables import read, spread
from . import containers
from .hunt import hunt
from .queries import CRITICAL, ENVELOPE, ENVELOPE_SQL, EVENTS, FILES, _crc_table, contents, documents, hunted, query


def _names(names) -> str:
    return "[" + ", ".join(f"'{x}'" for x in names) + "]"


def _nth(names, key: str = "doc_id"):
    """The name whose turn it is."""
    return F.get(F.array(*map(F.lit, names)), (F.col(key) % len(names)).cast("int"))


# ---- scans --------------------------------------------------------------------------------------


def _customer_files(spark, sf_dir) -> str:
    """A folder with a text file of names for each nation that has customers, and one level deeper an index of nations."""
    folder = f"{shared_folder(spark)}/names-{uuid.uuid4().hex}"
    names = read(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", "c_name")
    one = names.groupBy("c_nationkey").agg(F.sort_array(F.collect_list(F.struct("c_custkey", "c_name"))).alias("all"))
    one.select(F.array_join(F.transform("all", lambda x: x["c_name"]), "\n").alias("value"), "c_nationkey").repartition("c_nationkey").write.partitionBy("c_nationkey").text(f"{folder}/names")
    regions = read(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_join(F.sort_array(F.collect_list("n_name")), "\n").alias("value"))
    regions.select("value", F.lit("deep").alias("kind"), "n_regionkey").repartition("n_regionkey").write.partitionBy("kind", "n_regionkey").text(f"{folder}/names/index")
    return folder


NATION_FILES = """
files AS (
  SELECT 'c_nationkey=' || c_nationkey AS folder, string_agg(c_name, chr(10) ORDER BY c_custkey) || chr(10) AS body, 1 AS depth FROM customer GROUP BY c_nationkey
  UNION ALL SELECT 'n_regionkey=' || n_regionkey, string_agg(n_name, chr(10) ORDER BY n_name) || chr(10), 3 FROM nation GROUP BY n_regionkey
)"""


@query(f"WITH {NATION_FILES} SELECT folder, strlen(body) AS size, sha256(body) AS sha256 FROM files")
def scan_once(spark, sf_dir):
    """Files named by a folder, by a glob and by ``**``, each once."""
    folder = _customer_files(spark, sf_dir)
    found = blobs.scan(spark, f"{folder}/names/c_nationkey=1*/*.txt", f"{folder}/**/*.txt", f"{folder}/names")
    return found.select(F.element_at(F.split("path", "/"), -2).alias("folder"), "size", F.sha2("content", 256).alias("sha256"))


@query(f"WITH {NATION_FILES} SELECT folder, body AS text FROM files WHERE depth <= 2 AND folder LIKE 'c%'")
def scan_depth(spark, sf_dir):
    """A folder with a guard on its depth; paths that name nothing are passed over."""
    folder = _customer_files(spark, sf_dir)
    found = blobs.load(spark, f"{folder}/names", f"{folder}/missing/*.txt", raw=3, depth=2)
    return found.select(F.element_at(F.split("path", "/"), -2).alias("folder"), F.decode("content", "UTF-8").alias("text"))


@query(f"WITH {NATION_FILES} SELECT folder, count(*) AS n FROM files GROUP BY folder")
def scan_dry_run(spark, sf_dir):
    """The paths alone."""
    found = blobs.paths_only(spark, f"{_customer_files(spark, sf_dir)}/**/*.txt")
    return found.groupBy(F.element_at(F.split("path", "/"), -2).alias("folder")).agg(F.count("*").alias("n"))


@query("""WITH files AS (SELECT 'n_regionkey=' || n_regionkey AS folder, string_agg('{"key":' || n_nationkey || ',"name":"' || n_name || '"}', chr(10) ORDER BY n_nationkey) AS raw,
  string_agg('{' || chr(10) || '  "key": ' || n_nationkey || ',' || chr(10) || '  "name": "' || n_name || '"' || chr(10) || '}', chr(10) ORDER BY n_nationkey) AS laid, count(*) AS n FROM nation GROUP BY n_regionkey)
SELECT 'raw' AS level, folder, raw || chr(10) AS text FROM files UNION ALL SELECT 'laid out', folder, laid FROM files""")
def load_levels(spark, sf_dir):
    """Lines of JSON as they are, and laid out."""
    folder = f"{shared_folder(spark)}/lines-{uuid.uuid4().hex}"
    rows = read(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list(F.struct(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name")))).alias("all"))
    rows.select(F.array_join(F.transform("all", lambda x: F.to_json(x)), "\n").alias("value"), "n_regionkey").repartition("n_regionkey").write.partitionBy("n_regionkey").text(folder)
    levels = [blobs.load(spark, f"{folder}/**/*.txt", raw=k).select(F.lit(name).alias("level"), F.element_at(F.split("path", "/"), -2).alias("folder"), F.decode("content", "UTF-8").alias("text")) for k, name in ((2, "raw"), (0, "laid out"))]
    return levels[0].union(levels[1])


# ---- containers ---------------------------------------------------------------------------------


@query(f"SELECT doc_id, {_names(containers.COMPRESSIONS)}[doc_id % {len(containers.COMPRESSIONS)} + 1] AS kind, strlen(coalesce(text, '')) AS size, sha256(coalesce(text, '')) AS sha256 FROM documents")
def inflate_each(spark, sf_dir):
    """Every document packed by the compression whose turn it is, and unpacked."""
    plain = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    packed = documents(spark, sf_dir).select(F.col("doc_id").cast("string").alias("path"), containers.compressed(plain, _nth(containers.COMPRESSIONS)).alias("content"))
    found = codecs.expand_blobs(packed, codecs.Limits(expansion=10_000)).where("error is null")
    found = found.select(F.col("path").cast("long").alias("doc_id"), "size", F.sha2("content", 256).alias("sha256"))
    return found.select("doc_id", _nth(containers.COMPRESSIONS).alias("kind"), "size", "sha256")


@query(f"""WITH members AS (SELECT doc_id, 'a.txt' AS member, coalesce(text, '') AS body FROM documents UNION ALL SELECT doc_id, 'b.txt', 'number ' || doc_id FROM documents)
SELECT doc_id, {_names(containers.ARCHIVES)}[doc_id % {len(containers.ARCHIVES)} + 1] AS kind, member, strlen(body) AS size, sha256(body) AS sha256 FROM members""")
def archive_each(spark, sf_dir):
    """Every document in the archive whose turn it is, beside a second member."""
    plain, second = F.encode(F.coalesce("text", F.lit("")), "UTF-8"), F.encode(F.concat(F.lit("number "), F.col("doc_id").cast("string")), "UTF-8")
    packed = documents(spark, sf_dir).select(F.col("doc_id").cast("string").alias("path"), containers.archived(plain, second, _nth(containers.ARCHIVES)).alias("content"))
    found = codecs.expand_blobs(packed, codecs.Limits(expansion=10_000)).where("error is null")
    container, member = scalars.split_part(F.col("path"))
    found = found.select(container.cast("long").alias("doc_id"), member.alias("member"), "size", F.sha2("content", 256).alias("sha256"))
    return found.select("doc_id", _nth(containers.ARCHIVES).alias("kind"), "member", "size", "sha256")


# ---- binary formats -----------------------------------------------------------------------------

SECOND = "epoch_us(o_orderdate) // 1000000"


def _timeline(packed):
    found = timeline.file_timeline(packed)
    return found.select("name", "inode", "size", "mode", *[F.unix_seconds(f"{x}_time").alias(x) for x in "macb"], "anomaly")


@query(rf"""SELECT 'C:\orders\' || o_orderkey || '.lnk' AS name, '' AS inode, o_custkey AS size, CASE WHEN o_orderkey % 2 = 1 THEN '-r-xr-xr-x' ELSE '-rwxrwxrwx' END AS mode,
  {SECOND} + 2 AS m, {SECOND} + 1 AS a, CAST(NULL AS BIGINT) AS c, {SECOND} AS b, false AS anomaly FROM orders""")
def timeline_shortcuts(spark, sf_dir):
    rows = spread(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate"))
    name = F.concat(F.lit("C:\\orders\\"), F.col("o_orderkey").cast("string"), F.lit(".lnk"))
    link = containers.shortcut(name, F.col("o_custkey"), F.col("o_orderkey") % 2, F.unix_seconds("o_orderdate"))
    return _timeline(rows.select(F.col("o_orderkey").cast("string").alias("path"), link.alias("content")))


@query(f"""SELECT 'order' || o_orderkey || '.txt' AS name, o_orderkey || '-1' AS inode, o_custkey * 100 AS size, '-rwxrwxrwx' AS mode,
  {SECOND} + 1 AS m, {SECOND} + 3 AS a, {SECOND} + 2 AS c, {SECOND} AS b, o_orderkey % 3 = 0 AS anomaly FROM orders""")
def timeline_file_table(spark, sf_dir):
    """Records of a file table; one in three has times that were set back."""
    rows = spread(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate"))
    name, later = F.concat(F.lit("order"), F.col("o_orderkey").cast("string"), F.lit(".txt")), F.when(F.col("o_orderkey") % 3 == 0, 60).otherwise(-60)
    record = containers.file_record(name, F.col("o_orderkey"), F.col("o_custkey") * 100, F.unix_seconds("o_orderdate"), later)
    return _timeline(rows.select(F.col("o_orderkey").cast("string").alias("path"), record.alias("content")))


@query("""SELECT (CASE WHEN event_id % 2 = 0 THEN epoch_us(ts) ELSE epoch_us(ts) - 5 END) * 1000 AS time_ns, 'host' || (user_id % 10) AS host, CAST(user_id AS VARCHAR) AS "user",
  CASE WHEN event_id % 5 = 0 THEN 'Undescribed event' ELSE event_type || ' by ' || user_id END AS message, CAST(10 - event_id % 8 AS INTEGER) AS severity, CAST(event_id AS VARCHAR) AS sequence,
  'journal' AS source, 'syslog' AS category, CASE WHEN user_id % 7 = 0 THEN 'unknown' ELSE 'service' || (user_id % 3) END AS service, CAST(event_id % 8 AS VARCHAR) AS priority FROM events""")
def journal_events(spark, sf_dir):
    """Every event in a journal of its own, carved behind other bytes; half of them tell their time in a field."""
    rows = spread(read(spark, sf_dir, "events"))
    text = lambda name, value: F.concat(F.lit(f"{name}="), value.cast("string"))
    user, micros = F.col("user_id"), F.unix_micros("ts")
    fields = F.array(
        text("MESSAGE", F.when(F.col("event_id") % 5 == 0, "").otherwise(F.concat("event_type", F.lit(" by "), user.cast("string")))), text("PRIORITY", F.col("event_id") % 8), text("_HOSTNAME", F.concat(F.lit("host"), (user % 10).cast("string"))),
        text("_UID", user), text("_TRANSPORT", F.lit("syslog")), text("_COMM", F.when(user % 7 == 0, "").otherwise(F.concat(F.lit("service"), (user % 3).cast("string")))),
        F.when(F.col("event_id") % 2 == 0, text("_SOURCE_REALTIME_TIMESTAMP", micros)).otherwise(F.lit("OTHER=1")),
    )
    packed = rows.select(F.concat(F.lit(b"before"), containers.journal(fields, F.col("event_id"), micros - 5 * (F.col("event_id") % 2))).alias("content"))
    return evtx.carve_events(packed).select(*ENVELOPE, F.col("fields")["Priority"].alias("priority"))


@query("""SELECT doc_id, 'evtx' AS kind, 3 AS "offset" FROM documents UNION ALL SELECT doc_id, 'journal', 11 + strlen(coalesce(text, '')) FROM documents""")
def carve_offsets(spark, sf_dir):
    """Where a chunk of events and a journal start, with a document between them."""
    data = F.concat(F.lit(b"abcElfChnk\0"), F.encode(F.coalesce("text", F.lit("")), "UTF-8"), F.lit(b"LPKSHHRH"))
    found = binary.carve_offsets(documents(spark, sf_dir).select(F.col("doc_id").cast("string").alias("path"), data.alias("content")))
    return found.select(F.col("path").cast("long").alias("doc_id"), "kind", "offset")


# ---- text formats -------------------------------------------------------------------------------


@query("""SELECT c_custkey, '<?xml version="1.0" ?>' || chr(10) || '<customer>' || chr(10) || '  <name key="' || c_custkey || '">' || c_name || '</name>' || chr(10) || '  <segment>' || c_mktsegment || '</segment>' || chr(10) || '</customer>' AS text FROM customer""")
def xml_layout(spark, sf_dir):
    rows = spread(read(spark, sf_dir, "customer"))
    text = F.concat(F.lit('<?xml version="1.0"?><customer><name key="'), F.col("c_custkey").cast("string"), F.lit('"> '), "c_name", F.lit("\n</name>\n\n<segment>"), "c_mktsegment", F.lit("</segment></customer>"))
    return rows.select("c_custkey", formats.pretty(text).alias("text"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '{"key": ' || c_custkey ELSE '{' || chr(10) || '  "key": ' || c_custkey || ',' || chr(10) || '  "tags": [' || chr(10) || '    "' || c_mktsegment || '"' || chr(10) || '  ]' || chr(10) || '}' END AS text FROM customer""")
def json_layout(spark, sf_dir):
    """One in three is broken and stays as it is."""
    rows = spread(read(spark, sf_dir, "customer"))
    key = F.col("c_custkey").cast("string")
    text = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit('{"key": '), key)).otherwise(F.concat(F.lit('{"key":'), key, F.lit(',"tags":["'), "c_mktsegment", F.lit('"]}')))
    return rows.select("c_custkey", formats.pretty(text).alias("text"))


# ---- strings, limits, statistics ----------------------------------------------------------------


@query(r"""WITH pieces AS (
  SELECT doc_id, regexp_extract_all(text, '[\x20-\x7E]+|[^\x20-\x7E]+') AS parts FROM documents WHERE text IS NOT NULL
), placed AS (
  SELECT doc_id, unnest(parts) AS part, unnest(range(0, len(parts))) AS nth FROM pieces
), starts AS (
  SELECT doc_id, part, coalesce(sum(strlen(part)) OVER (PARTITION BY doc_id ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM placed
), found AS (
  SELECT doc_id, start + length(part) - length(ltrim(part, ' ')) AS "offset", trim(part, ' ') AS value FROM starts WHERE regexp_matches(part, '^[\x20-\x7E]{6,}$')
) SELECT doc_id, CAST("offset" AS BIGINT) AS "offset", lpad(printf('%x', CAST("offset" AS BIGINT)), 8, '0') AS address, value FROM found WHERE value <> ''""")
def str_trimmed(spark, sf_dir):
    """Printable runs with their places in the bytes, blanks at their ends cut off."""
    return strings.carve_bytes(contents(spark, sf_dir), "doc_id", least=6, most=1 << 30, ascii_only=True, trim=True)


LIMITS = {"10": (10, 0), "25b": (25, 0), "1fh": (31, 0), "-20b": (20, 1), "-ah": (10, 1), "3l": (None, 0), "": (None, 0)}


@query(f"""WITH limits(spelled, most, tail) AS (VALUES {", ".join(f"('{k}', {'NULL' if n is None else n}, {t})" for k, (n, t) in LIMITS.items())}),
whole AS (SELECT doc_id, hex(encode(text)) AS digits FROM documents WHERE text IS NOT NULL)
SELECT doc_id, spelled, CASE WHEN most IS NULL THEN md5(digits) WHEN tail = 0 THEN md5(substr(digits, 1, 2 * most)) ELSE md5(right(digits, 2 * CAST(most AS BIGINT))) END AS md5 FROM whole CROSS JOIN limits""")
def limit_grammar(spark, sf_dir):
    """What each spelling of a limit leaves of a document's bytes."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("spelled"), F.md5(F.encode(F.hex(scalars.Limit.parse(k).of_bytes(F.col("content"))), "UTF-8")).alias("md5")) for k in LIMITS]))
    return contents(spark, sf_dir).where("content is not null").select("doc_id", each.alias("x")).select("doc_id", "x.*")


@query(f"""{FILES}, either AS (SELECT doc_id, bytes, entropy FROM info UNION ALL SELECT -doc_id, 0, 0.0 FROM info WHERE doc_id % 10 = 1)
SELECT 'from 0' AS kind, doc_id FROM either WHERE entropy <= 4.0 UNION ALL SELECT 'above', doc_id FROM either WHERE bytes > 0 AND entropy BETWEEN 0.5 AND 8.0""")
def info_empty_files(spark, sf_dir):
    """An empty file counts as entropy 0 and shows in ranges from 0 on only."""
    whole = contents(spark, sf_dir).where("content is not null")
    empty = whole.where("doc_id % 10 = 1").select((-F.col("doc_id")).alias("doc_id"), F.lit(b"").alias("content"))
    told = stats.file_stats(whole.union(empty), "doc_id")
    return stats.in_entropy_range(told, 0.0, 4.0).select(F.lit("from 0").alias("kind"), "doc_id").union(stats.in_entropy_range(told, 0.5, 8.0).select(F.lit("above"), "doc_id"))


@query(f"""{FILES} SELECT doc_id, lpad(CAST(lines AS VARCHAR), 7, ' ') || 'l ' || lpad(CASE WHEN bytes < 1024 THEN bytes || 'b' WHEN bytes < 1048576 THEN printf('%.1f', bytes / 1024.0) || 'k' ELSE printf('%.1f', bytes / 1048576.0) || 'm' END, 7, ' ')
  || '  ' || printf('%.1f', entropy) || 'e [' || repeat('■', CAST(round(entropy * 2) AS BIGINT)) || repeat(' ', 16 - CAST(round(entropy * 2) AS BIGINT)) || ']' AS line FROM info""")
def info_printed(spark, sf_dir):
    told = stats.file_stats(contents(spark, sf_dir), "doc_id").where("bytes is not null")
    return told.select("doc_id", stats.render(F.col("bytes"), F.col("lines"), F.col("entropy")).alias("line"))


# ---- digests ------------------------------------------------------------------------------------


def _unreflected(poly: int) -> list[int]:
    out = []
    for value in range(256):
        value <<= 8
        for _ in range(8):
            value = (value << 1 ^ (poly if value & 0x8000 else 0)) & 0xFFFF
        out.append(value)
    return out


def _crc_sql(poly: int) -> str:
    return f"printf('%08x', xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), b), lambda c, x: xor(c >> 8, {_crc_table(poly)}[CAST(xor(c, x) & 255 AS INTEGER) + 1])), 4294967295))"


@query(f"""WITH bytes AS (
  SELECT doc_id, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: CAST('0x' || x AS BIGINT)) AS b FROM documents WHERE text IS NOT NULL
), sums AS (
  SELECT doc_id, b, coalesce(list_sum(b), 0)::BIGINT AS total, coalesce(list_sum(list_transform(b, lambda x, i: (len(b) - i + 1) * x)), 0)::BIGINT AS weighted FROM bytes
), folded AS (
  SELECT *, total % 65536 + (total % 4294967296) // 65536 AS half FROM sums
)
SELECT doc_id, printf('%08x', ((len(b) + weighted) % 65521) * 65536 + (1 + total) % 65521) AS adler32, lpad(CAST(half % 65536 + half // 65536 AS VARCHAR), 5, '0') AS sysv,
  lpad(CAST(list_reduce(list_prepend(CAST(0 AS BIGINT), b), lambda c, x: ((c >> 1) + ((c & 1) << 15) + x) & 65535) AS VARCHAR), 5, '0') AS bsd, {_crc_sql(0x82F63B78)} AS crc32c, {_crc_sql(0xEB31D82E)} AS crc32k,
  printf('%04x', list_reduce(list_prepend(CAST(65535 AS BIGINT), b), lambda c, x: xor((c << 8) & 65535, {_unreflected(0x1021)}[CAST(xor(c >> 8, x) AS INTEGER) + 1]))) AS crc16
FROM folded""")
def hash_checksums(spark, sf_dir):
    names = {"ADLER32": "adler32", "SYSV": "sysv", "BSD": "bsd", "CRC32-C": "crc32c", "CRC32-K": "crc32k", "CRC16-CCITT": "crc16"}
    each = contents(spark, sf_dir).where("content is not null").select("doc_id", digests.digests(F.col("content"), list(names)).alias("hash"))
    return each.select("doc_id", *[F.col("hash")[n].alias(c) for n, c in names.items()])


@query("SELECT doc_id, name, digest FROM (SELECT doc_id, unnest(['MD5', 'SHA256']) AS name, unnest([md5(text), sha256(text)]) AS digest FROM documents) WHERE regexp_matches(digest, '^0|ff$')")
def hash_regex(spark, sf_dir):
    each = contents(spark, sf_dir).select("doc_id", digests.matching(digests.digests(F.col("content"), ["MD5", "SHA256"]), "^0|ff$").alias("hash"))
    return each.select("doc_id", F.explode("hash").alias("name", "digest"))


@query("""WITH hashed AS (SELECT doc_id, CASE WHEN doc_id % 4 > 0 THEN sha256(text) END AS sha256 FROM documents)
SELECT 'no list' AS kind, doc_id FROM hashed UNION ALL SELECT 'good', doc_id FROM hashed WHERE sha256 <> 'none'""")
def hash_empty(spark, sf_dir):
    """Files without a digest stay where there is no list, and go where there is one."""
    hashed = contents(spark, sf_dir).select("doc_id", F.when(F.col("doc_id") % 4 > 0, F.sha2("content", 256)).alias("sha256"))
    listed = spark.createDataFrame([("none",)], "digest string")
    return digests.chosen(hashed, "sha256").select(F.lit("no list").alias("kind"), "doc_id").union(digests.chosen(hashed, "sha256", good=listed).select(F.lit("good"), "doc_id"))


# ---- sinks --------------------------------------------------------------------------------------


@query(f"WITH {EVENTS} SELECT {ENVELOPE_SQL} FROM events_norm WHERE {CRITICAL}")
def sink_parquet(spark, sf_dir):
    """A hunt given to two sinks, one of which fails, and read back from the other."""

    def broken(rows):
        raise OSError("no such collector")

    folder = f"{shared_folder(spark)}/results-{uuid.uuid4().hex}"
    written, error = sinks.fan_out(hunt(hunted(spark, sf_dir)).select(*ENVELOPE), [lambda rows: sinks.write_parquet(rows, folder), broken])
    if not isinstance(error, OSError) or isinstance(written, Exception):
        raise AssertionError("a sink's failure must be its own")
    return spark.read.parquet(written)
