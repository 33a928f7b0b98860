"""The registered queries, each with the SQL that DuckDB runs on the same tables, where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classes, digests, scalars
from ..operators import directory, events, hexdump, lines, render, stats, strings, timeline
from ..sources import blobs, codecs, formats
from ..sources.tables import read, spread
from . import sigma
from .hunt import hunt, normalise

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name, with its SQL."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spread(read(spark, sf_dir, "documents").select(*(columns or ("doc_id", "text"))))


def contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.encode("text", "UTF-8").alias("content"))


def hunted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalise(spread(read(spark, sf_dir, "events")))


# ---- SQL that several queries share -------------------------------------------------------------

EVENTS = """
events_norm AS (
  SELECT ts AS time, epoch_us(ts) * 1000 AS time_ns, 'host' || (user_id % 10) AS host, 'user' || user_id AS usr,
    event_type || ' by ' || user_id AS message,
    CASE event_type WHEN 'error' THEN 10 WHEN 'purchase' THEN 8 WHEN 'signup' THEN 6 WHEN 'click' THEN 3 ELSE 1 END AS severity,
    CAST(user_id AS VARCHAR) AS sequence, 'eventlog' AS source, event_type AS category,
    CASE WHEN user_id % 7 = 0 THEN 'unknown' ELSE 'service' || (user_id % 3) END AS service,
    json_extract_string(props, '$.k') AS k, '46' || lpad(json_extract_string(props, '$.k'), 2, '0') AS event_id
  FROM events
)"""
IDS = ", ".join(f"'{x}'" for x in sigma.CRITICAL_EVENT_IDS)
CRITICAL = f"event_id IN ({IDS})"

LINES = r"""
split AS (
  SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL
), kept AS (
  SELECT doc_id, CASE WHEN parts[-1] = '' THEN parts[:-2] ELSE parts END AS parts FROM split
), lines AS (
  SELECT doc_id, unnest(range(1, len(parts) + 1)) AS line, regexp_replace(unnest(parts), '\r$', '') AS text FROM kept
)"""

# ---- hunt ---------------------------------------------------------------------------------------

ENVELOPE = ["time_ns", "host", "user", "message", "severity", "sequence", "source", "category", "service"]
ENVELOPE_SQL = 'time_ns, host, usr AS "user", message, severity, sequence, source, category, service'


@query(f"WITH {EVENTS} SELECT {ENVELOPE_SQL}, event_id FROM events_norm WHERE {CRITICAL}")
def hunt_critical(spark, sf_dir):
    return hunt(hunted(spark, sf_dir)).select(*ENVELOPE, F.col("fields")["EventID"].alias("event_id"))


@query(f"WITH {EVENTS} SELECT {ENVELOPE_SQL} FROM events_norm")
def hunt_all(spark, sf_dir):
    return hunt(hunted(spark, sf_dir), rule=None).select(*ENVELOPE)


RANGE = (1_704_844_800_000_000_000, 1_705_449_600_000_000_000)


@query(f"WITH {EVENTS} SELECT {ENVELOPE_SQL} FROM events_norm WHERE {CRITICAL} AND time_ns BETWEEN {RANGE[0]} AND {RANGE[1]}")
def hunt_time_range(spark, sf_dir):
    return hunt(hunted(spark, sf_dir), least_ns=RANGE[0], most_ns=RANGE[1]).select(*ENVELOPE)


@query(f"""WITH {EVENTS}, numbered AS (
  SELECT *, row_number() OVER (PARTITION BY host, message, sequence ORDER BY time_ns) AS nth FROM events_norm
) SELECT {ENVELOPE_SQL}, event_id FROM numbered WHERE nth = 1 AND {CRITICAL}""")
def hunt_uniq_then_filter(spark, sf_dir):
    return hunt(hunted(spark, sf_dir), unique=True).select(*ENVELOPE, F.col("fields")["EventID"].alias("event_id"))


@query(f"""WITH {EVENTS}, numbered AS (
  SELECT *, row_number() OVER (PARTITION BY host, message, sequence ORDER BY time_ns) AS nth FROM events_norm
) SELECT strftime(time, '%Y-%m-%dT%H:%M:%S.%fZ') || ' ' || usr || '@' || host || ' [' || lpad(sequence, 8, '0') || '] ' || category || ': ' || message AS triage
FROM numbered WHERE nth = 1 AND {CRITICAL} ORDER BY time_ns""")
def hunt_sorted_triage(spark, sf_dir):
    return hunt(hunted(spark, sf_dir), unique=True, order=True).select(render.triage().alias("triage"))


@query(f"""WITH {EVENTS} SELECT strftime(time, '%b %d %Y %H:%M:%S.%g') || ' ' || host || ' CEF:1|{render.VENDOR}|{render.PRODUCT}|{render.VERSION}|100|' || message || '|' || severity
  || '|EventID=' || event_id || ' EventType=' || category || ' k=' || k AS cef FROM events_norm WHERE {CRITICAL}""")
def hunt_cef(spark, sf_dir):
    return hunt(hunted(spark, sf_dir)).select(render.cef().alias("cef"))


JSON_SQL = """'{"time":"' || strftime(time, '%Y-%m-%dT%H:%M:%S.%fZ') || '","host":"' || host || '","user":"' || usr || '","message":"' || message || '","severity":' || severity
  || ',"sequence":"' || sequence || '","source":"eventlog","category":"' || category || '","service":"' || service
  || '","fields":{"EventID":"' || event_id || '","EventType":"' || category || '","k":"' || k || '"}}'"""


@query(f"WITH {EVENTS} SELECT {JSON_SQL} AS json FROM events_norm WHERE {CRITICAL}")
def hunt_jsonl(spark, sf_dir):
    return hunt(hunted(spark, sf_dir)).select(render.json_line().alias("json"))


@query(f"""WITH {EVENTS} SELECT epoch_us(time) // 1000 AS time, host, '{render.PRODUCT} {render.VERSION}' AS source, '_json' AS sourcetype, 'main' AS index, event_id, message,
  CASE WHEN severity >= 9 THEN 'CRITICAL' WHEN severity >= 7 THEN 'HIGH' WHEN severity >= 4 THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM events_norm""")
def hunt_hec(spark, sf_dir):
    entry = hunted(spark, sf_dir).select(render.hec().alias("e"))
    return entry.select("e.time", "e.host", "e.source", "e.sourcetype", "e.index", F.col("e.fields")["EventID"].alias("event_id"), "e.event.message", "e.event.severity")


@query(f"""WITH {EVENTS} SELECT '{render.ECS_VERSION}' AS version, '{render.PRODUCT}' AS agent, host, usr AS "user", sequence AS id, 'event' AS kind, source AS module,
  source || '.' || category AS dataset, CAST(severity AS BIGINT) AS severity, service AS provider, event_id AS code, {JSON_SQL} AS original,
  strftime(time, '%Y-%m-%dT%H:%M:%S.%fZ') AS stamp, message FROM events_norm""")
def hunt_ecs(spark, sf_dir):
    doc = hunted(spark, sf_dir).select(render.ecs().alias("e"))
    return doc.select(
        F.col("e.ecs.version").alias("version"), F.col("e.agent.type").alias("agent"), F.col("e.host.hostname").alias("host"), F.col("e.user.id").alias("user"), F.col("e.event.id").alias("id"),
        F.col("e.event.kind").alias("kind"), F.col("e.event.module").alias("module"), F.col("e.event.dataset").alias("dataset"), F.col("e.event.severity").alias("severity"),
        F.col("e.event.provider").alias("provider"), F.col("e.event.code").alias("code"), F.col("e.event.original").alias("original"), F.col("e")["@timestamp"].alias("stamp"), F.col("e.message").alias("message"),
    )


@query(f"WITH {EVENTS} SELECT severity, count(*) AS n FROM events_norm GROUP BY severity")
def hunt_severity_histogram(spark, sf_dir):
    return hunted(spark, sf_dir).groupBy("severity").agg(F.count("*").alias("n"))


@query(f"WITH {EVENTS} SELECT count(*) AS n FROM events_norm WHERE {CRITICAL}")
def hunt_count(spark, sf_dir):
    return hunt(hunted(spark, sf_dir)).agg(F.count("*").alias("n"))


TEMPLATES = [("service0", 4624, "An account was logged on"), ("service1", 4625, "An account failed to log on from $1 by $2"), ("service2", 4672, "Privileges were assigned"), ("unknown", 4688, "A process was created")]
TEMPLATES_SQL = ", ".join(f"('{a}', {b}, '{c}')" for a, b, c in TEMPLATES)


@query(f"""WITH {EVENTS}, templates(service, id, template) AS (VALUES {TEMPLATES_SQL})
SELECT time_ns, e.service, event_id, coalesce(template, 'Undescribed event: ' || event_id) AS message
FROM events_norm e LEFT JOIN templates t ON e.service = t.service AND CAST(e.event_id AS BIGINT) = t.id""")
def hunt_message_translate(spark, sf_dir):
    table = spark.createDataFrame(TEMPLATES, "service string, event_id long, template string")
    told = events.translate(hunted(spark, sf_dir), table, F.col("fields")["EventID"])
    return told.select("time_ns", "service", F.col("fields")["EventID"].alias("event_id"), "message")


@query("""SELECT event_id, CASE WHEN event_type IS NULL THEN 'by $1 as $2 and $4, $10 kept'
  ELSE 'by ' || user_id || ' as ' || event_type || ' and $4, $10 kept' END AS message FROM events""")
def hunt_param_expand(spark, sf_dir):
    rows = spread(read(spark, sf_dir, "events").select("event_id", "user_id", "event_type"))
    fields = F.create_map(F.lit("param1"), F.col("user_id").cast("string"), F.lit("param2"), F.col("event_type"), F.lit("param4"), F.lit("behind the gap"))
    return rows.select("event_id", events.expand_params(F.lit("by $1 as $2 and $4, $10 kept"), fields).alias("message"))


TITLED = ["_SOURCE_REALTIME_TIMESTAMP", "PRIORITY", "syslog_identifier", "__CURSOR"]


@query(f"""WITH names(name) AS (VALUES {", ".join(f"('{x}')" for x in TITLED)}), spelt AS (
  SELECT event_id, name, list_transform(string_split(regexp_replace(name || '_' || upper(event_type), '^_', ''), '_'), lambda w: concat(upper(w[1]), lower(w[2:]))) AS words FROM events, names
) SELECT event_id, name, array_to_string(words, '') AS title FROM spelt""")
def hunt_field_titlecase(spark, sf_dir):
    rows = spread(read(spark, sf_dir, "events").select("event_id", "event_type"))
    named = rows.select("event_id", F.explode(F.array(*map(F.lit, TITLED))).alias("name"), "event_type")
    return named.select("event_id", "name", scalars.title_key(F.concat("name", F.lit("_"), F.upper("event_type"))).alias("title"))


@query("""SELECT event_id, CASE WHEN k IS NULL THEN 0 WHEN k <= 7 THEN 10 - k ELSE 10 END AS severity
FROM (SELECT event_id, CASE WHEN event_type = 'view' THEN NULL ELSE CAST(json_extract_string(props, '$.k') AS INTEGER) % 12 END AS k FROM events)""")
def journal_severity(spark, sf_dir):
    k = F.when(F.col("event_type") != "view", F.get_json_object("props", "$.k").cast("int") % 12)
    return spread(read(spark, sf_dir, "events")).select("event_id", events.journal_severity(k).alias("severity"))


@query("""SELECT event_id, (116444736000000000 + epoch_us(ts) * 10 - 116444736000000000) * 100 AS ns FROM events""")
def filetime_to_ns(spark, sf_dir):
    value = F.lit(116_444_736_000_000_000) + F.unix_micros("ts") * 10
    return spread(read(spark, sf_dir, "events")).select("event_id", scalars.filetime_ns(value).alias("ns"))


# ---- rules --------------------------------------------------------------------------------------

MODIFIERS = """
title: modifiers
detection:
  typed:
    EventType|startswith: pur
    k|gte: 50
  ended:
    EventType|endswith: OR
    EventID|re: ^46[0-4]
  wild:
    EventType: s?gn*
    message|contains|all: [by, '1']
  condition: typed or ended or wild
"""


@query(f"""WITH {EVENTS} SELECT time_ns, message, event_id FROM events_norm WHERE (category LIKE 'pur%' AND CAST(k AS INTEGER) >= 50)
OR (category LIKE '%or' AND regexp_matches(event_id, '^46[0-4]')) OR (category LIKE 's_gn%' AND contains(message, 'by') AND contains(message, '1'))""")
def sigma_modifiers(spark, sf_dir):
    return hunt(hunted(spark, sf_dir), MODIFIERS).select("time_ns", "message", F.col("fields")["EventID"].alias("event_id"))


NOT_MISSING = "{title: missing, detection: {all_of_them: {source: eventlog}, gone: {NoSuchField: 1}, views: {eventtype: VIEW}, condition: all_of_them and not gone and not views}}"


@query(f"WITH {EVENTS} SELECT time_ns, message FROM events_norm WHERE category <> 'view'")
def sigma_not_missing(spark, sf_dir):
    return hunt(hunted(spark, sf_dir), NOT_MISSING).select("time_ns", "message")


N_OF = "{title: n of, detection: {low: {severity_not_a_field|exists: false, k|lt: 20}, odd: {EventID|endswith: ['1', '3', '5', '7', '9']}, kind_a: {EventType: error}, kind_b: {EventType: click}, condition: 1 of kind_* and (all of low or 2 of them)}}"


@query(f"""WITH {EVENTS}, flags AS (
  SELECT *, CAST(k AS INTEGER) < 20 AS low, CAST(event_id AS INTEGER) % 2 = 1 AS odd, category = 'error' AS a, category = 'click' AS b FROM events_norm
) SELECT time_ns, message FROM flags WHERE (a OR b) AND (low OR CAST(low AS INTEGER) + CAST(odd AS INTEGER) + CAST(a AS INTEGER) + CAST(b AS INTEGER) >= 2)""")
def sigma_n_of(spark, sf_dir):
    return hunt(hunted(spark, sf_dir), N_OF).select("time_ns", "message")


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'license') OR contains(lower(text), 'token')")
def sigma_keywords(spark, sf_dir):
    match = sigma.compile_rule({"detection": {"words": ["license", "TOKEN"], "condition": "words"}}, lookup=F.col)
    return documents(spark, sf_dir).withColumn("message", F.col("text")).where(match).select("doc_id")


@query(f"""WITH {EVENTS}, templates(service, id, template) AS (VALUES {TEMPLATES_SQL})
SELECT epoch_us(e.time) * 1000 AS time_ns, e.service, event_id, CASE WHEN template IS NULL THEN 'Undescribed event: ' || CAST(event_id AS BIGINT) ELSE replace(replace(template, '$1', usr), '$2', k) END AS message, severity
FROM events_norm e LEFT JOIN templates t ON e.service = t.service AND CAST(e.event_id AS BIGINT) = t.id""")
def hunt_carved_messages(spark, sf_dir):
    """Records as they are carved from event logs, their messages told by templates with parameters."""
    from ..sources import evtx

    rows = hunted(spark, sf_dir)
    level = F.when(F.col("category") == "error", "1").when(F.col("category") == "purchase", "2").when(F.col("category") == "signup", "3").when(F.col("category") == "click", "4").otherwise("5")
    service = F.when(F.col("service") == "unknown", "").otherwise(F.col("service"))
    fields = F.create_map(*[x for n, v in (("EventID", F.col("fields")["EventID"]), ("Level", level), ("ProviderName", service), ("param1", F.col("user")), ("param2", F.col("fields")["k"])) for x in (F.lit(n), v)])
    table = spark.createDataFrame(TEMPLATES, "service string, event_id long, template string")
    told = evtx.normalise(rows.select("source", "time_ns", "sequence", fields.alias("fields")), table)
    return told.select("time_ns", "service", F.col("fields")["EventID"].alias("event_id"), "message", "severity")


# ---- lines --------------------------------------------------------------------------------------


@query(f"WITH {LINES} SELECT doc_id, line, text FROM lines")
def lines_number(spark, sf_dir):
    return lines.number_lines(documents(spark, sf_dir), "doc_id")


@query(f"WITH {LINES} SELECT doc_id, line, text FROM lines WHERE contains(text, 'der')")
def grep_lines(spark, sf_dir):
    return lines.grep(lines.number_lines(documents(spark, sf_dir), "doc_id"), "der")


CONTEXT = f"""WITH {LINES}, hits AS (
  SELECT doc_id, line AS hit, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS grp FROM lines WHERE contains(text, 'der')
), context AS (
  SELECT l.doc_id, h.grp, l.line, l.text FROM hits h JOIN lines l ON l.doc_id = h.doc_id AND l.line BETWEEN h.hit - 1 AND h.hit + 1
)"""


@query(f"{CONTEXT} SELECT doc_id, grp, line, text FROM context")
def grep_context(spark, sf_dir):
    return lines.grep_context(documents(spark, sf_dir), "doc_id", "der", 1, 1)


@query(f"{CONTEXT} SELECT doc_id, grp, line, coalesce(lag(grp) OVER (PARTITION BY doc_id ORDER BY grp, line) <> grp, false) AS starts_group FROM context")
def grep_context_sep(spark, sf_dir):
    found = lines.grep_context(documents(spark, sf_dir), "doc_id", "der", 1, 1)
    return lines.mark_groups(found, "doc_id").select("doc_id", "grp", "line", "starts_group")


@query(f"WITH {LINES} SELECT text, min((doc_id, line))[1] AS doc_id, min((doc_id, line))[2] AS line FROM lines GROUP BY text")
def lines_uniq(spark, sf_dir):
    return lines.first_of_each(lines.number_lines(documents(spark, sf_dir), "doc_id"), "text", "doc_id", "line")


@query(f"WITH {LINES} SELECT doc_id, line, text FROM lines WHERE line <= 3")
def head_lines(spark, sf_dir):
    return lines.head_lines(lines.number_lines(documents(spark, sf_dir), "doc_id"), 3)


@query(f"WITH {LINES} SELECT doc_id, line, text FROM (SELECT *, max(line) OVER (PARTITION BY doc_id) AS last FROM lines) WHERE line > last - 2")
def tail_lines(spark, sf_dir):
    return lines.tail_lines(documents(spark, sf_dir), "doc_id", 2)


@query(f"WITH {LINES} SELECT doc_id, line, lpad(CAST(line AS VARCHAR), CAST(length(CAST(max(line) OVER (PARTITION BY doc_id) AS VARCHAR)) AS INTEGER), '0') AS number FROM lines")
def pad_line_numbers(spark, sf_dir):
    return lines.padded_lines(documents(spark, sf_dir), "doc_id").select("doc_id", "line", "number")


@query("SELECT doc_id, substr(hex(encode(text)), 1, 62) AS head FROM documents WHERE text IS NOT NULL")
def head_bytes(spark, sf_dir):
    return lines.limit_bytes(contents(spark, sf_dir), scalars.Limit.parse("1fh")).select("doc_id", F.hex("content").alias("head"))


@query("SELECT doc_id, right(hex(encode(text)), 40) AS tail FROM documents WHERE text IS NOT NULL")
def tail_bytes(spark, sf_dir):
    return lines.limit_bytes(contents(spark, sf_dir), scalars.Limit.parse("-20b")).select("doc_id", F.hex("content").alias("tail"))


# ---- hex dumps ----------------------------------------------------------------------------------

HEX = """
raw AS (
  SELECT doc_id, lower(hex(encode(repeat('U', 64) || text))) AS digits FROM documents WHERE text IS NOT NULL
), rows AS (
  SELECT doc_id, unnest(range(0, length(digits) // 2, 16)) AS "offset", substr(digits, 2 * unnest(range(0, length(digits) // 2, 16)) + 1, 32) AS chunk FROM raw
)"""


def dumped(spark, sf_dir, before=0):
    data = documents(spark, sf_dir).select("doc_id", F.encode(F.concat(F.lit("U" * 64), "text"), "UTF-8").alias("content"))
    return hexdump.rows_of(data, "doc_id", before=before)


@query(f"WITH {HEX} SELECT doc_id, \"offset\", regexp_replace(chunk, '(..)', '\\1 ', 'g') AS values FROM rows")
def hexdump_raw(spark, sf_dir):
    return hexdump.plain(dumped(spark, sf_dir)).select("doc_id", "offset", "values")


@query(f"""WITH {HEX}, spaced AS (
  SELECT doc_id, "offset", chunk, regexp_replace(substr(chunk, 1, 16), '(..)', '\\1 ', 'g') AS a, regexp_replace(substr(chunk, 17), '(..)', '\\1 ', 'g') AS b FROM rows
) SELECT doc_id, printf('%08x', "offset") AS address,
  rpad(a || CASE WHEN length(chunk) >= 16 THEN ' ' ELSE '' END || b || CASE WHEN length(chunk) = 32 THEN ' ' ELSE '' END, 50, ' ') AS values FROM spaced""")
def hexdump_pretty(spark, sf_dir):
    return hexdump.pretty(dumped(spark, sf_dir)).select("doc_id", "address", "values")


@query(f"""WITH {HEX}, before AS (
  SELECT doc_id, "offset", chunk, lag(chunk, 1) OVER w AS one, lag(chunk, 2) OVER w AS two FROM rows WINDOW w AS (PARTITION BY doc_id ORDER BY "offset")
) SELECT doc_id, "offset", CASE WHEN coalesce(chunk = one, false) THEN '*' ELSE regexp_replace(chunk, '(..)', '\\1 ', 'g') END AS values
FROM before WHERE NOT (coalesce(chunk = one, false) AND coalesce(one = two, false))""")
def hexdump_squeeze(spark, sf_dir):
    return hexdump.squeeze(hexdump.plain(dumped(spark, sf_dir, 2))).select("doc_id", "offset", "values")


@query(f"""WITH {HEX}, spelt AS (SELECT doc_id, "offset", regexp_replace(chunk, '(..)', '\\1 ', 'g') AS values FROM rows)
SELECT * FROM spelt WHERE contains(values, '65 72 20 ')""")
def hex_row_regex(spark, sf_dir):
    return hexdump.grep(hexdump.plain(dumped(spark, sf_dir)), "65 72 20 ").select("doc_id", "offset", "values")


# ---- text as displayed --------------------------------------------------------------------------


@query("SELECT doc_id, replace(text, ' ', '×') AS text FROM documents")
def sanitize_bidi(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", scalars.sanitize(F.replace("text", F.lit(" "), F.lit("\u202e"))).alias("text"))


@query("SELECT doc_id, replace(text, ' ', '  ') AS text FROM documents")
def tab_expand(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", scalars.expand_tabs(F.replace("text", F.lit(" "), F.lit("\t"))).alias("text"))


# ---- strings ------------------------------------------------------------------------------------

CARVED = r"""
runs AS (
  SELECT doc_id, regexp_extract_all(text, '[\x20-\x7E]{%d,}') AS runs FROM documents WHERE text IS NOT NULL
)"""


@query(f"WITH {CARVED % 6} SELECT doc_id, unnest(range(1, len(runs) + 1)) AS nth, unnest(runs) AS value FROM runs")
def str_ascii_carve(spark, sf_dir):
    return strings.carve_text(documents(spark, sf_dir), "doc_id", least=6, most=1 << 30)


@query(f"""WITH {CARVED % 6}, cut AS (
  SELECT doc_id, list_filter(flatten(list_transform(runs, lambda r: list_transform(range(1, length(r) + 1, 8), lambda a: substr(r, a, 8)))), lambda p: length(p) >= 6) AS pieces FROM runs
) SELECT doc_id, unnest(range(1, len(pieces) + 1)) AS nth, unnest(pieces) AS value FROM cut""")
def str_minmax_chunks(spark, sf_dir):
    return strings.carve_text(documents(spark, sf_dir), "doc_id", least=6, most=8)


@query(f"WITH {CARVED % 6}, found AS (SELECT doc_id, unnest(range(1, len(runs) + 1)) AS nth, unnest(runs) AS value FROM runs) SELECT doc_id, nth, value FROM found WHERE regexp_matches(value, '[0-9]{{3}}')")
def str_regex(spark, sf_dir):
    found = strings.carve_text(documents(spark, sf_dir), "doc_id", least=6, most=1 << 30)
    return found.where(F.rlike("value", F.lit("[0-9]{3}")))


@query(r"WITH found AS (SELECT page_id, unnest(regexp_extract_all(html, '[\x20-\x7E]{12,}')) AS value FROM pages) SELECT page_id, value FROM found ORDER BY value, page_id")
def str_sorted(spark, sf_dir):
    pages = spread(read(spark, sf_dir, "pages").select("page_id", "html"))
    found = strings.carve_text(pages, "page_id", "html", least=12, most=1 << 30)
    return found.orderBy("value", "page_id").select("page_id", "value")


#: One string for each class that the tables' own text hardly shows.
SAMPLES = [
    "fd12:3456:789a:0001:0002:00ff:fe00:0042", "192.0.2.4", "0a:1b:2c:3d:4e:5f", "files.archive.example", "someone@mail.example", r"\\depot\team\notes.doc", "http://archive.example/list?page=2#end", "3f2a9c1e-7b64-4d0f-9a58-c2e1d4b7a690",
    "S-1-5-21-1410065408-2115098112-1000000007-1001", "111111-222222-333333-444444-555555-666666-077777-088888", r"HKEY_CURRENT_USER\Software\Example\Settings", r"D:\Data\Reports\2024",
    "1" + "B" * 30, "Wms" + "h" * 94, "2A" + "i" * 93, "D" + "j" * 94, "X" + "k" * 33, "6" + "m" * 94, "4A" + "n" * 93, "Sumoo" + "o" * 94, "5500 0000 0000 0004", "", "nothing special", "::2", "c\\d", "@", "4A" + "p" * 104,
]


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strings_sql(level: int) -> str:
    """Lines, URLs and samples with the names of the classes that each matches."""
    tests = ", ".join(f"CASE WHEN regexp_matches(value, {_quote(p)}) THEN {_quote(n)} END" for n, p in classes.table(level))
    samples = ", ".join(f"({k}, {_quote(x)})" for k, x in enumerate(SAMPLES))
    return f"""WITH {LINES}, strings AS (
  SELECT 'line' AS kind, doc_id AS id, line AS nth, text AS value FROM lines
  UNION ALL SELECT 'url', page_id, 0, url FROM pages
  UNION ALL SELECT 'sample', column0, 0, column1 FROM (VALUES {samples}) AS v(column0, column1)
), classified AS (
  SELECT kind, id, nth, value, list_filter([{tests}], lambda x: x IS NOT NULL) AS classes FROM strings
)"""


def classified(spark, sf_dir, level):
    text = lines.number_lines(documents(spark, sf_dir), "doc_id").select(F.lit("line").alias("kind"), F.col("doc_id").alias("id"), F.col("line").alias("nth"), F.col("text").alias("value"))
    urls = read(spark, sf_dir, "pages").select(F.lit("url"), "page_id", F.lit(0).cast("long"), "url")
    samples = spark.createDataFrame([("sample", k, 0, x) for k, x in enumerate(SAMPLES)], "kind string, id long, nth long, value string")
    return strings.with_classes(text.union(urls).union(samples), level)


@query(f"{strings_sql(1)} SELECT kind, id, nth, array_to_string(classes, ' ') AS classes FROM classified")
def str_classify_l1(spark, sf_dir):
    return classified(spark, sf_dir, 1).select("kind", "id", "nth", F.array_join("classes", " ").alias("classes"))


@query(f"{strings_sql(2)} SELECT kind, id, nth, array_to_string(classes, ' ') AS classes FROM classified")
def str_classify_l2(spark, sf_dir):
    return classified(spark, sf_dir, 2).select("kind", "id", "nth", F.array_join("classes", " ").alias("classes"))


@query(f"{strings_sql(3)} SELECT kind, id, nth, value, array_to_string(classes, ' ') AS classes FROM classified WHERE list_contains(classes, 'Mail') OR list_contains(classes, 'IPv4') OR list_contains(classes, 'SHA-1')")
def str_class_filter(spark, sf_dir):
    found = classified(spark, sf_dir, 3)
    return found.where(classes.has_class(F.col("classes"), "mail", "IPV4", "sha-1")).select("kind", "id", "nth", "value", F.array_join("classes", " ").alias("classes"))


@query(f"{strings_sql(2)} SELECT class, count(*) AS n FROM (SELECT unnest(classes) AS class FROM classified) GROUP BY class")
def class_histogram(spark, sf_dir):
    return classified(spark, sf_dir, 2).select(F.explode("classes").alias("class")).groupBy("class").agg(F.count("*").alias("n"))


# ---- statistics ---------------------------------------------------------------------------------


def entropy_sql(source: str, key: str) -> str:
    """Entropy by byte of hexadecimal ``digits``, cut off after six decimals."""
    return f"""bytes AS (
  SELECT {key}, unnest(regexp_extract_all(digits, '..')) AS byte FROM {source}
), counted AS (
  SELECT {key}, byte, count(*) AS n FROM bytes GROUP BY ALL
), shares AS (
  SELECT {key}, n / sum(n) OVER (PARTITION BY {key}) AS share FROM counted
), entropies AS (
  SELECT {key}, floor(-sum(share * log2(share)) * 1e6 + 1e-3) / 1e6 AS entropy FROM shares GROUP BY ALL
)"""


FILES = f"""WITH raw AS (SELECT doc_id, hex(encode(text)) AS digits, text FROM documents WHERE text IS NOT NULL), {entropy_sql('raw', 'doc_id')},
info AS (
  SELECT r.doc_id, length(digits) // 2 AS bytes, length(text) - length(replace(text, chr(10), '')) AS lines, CAST(0 AS BIGINT) AS "offset", coalesce(entropy, 0.0) AS entropy, false AS is_block
  FROM raw r LEFT JOIN entropies e ON r.doc_id = e.doc_id
)"""


@query(f"{FILES} SELECT * FROM info")
def info_files(spark, sf_dir):
    return stats.file_stats(contents(spark, sf_dir), "doc_id").where("bytes is not null")


@query(f"""WITH whole AS (SELECT doc_id, hex(encode(text)) AS digits FROM documents WHERE text <> ''), raw AS (
  SELECT doc_id, unnest(range(0, length(digits) // 2, 1024)) AS "offset", substr(digits, 2 * unnest(range(0, length(digits) // 2, 1024)) + 1, 2048) AS digits FROM whole
), {entropy_sql('raw', 'doc_id, "offset"')}
SELECT r.doc_id, length(digits) // 2 AS bytes, len(list_filter(regexp_extract_all(digits, '..'), lambda b: b = '0A')) AS lines, r."offset", entropy, true AS is_block
FROM raw r JOIN entropies e ON r.doc_id = e.doc_id AND r."offset" = e."offset" """)
def info_blocks(spark, sf_dir):
    return stats.block_stats(contents(spark, sf_dir), "doc_id", scalars.mechanize("1k"))


@query(f"{FILES} SELECT doc_id, entropy FROM info WHERE entropy BETWEEN 3.9 AND 4.1 AND bytes > 0")
def info_entropy_range(spark, sf_dir):
    return stats.in_entropy_range(stats.file_stats(contents(spark, sf_dir), "doc_id"), 3.9, 4.1).select("doc_id", "entropy")


@query(f"{FILES} SELECT doc_id, lpad(CAST(lines AS VARCHAR), 7, ' ') || 'l ' AS head FROM info WHERE regexp_matches(CAST(lines AS VARCHAR) || 'l ', '1[0-9]l ')")
def output_regex(spark, sf_dir):
    """The statistics whose printed line holds two digits of lines with a 1 first."""
    info = stats.file_stats(contents(spark, sf_dir), "doc_id").where("bytes is not null")
    printed = stats.render(F.col("bytes"), F.col("lines"), F.col("entropy"))
    return render.output_match(info.withColumn("printed", printed), F.col("printed"), "1[0-9]l ").select("doc_id", F.regexp_extract("printed", "^ *[0-9]+l ", 0).alias("head"))


@query("""SELECT doc_id, CASE WHEN n < 1024 THEN CAST(n AS VARCHAR) || 'b' WHEN n < 1048576 THEN printf('%.1f', n / 1024.0) || 'k' WHEN n < 1073741824 THEN printf('%.1f', n / 1048576.0) || 'm'
  ELSE printf('%.1f', n / 1073741824.0) || 'g' END AS size FROM (SELECT doc_id, n_chars * 64 AS n FROM documents)""")
def humanize_sizes(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", scalars.humanize(F.col("n_chars") * 64).alias("size"))


# ---- digests ------------------------------------------------------------------------------------


@query("SELECT doc_id, md5(text) AS md5 FROM documents")
def hash_md5(spark, sf_dir):
    return contents(spark, sf_dir).select("doc_id", F.md5("content").alias("md5"))


@query("SELECT doc_id, sha1(text) AS sha1 FROM documents")
def hash_sha1(spark, sf_dir):
    return contents(spark, sf_dir).select("doc_id", F.sha1("content").alias("sha1"))


@query("SELECT doc_id, sha256(text) AS sha256 FROM documents")
def hash_sha256(spark, sf_dir):
    return contents(spark, sf_dir).select("doc_id", F.sha2("content", 256).alias("sha256"))


@query("SELECT doc_id, unnest(['MD5', 'SHA1', 'SHA256']) AS name, unnest([md5(text), sha1(text), sha256(text)]) AS digest FROM documents")
def hash_map(spark, sf_dir):
    each = contents(spark, sf_dir).select("doc_id", digests.digests(F.col("content"), ["md5", "sha1", "sha256"]).alias("hash"))
    return each.select("doc_id", F.explode("hash").alias("name", "digest"))


def _crc_table(poly: int = 0xEDB88320) -> list[int]:
    """What each byte does to a CRC-32 with a reflected polynomial."""
    out = []
    for value in range(256):
        for _ in range(8):
            value = value >> 1 ^ (poly if value & 1 else 0)
        out.append(value)
    return out


@query(f"""WITH bytes AS (
  SELECT doc_id, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: CAST('0x' || x AS BIGINT)) AS b FROM documents
) SELECT doc_id, printf('%08x', xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), b), lambda c, x: xor(c >> 8, {_crc_table()}[CAST(xor(c, x) & 255 AS INTEGER) + 1])), 4294967295)) AS crc32 FROM bytes""")
def hash_crc32(spark, sf_dir):
    return contents(spark, sf_dir).select("doc_id", digests.digests(F.col("content"), ["CRC32-IEEE"])["CRC32-IEEE"].alias("crc32"))


@query()
def hash_families(spark, sf_dir):
    names = ["SHA3-256", "BLAKE2B-256", "RIPEMD-160", "XXH64", "XXH3", "ADLER32", "FLETCHER4", "SHAKE128", "SM3"]
    each = contents(spark, sf_dir).select("doc_id", digests.digests(F.col("content"), names).alias("hash"))
    return each.select("doc_id", F.explode("hash").alias("name", "digest"))


def toxic_digests(spark, sf_dir):
    bad = read(spark, sf_dir, "labels").where("toxic = 1").select("doc_id")
    return contents(spark, sf_dir).join(bad, "doc_id").select(F.sha2("content", 256).alias("digest"))


@query("SELECT doc_id, sha256(text) AS sha256 FROM documents WHERE sha256(text) IN (SELECT sha256(d.text) FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE l.toxic = 1)")
def hash_include(spark, sf_dir):
    return digests.known_bad(hash_sha256(spark, sf_dir), "sha256", toxic_digests(spark, sf_dir))


@query("SELECT doc_id, sha256(text) AS sha256 FROM documents WHERE sha256(text) NOT IN (SELECT sha256(d.text) FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE l.toxic = 1 AND d.text IS NOT NULL)")
def hash_exclude(spark, sf_dir):
    return digests.known_good(hash_sha256(spark, sf_dir), "sha256", toxic_digests(spark, sf_dir))


# ---- files --------------------------------------------------------------------------------------


@query("SELECT min(doc_id) AS doc_id, text FROM documents GROUP BY text")
def dedup_first_wins(spark, sf_dir):
    return lines.first_of_each(documents(spark, sf_dir), "text", "doc_id")


@query("SELECT doc_id, source || '.zip!' || doc_id || '.txt' AS path FROM documents WHERE contains(source || '.zip!' || doc_id || '.txt', '1.zip')")
def part_filter(spark, sf_dir):
    paths = read(spark, sf_dir, "documents").select("doc_id", F.concat("source", F.lit(".zip!"), "doc_id", F.lit(".txt")).alias("path"))
    return blobs.parts(paths, "1.zip")


@query("SELECT doc_id, source || '.zip' AS container, doc_id || '!x' AS member FROM documents")
def part_split(spark, sf_dir):
    container, member = scalars.split_part(F.concat("source", F.lit(".zip!"), "doc_id", F.lit("!x")))
    return read(spark, sf_dir, "documents").select("doc_id", container.alias("container"), member.alias("member"))


@query("SELECT event_id, json_valid(body) AND regexp_matches(body, '^[{\\[]') AS is_json, body <> '' AND json_valid(string_split(body, chr(10))[1]) AS is_jsonl FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN props WHEN 1 THEN substr(props, 1, length(props) - 1) WHEN 2 THEN props || chr(10) || 'no' ELSE CAST(event_id AS VARCHAR) END AS body FROM events)")
def json_detect(spark, sf_dir):
    body = F.when(F.col("event_id") % 4 == 0, F.col("props")).when(F.col("event_id") % 4 == 1, F.expr("substr(props, 1, length(props) - 1)")).when(F.col("event_id") % 4 == 2, F.concat("props", F.lit("\nno"))).otherwise(F.col("event_id").cast("string"))
    rows = spread(read(spark, sf_dir, "events")).select("event_id", body.alias("body"))
    return rows.select("event_id", formats.is_json(F.col("body")).alias("is_json"), formats.is_json_lines(F.col("body")).alias("is_jsonl"))


MAGIC = [*codecs.DEFLATES, *codecs.ARCHIVES]


@query(f"""WITH magic(nth, name, "offset", bytes) AS (VALUES {", ".join(f"({k}, '{n}', {o}, '{m.hex().upper()}')" for k, (n, o, m) in enumerate(MAGIC))}),
tagged AS (SELECT doc_id, repeat('00', "offset") || bytes || coalesce(hex(encode(text)), '') AS digits FROM documents JOIN magic ON nth = doc_id % {len(MAGIC)})
SELECT doc_id, (SELECT first(name ORDER BY nth) FROM magic WHERE substr(digits, 2 * "offset" + 1, length(bytes)) = bytes) AS kind FROM tagged""")
def detect_magic(spark, sf_dir):
    """Every document behind one of the magic numbers at its place, a null text as an empty one."""
    head = F.get(F.array(*[F.lit(m) for _, _, m in MAGIC]), (F.col("doc_id") % len(MAGIC)).cast("int"))
    before = F.get(F.array(*[F.lit(o) for _, o, _ in MAGIC]), (F.col("doc_id") % len(MAGIC)).cast("int"))
    data = documents(spark, sf_dir).select("doc_id", F.concat(F.unhex(F.repeat(F.lit("00"), before)), head, F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("content"))
    return data.select("doc_id", codecs.detect(F.col("content"), MAGIC).alias("kind"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN false ELSE text <> '' END AS is_text FROM documents WHERE text IS NOT NULL")
def text_sniff(spark, sf_dir):
    data = documents(spark, sf_dir).where("text is not null").select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(b"\0"), F.encode("text", "UTF-8"))).otherwise(F.encode("text", "UTF-8")).alias("content"))
    return data.select("doc_id", scalars.is_text(F.col("content")).alias("is_text"))


@query("SELECT source || '/' || doc_id || '.gz!' AS path, strlen(text) AS size, sha256(text) AS sha256 FROM documents WHERE text IS NOT NULL")
def expand_archives(spark, sf_dir):
    """Every document as a zip file within a gzip file, unpacked again."""

    def wrap(batches):
        import gzip
        import io
        import zipfile

        import pyarrow as pa

        for batch in batches:
            packed = []
            for text in batch.column("text"):
                out = io.BytesIO()
                with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
                    archive.writestr("", text.as_py())
                packed.append(gzip.compress(out.getvalue(), 1))
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(packed, pa.binary())], names=["path", "content"])

    rows = documents(spark, sf_dir, "doc_id", "text", "source").where("text is not null").select(F.concat("source", F.lit("/"), "doc_id", F.lit(".gz")).alias("path"), "text")
    files = codecs.expand_blobs(rows.mapInArrow(wrap, "path string, content binary"), codecs.Limits(expansion=10_000))
    return files.select("path", "size", F.sha2("content", 256).alias("sha256"))


@query("""WITH cut AS (SELECT doc_id, text, list_filter(range(0, least(length(text), 100) + 1), lambda k: strlen(substr(text, 1, k)) <= 100) AS fits FROM documents WHERE text IS NOT NULL)
SELECT doc_id, substr(text, 1, fits[-1]) AS text FROM cut""")
def truncate_bytes(spark, sf_dir):
    return documents(spark, sf_dir).where("text is not null").select("doc_id", scalars.truncate(F.col("text"), 100).alias("text"))


# ---- timelines ----------------------------------------------------------------------------------

ENTRIES = """
entries AS (
  SELECT o_orderkey || '/' || l_linenumber || ':' || l_returnflag AS name, o_orderkey || '-' || l_linenumber AS inode, CAST(l_quantity * 100 AS BIGINT) AS size,
    CASE WHEN l_returnflag = 'R' THEN '-r-xr-xr-x' ELSE '-rwxrwxrwx' END AS mode, l_shipdate AS m_time, CASE WHEN l_linestatus = 'F' THEN o_orderdate END AS a_time,
    CASE WHEN l_returnflag <> 'N' THEN o_orderdate END AS c_time, o_orderdate AS b_time FROM lineitem JOIN orders ON l_orderkey = o_orderkey
)"""


def entries(spark, sf_dir):
    item, order = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    joined = item.join(order, item["l_orderkey"] == order["o_orderkey"])
    return joined.select(
        F.concat("o_orderkey", F.lit("/"), "l_linenumber", F.lit(":"), "l_returnflag").alias("name"), F.concat("o_orderkey", F.lit("-"), "l_linenumber").alias("inode"), (F.col("l_quantity") * 100).cast("long").alias("size"),
        timeline.mode(F.lit(False), F.col("l_returnflag") == "R").alias("mode"), F.col("l_shipdate").alias("m_time"), F.when(F.col("l_linestatus") == "F", F.col("o_orderdate")).alias("a_time"),
        F.when(F.col("l_returnflag") != "N", F.col("o_orderdate")).alias("c_time"), F.col("o_orderdate").alias("b_time"),
    )


def seconds(name: str) -> str:
    return f"coalesce(epoch_us({name}) // 1000000, 0)"


@query(f"""WITH {ENTRIES} SELECT '0|' || regexp_replace(name, '([\\\\|/:])', '\\\\\\1', 'g') || '|' || inode || '|' || mode || '|0|0|' || size || '|' || {seconds('a_time')} || '|' || {seconds('m_time')} || '|' || {seconds('c_time')} || '|' || {seconds('b_time')} AS body FROM entries""")
def timeline_bodyfile(spark, sf_dir):
    return entries(spark, sf_dir).select(timeline.bodyfile().alias("body"))


@query(f"WITH {ENTRIES} SELECT name, inode, {seconds('coalesce(a_time, m_time, c_time, b_time)')} AS seconds FROM entries ORDER BY seconds, name, inode")
def timeline_sorted(spark, sf_dir):
    rows = entries(spark, sf_dir).select("name", "inode", scalars.epoch_seconds(timeline.sort_time()).alias("seconds"))
    return rows.orderBy("seconds", "name", "inode")


@query("""SELECT event_id, coalesce((epoch_us(shown) % 1000000 = 0) AND epoch_us(shown) // 1000000 <= epoch_us(ts) // 1000000, false) AS anomaly
FROM (SELECT event_id, ts, CASE event_id % 4 WHEN 0 THEN ts WHEN 1 THEN date_trunc('second', ts) WHEN 2 THEN date_trunc('second', ts) + INTERVAL 1 DAY END AS shown FROM events)""")
def timestomp(spark, sf_dir):
    rows = spread(read(spark, sf_dir, "events").select("event_id", "ts"))
    second = F.date_trunc("second", "ts")
    shown = F.when(F.col("event_id") % 4 == 0, F.col("ts")).when(F.col("event_id") % 4 == 1, second).when(F.col("event_id") % 4 == 2, second + F.expr("INTERVAL 1 DAY"))
    return rows.select("event_id", timeline.anomaly([(shown, F.col("ts"))]).alias("anomaly"))


@query("""WITH orders_of AS (SELECT o_custkey, list(o_orderdate ORDER BY o_orderdate, o_orderkey) AS runs, list(o_orderstatus ORDER BY o_orderdate, o_orderkey) AS files FROM orders GROUP BY o_custkey),
runs AS (SELECT o_custkey, unnest(range(0, len(runs))) AS run, unnest(runs) AS started, files FROM orders_of),
rows AS (SELECT o_custkey, run, started, unnest(range(0, len(files) + 1)) AS nth, unnest(['program'] || files) AS name FROM runs)
SELECT CAST(o_custkey AS VARCHAR) AS program, CAST(run AS INTEGER) AS run, CAST(nth AS INTEGER) AS nth, name, epoch_us(started) AS started, nth = 0 AND o_custkey % 2 = 0 AS anomaly FROM rows""")
def timeline_runs(spark, sf_dir):
    order = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderdate", "o_orderkey", "o_orderstatus"))).alias("o"))
    runs = order.select(F.lit("program").alias("name"), F.col("o_custkey"), F.lit(0).cast("long").alias("size"), (F.col("o_custkey") % 2).alias("run_count"), F.transform("o", lambda x: x["o_orderdate"]).alias("run_times"), F.transform("o", lambda x: x["o_orderstatus"]).alias("files"))
    named = runs.withColumn("name", F.col("o_custkey").cast("string"))
    rows = timeline.run_entries(named)
    return rows.select("program", "run", "nth", F.when(F.col("nth") == 0, "program").otherwise(F.col("name")).alias("name"), F.unix_micros("a_time").alias("started"), "anomaly")


@query(f"""WITH {ENTRIES}, parsed AS (
  SELECT 'table' AS path, row_number() OVER (ORDER BY name) AS nth, * FROM entries
), runs AS (
  SELECT o_custkey, list(o_orderdate ORDER BY o_orderdate, o_orderkey)[:3] AS times, list(o_orderstatus ORDER BY o_orderdate, o_orderkey)[:2] AS files FROM orders GROUP BY o_custkey
), each AS (
  SELECT o_custkey, unnest(times) AS started, unnest(range(0, len(times))) AS run, files FROM runs
), used AS (
  SELECT o_custkey, started, run, unnest(range(0, len(files) + 1)) AS nth, unnest(['run' || o_custkey] || files) AS name FROM each
)
SELECT name, inode, size, mode, epoch_us(m_time) AS m, epoch_us(a_time) AS a, epoch_us(c_time) AS c, epoch_us(b_time) AS b, mode = '-r-xr-xr-x' AS anomaly FROM parsed
UNION ALL SELECT name, '', CASE WHEN nth = 0 THEN o_custkey ELSE 0 END, NULL, NULL, epoch_us(started), NULL, NULL, nth = 0 AND o_custkey % 3 = 0 FROM used""")
def timeline_parsed(spark, sf_dir):
    """Timeline rows of parsed files: records of a file table, and prefetch files with their runs."""
    stamp = lambda x: F.date_format(x, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    table = entries(spark, sf_dir)
    record = F.struct("name", "inode", "size", "mode", *[stamp(x).alias(x) for x in timeline.TIMES], (F.col("mode") == "-r-xr-xr-x").alias("anomaly"))
    files = table.select(F.lit("table").alias("path"), F.lit(0).cast("long").alias("nth"), F.lit("mft").alias("kind"), F.to_json(record).alias("row"))
    order = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderdate", "o_orderkey", "o_orderstatus"))).alias("o"))
    used = F.slice(F.transform("o", lambda x: x["o_orderstatus"]), 1, 2).alias("files")
    times = F.slice(F.transform("o", lambda x: stamp(x["o_orderdate"])), 1, 3).alias("run_times")
    run = F.struct(F.concat(F.lit("run"), "o_custkey").alias("name"), F.col("o_custkey").alias("size"), (F.col("o_custkey") % 3).alias("run_count"), times, used)
    parsed = files.union(order.select(F.concat(F.lit("pf"), "o_custkey"), F.lit(0).cast("long"), F.lit("pf"), F.to_json(run)))
    rows = timeline.entries(parsed)
    return rows.select("name", "inode", "size", "mode", *[F.unix_micros(f"{x}_time").alias(x) for x in "macb"], "anomaly")


# ---- directories --------------------------------------------------------------------------------


@query("SELECT c_custkey AS rid, c_name AS sam_account_name, n_name AS primary_group, 'S-1-5-21-' || c_nationkey || '-' || c_custkey AS sid FROM customer JOIN nation ON c_nationkey = n_nationkey")
def ad_users(spark, sf_dir):
    users, groups = read(spark, sf_dir, "customer"), read(spark, sf_dir, "nation")
    joined = users.join(groups, users["c_nationkey"] == groups["n_nationkey"])
    return joined.select(F.col("c_custkey").alias("rid"), F.col("c_name").alias("sam_account_name"), F.col("n_name").alias("primary_group"), F.concat(F.lit("S-1-5-21-"), "c_nationkey", F.lit("-"), "c_custkey").alias("sid"))


@query("""SELECT n_name AS name, coalesce(string_agg(s_name, ',' ORDER BY s_name), '') AS members, count(s_name) AS n FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey GROUP BY n_nationkey, n_name""")
def ad_groups_members(spark, sf_dir):
    groups = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"))
    links = read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("key"), F.col("s_name").alias("member"))
    found = directory.memberships(groups, links, "key", "member", "members")
    return found.select("name", F.array_join("members", ",").alias("members"), F.size("members").cast("long").alias("n"))


@query("""SELECT r_name AS name, string_agg(n_name, ',' ORDER BY n_name) AS members FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY r_name""")
def ad_nested_groups(spark, sf_dir):
    regions = read(spark, sf_dir, "region").select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("name"))
    links = read(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("key"), F.col("n_name").alias("member"))
    return directory.memberships(regions, links, "key", "member", "members").select("name", F.array_join("members", ",").alias("members"))


WORDS_SQL = "words AS (SELECT DISTINCT c_mktsegment AS word FROM customer WHERE c_mktsegment <> 'BUILDING')"


def secrets(spark, sf_dir):
    lm, nt = F.md5(F.upper("c_mktsegment")), F.md5(F.concat("c_mktsegment", F.lit("!")))
    return read(spark, sf_dir, "customer").select(F.col("c_name").alias("sam_account_name"), F.col("c_custkey").alias("rid"), lm.alias("lm_hash"), nt.alias("nt_hash"))


@query(f"""WITH {WORDS_SQL} SELECT c_name || ':' || c_custkey || ':' || coalesce(l.word, md5(upper(c_mktsegment))) || ':' || coalesce(n.word, md5(c_mktsegment || '!')) || ':::' AS line
FROM customer LEFT JOIN words l ON md5(upper(l.word)) = md5(upper(c_mktsegment)) LEFT JOIN words n ON md5(n.word) = md5(c_mktsegment || '!')""")
def ad_lookup_wordlist(spark, sf_dir):
    words = read(spark, sf_dir, "customer").where("c_mktsegment <> 'BUILDING'").select(F.col("c_mktsegment").alias("word")).distinct()
    table = directory.word_table(words, F.md5(F.upper("word"))).union(directory.word_table(words, F.md5("word"))).groupBy("digest").agg(F.min("word").alias("word"))
    return directory.look_up(secrets(spark, sf_dir), table, "lm_hash", "nt_hash").select(directory.secret_line().alias("line"))


@query(f"""WITH rows AS (SELECT c_name, c_custkey, unnest(range(0, greatest(c_custkey % 3, c_custkey % 4))) AS i FROM customer)
SELECT c_name || '_history' || i AS sam_account_name, c_custkey AS rid, CASE WHEN i < c_custkey % 3 THEN md5('lm' || c_custkey || '-' || i) ELSE '{directory.EMPTY_LM}' END AS lm_hash,
  CASE WHEN i < c_custkey % 4 THEN md5('nt' || c_custkey || '-' || i) ELSE '{directory.EMPTY_NT}' END AS nt_hash FROM rows""")
def ad_history_rows(spark, sf_dir):
    def history(kind: str, count: int):
        numbers = F.filter(F.sequence(F.lit(0), F.lit(4)), lambda i: i < F.col("c_custkey") % count)
        return F.transform(numbers, lambda i: F.md5(F.concat(F.lit(kind), F.col("c_custkey").cast("string"), F.lit("-"), i.cast("string"))))

    rows = read(spark, sf_dir, "customer").select(F.col("c_name").alias("sam_account_name"), F.col("c_custkey").alias("rid"), history("lm", 3).alias("lm_hash_history"), history("nt", 4).alias("nt_hash_history"))
    return directory.history_rows(rows)


@query("SELECT md5(upper(c_mktsegment)) AS line FROM customer")
def ad_lm_only(spark, sf_dir):
    return directory.single_digest(secrets(spark, sf_dir), "lm")


@query(f"SELECT CASE WHEN c_custkey % 5 = 0 THEN '{directory.EMPTY_NT}' ELSE md5(c_mktsegment || '!') END AS line FROM customer")
def ad_nt_only(spark, sf_dir):
    rows = secrets(spark, sf_dir)
    return directory.single_digest(rows.withColumn("nt_hash", F.when(F.col("rid") % 5 == 0, "").otherwise(F.col("nt_hash"))), "nt")


@query("""SELECT count(*) AS files, coalesce(sum(strlen(text)), 0)::BIGINT AS bytes FROM documents""")
def total_size(spark, sf_dir):
    return blobs.total_size(documents(spark, sf_dir).select(F.octet_length("text").cast("long").alias("size")))


@query("SELECT doc_id, sha256(text) AS sha256 FROM documents WHERE sha256(text) IN (SELECT sha256(d.text) FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE l.toxic = 1) AND sha256(text) NOT IN (SELECT sha256(d.text) FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality = 1 AND d.text IS NOT NULL)")
def hash_include_exclude(spark, sf_dir):
    good = read(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    known = contents(spark, sf_dir).join(good, "doc_id").select(F.sha2("content", 256).alias("digest"))
    return digests.chosen(hash_sha256(spark, sf_dir), "sha256", known, toxic_digests(spark, sf_dir))


# ---- streams ------------------------------------------------------------------------------------


@query(f"WITH {EVENTS} SELECT {ENVELOPE_SQL} FROM events_norm WHERE {CRITICAL}")
def stream_hunt(spark, sf_dir):
    """The stream over the whole table once, gathered in a table of the shared warehouse or checkpoint folder."""
    import uuid

    from ..shipping import shared_folder
    from ..streaming import hunt as stream

    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    rows = spark.readStream.schema(stream.EVENT_ROWS).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    found = stream.hunt_stream(normalise(rows)).select(*ENVELOPE)
    stream.start(found, lambda batch, n: batch.write.mode("overwrite").parquet(f"{folder}/out/batch={n}"), f"{folder}/state", once=True).awaitTermination()
    return spark.read.schema(found.schema).parquet(f"{folder}/out/batch=*")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


from . import file_queries  # noqa: E402,F401  registers its queries
