"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embedding_dedup, html_text, mixing, packing, quality_gam, quality_rules, secret_scan, simhash, substring_dedup, token_output
from .common import shared_folder


#: Windows of 20 words that also start earlier, found by numbering equal word sequences.
OP1_SQL = r"""
WITH split AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), windows AS (
  SELECT doc_id, unnest(range(1, len(words) - 18)) AS place,
    unnest(list_transform(range(1, len(words) - 18), lambda i: array_to_string(words[i:i + 19], ' '))) AS sequence
  FROM split
), repeats AS (
  SELECT doc_id, place, row_number() OVER (PARTITION BY sequence ORDER BY doc_id, place) > 1 AS repeated FROM windows
), single AS (
  SELECT doc_id, unnest(range(1, len(words) + 1)) AS place, unnest(words) AS word FROM split
), covered AS (
  SELECT s.doc_id, s.place, s.word, coalesce(bool_or(r.repeated) OVER (
    PARTITION BY s.doc_id ORDER BY s.place ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), false) AS gone
  FROM single s LEFT JOIN repeats r ON s.doc_id = r.doc_id AND s.place = r.place
), kept AS (
  SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed,
    coalesce(string_agg(word, ' ' ORDER BY place) FILTER (WHERE NOT gone), '') AS kept
  FROM covered GROUP BY doc_id
)
SELECT s.doc_id, CAST(len(s.words) AS BIGINT) AS n_words, CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(k.kept, '')) AS kept_sha256
FROM split s LEFT JOIN kept k ON s.doc_id = k.doc_id
"""

#: Every exponent of the grid at once; blocks and permutations by the same md5 numbers.
OP5_SQL = r"""
WITH units AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens FROM documents
), sources AS (
  SELECT source, CAST(sum(n_tokens) AS DOUBLE) AS tokens, count(*) AS docs FROM units GROUP BY source
), overall AS (
  SELECT sum(tokens) AS total, count(*) AS n FROM sources WHERE tokens > 0
), raised AS (
  SELECT step, tokens / total AS p, pow(tokens / total, step / 32768.0) AS w
  FROM sources, overall, range(0, 32769) AS grid(step) WHERE tokens > 0
), summed AS (
  SELECT step, sum(w) AS z, ln(sum(w)) - step / 32768.0 * sum(w * ln(p)) / sum(w) AS entropy, max(w / p) / sum(w) AS epochs
  FROM raised GROUP BY step
), chosen AS (
  SELECT greatest(coalesce(max(step) FILTER (WHERE entropy >= 0.97 * ln(n)), 0), min(step) FILTER (WHERE epochs <= 4.0)) AS step
  FROM summed, overall
), budgets AS (
  SELECT source, tokens, docs, floor(pow(tokens / total, chosen.step / 32768.0) / z * total + 0.5) AS budget
  FROM sources, overall, chosen, summed WHERE summed.step = chosen.step
), dealt AS (
  SELECT doc_id, u.source, n_tokens, budget, tokens,
    CAST('0x' || substr(md5('block|' || doc_id), 1, 8) AS BIGINT) % CAST(ceil(docs / 1024.0) AS BIGINT) AS block
  FROM units u JOIN budgets b ON u.source = b.source
), held AS (
  SELECT *, CAST(sum(n_tokens) OVER (PARTITION BY source, block) AS DOUBLE) AS block_tokens FROM dealt
), given AS (
  SELECT *, floor(budget / tokens * block_tokens + 0.5) AS given FROM held
), epochs AS (
  SELECT *, CAST(floor(given / block_tokens) AS BIGINT) AS whole FROM given
), turn0 AS (
  SELECT *, false AS last, given - whole * block_tokens AS rest FROM epochs
), fits1 AS (
  SELECT *, NOT last AND n_tokens <= rest AS fits FROM turn0
), taken1 AS (
  SELECT *, fits AND sum(CASE WHEN fits THEN n_tokens ELSE 0 END) OVER (PARTITION BY source, block ORDER BY md5(whole || '|' || doc_id) ROWS UNBOUNDED PRECEDING) <= rest AS taken FROM fits1
), turn1 AS (
  SELECT * EXCLUDE (last, rest, fits, taken), last OR taken AS last, rest - sum(CASE WHEN taken THEN n_tokens ELSE 0 END) OVER (PARTITION BY source, block) AS rest FROM taken1
), fits2 AS (
  SELECT *, NOT last AND n_tokens <= rest AS fits FROM turn1
), taken2 AS (
  SELECT *, fits AND sum(CASE WHEN fits THEN n_tokens ELSE 0 END) OVER (PARTITION BY source, block ORDER BY md5(whole || '|' || doc_id) ROWS UNBOUNDED PRECEDING) <= rest AS taken FROM fits2
), turn2 AS (
  SELECT * EXCLUDE (last, rest, fits, taken), last OR taken AS last, rest - sum(CASE WHEN taken THEN n_tokens ELSE 0 END) OVER (PARTITION BY source, block) AS rest FROM taken2
), fits3 AS (
  SELECT *, NOT last AND n_tokens <= rest AS fits FROM turn2
), taken3 AS (
  SELECT *, last OR fits AND sum(CASE WHEN fits THEN n_tokens ELSE 0 END) OVER (PARTITION BY source, block ORDER BY md5(whole || '|' || doc_id) ROWS UNBOUNDED PRECEDING) <= rest AS extra FROM fits3
), every AS (
  SELECT doc_id, source, n_tokens, block, unnest(range(0, whole + CASE WHEN extra THEN 1 ELSE 0 END)) AS epoch FROM taken3
)
SELECT doc_id, source, n_tokens, block, CAST(epoch AS INTEGER) AS epoch,
  row_number() OVER (PARTITION BY source, block, epoch ORDER BY md5(epoch || '|' || doc_id)) AS place
FROM every
"""

#: All pairs of a label, and what is reachable by links.
OP7_SQL = """
WITH RECURSIVE vectors AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND list_sum(list_transform(embedding, lambda x: abs(x))) > 0
), links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM vectors a JOIN vectors b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), reached AS (
  SELECT vec_id AS x, vec_id AS y FROM embeddings
  UNION
  SELECT r.x, l.y FROM reached r JOIN links l ON r.y = l.x
), named AS (
  SELECT x, min(y) AS component_id FROM reached GROUP BY x
), counted AS (
  SELECT x, count(*) AS n_links FROM links GROUP BY x
)
SELECT e.vec_id, coalesce(c.n_links, 0) AS n_links, n.component_id, e.vec_id = n.component_id AS kept
FROM embeddings e JOIN named n ON e.vec_id = n.x LEFT JOIN counted c ON e.vec_id = c.x
"""


def secret_sql() -> str:
    """Places of matches by the lengths of what lies before them; each further kind where no span of the kinds before it is."""

    def folded(word: str) -> str:
        return "".join(f"[{x.upper()}{x}]" if x.isalpha() else x for x in word)

    words = "|".join(map(folded, ("password", "passwd", "secret", "token"))) + f"|{folded('api')}_?{folded('key')}"
    ascii_part = "[!-.0-9;-?A-~]"
    kinds = [
        ("assign", rf"""(?:{words})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "length(value) >= 12"),
        ("access", "(AKIA[A-Z0-9]+)", "length(value) >= 18"),
        ("hex", "([0-9a-f]+)", "length(value) >= 16"),
        ("private_key", r"(-----BEGIN [A-Z ]*PRIVATE KEY-----(?:-{0,4}[A-Za-z0-9+/=:,. \t\r\n])*-----END [A-Z ]*PRIVATE KEY-----)", "true"),
        ("jwt", r"(?:^|[^A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})", "true"),
        ("prefixed", "(gh[pousr]_[A-Za-z0-9]{30,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35})", "true"),
        ("url", f"[a-z][a-z0-9+.-]+://{ascii_part}+:({ascii_part}{{6,}})@", "true"),
        ("bearer", rf"{folded('bearer')}\x20+([A-Za-z0-9._~+/-]{{20,}}=*)", "true"),
    ]
    steps, known = [], []
    for k, (name, pattern, test) in enumerate(kinds):
        quoted = "'" + pattern.replace("'", "''") + "'"
        lead = "length(found) - length(value)" if name == "jwt" else "0"
        free = "" if k < 3 else " AND NOT EXISTS (SELECT 1 FROM (" + " UNION ALL ".join(f"SELECT doc_id, a, b FROM {x}" for x in known) + ") t WHERE t.doc_id = m.doc_id AND t.a < m.b AND m.a < t.b)"
        steps.append(f"""m{k} AS (
  SELECT doc_id, owner, value, start + {lead} AS a, start + length(found) AS b FROM (
    SELECT doc_id, owner, found, regexp_extract(found, {quoted}, 1) AS value,
      list_sum(list_transform(pieces[1:nth], lambda x: length(x))) + coalesce(list_sum(list_transform(matches[1:nth - 1], lambda x: length(x))), 0) AS start
    FROM (SELECT *, unnest(matches) AS found, unnest(range(1, len(matches) + 1)) AS nth FROM (
      SELECT doc_id, owner, regexp_extract_all(body, {quoted}) AS matches, string_split_regex(body, {quoted}) AS pieces FROM texts))
  ) WHERE {test}
), k{k} AS (SELECT doc_id, owner, value, CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b, {k} AS kind, '{name}' AS name FROM m{k} m WHERE true{free})""")
        known.append(f"k{k}")
    return f"""WITH texts AS (SELECT doc_id, coalesce(source, chr(1)) AS owner, coalesce(text, '') AS body FROM documents), {", ".join(steps)},
spans AS ({" UNION ALL ".join(f"SELECT * FROM {x}" for x in known)}),
held AS (SELECT value, count(DISTINCT owner) AS owners FROM spans GROUP BY value),
judged AS (SELECT s.*, owners < {secret_scan.MANY_OWNERS} AS live, name || ':' || a || ':' || b AS spelt FROM spans s JOIN held h ON s.value = h.value),
told AS (
  SELECT doc_id, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access, count(*) FILTER (WHERE kind = 2) AS n_hex,
    string_agg(spelt, ',' ORDER BY a, kind, b) FILTER (WHERE kind < 3) AS base, string_agg(spelt, ',' ORDER BY a, kind, b) FILTER (WHERE kind < 3 OR live) AS spans,
    count(*) FILTER (WHERE live) AS n_live, count(*) FILTER (WHERE NOT live) AS n_copied
  FROM judged GROUP BY doc_id
)
SELECT t.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
  coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied
FROM texts t LEFT JOIN told ON t.doc_id = told.doc_id"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """The place of a public tokenizer's file; it is the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op4_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_gam.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = mixing.plan(table(spark, sf_dir, "documents"))
    return given.select("doc_id", "source", "n_tokens", "block", "epoch", "place")


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_documents(table(spark, sf_dir, "documents")).drop("text_key")


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/token-files-{uuid.uuid4().hex}"
    token_output.write_tokens(table(spark, sf_dir, "documents"), path, vocabulary("word_bpe_49k.json"), 2)
    return token_output.read_tokens(spark, path)


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


def oracle_sql() -> dict[str, str]:
    return {"op1_substring_dedup": OP1_SQL, "op5_source_mixing": OP5_SQL, "op7_embedding_near_dedup": OP7_SQL, "op8_secret_scan": secret_sql()}
