"""Directory records: memberships, digests looked up in word lists, histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The digests of an empty password.
EMPTY_LM = "aad3b435b51404eeaad3b435b51404ee"
EMPTY_NT = "31d6cfe0d16ae931b73c59d7e0c089c0"


def memberships(groups: DataFrame, links: DataFrame, group: str, member: str, name: str) -> DataFrame:
    """``members`` of each group in order of their names; groups without any keep an empty list."""
    listed = links.groupBy(group).agg(F.sort_array(F.collect_list(member)).alias(name))
    return groups.join(listed, group, "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))


def word_table(words: DataFrame, digest: Column) -> DataFrame:
    """(digest, word): the smallest word of each digest."""
    return words.select(digest.alias("digest"), "word").groupBy("digest").agg(F.min("word").alias("word"))


def look_up(records: DataFrame, tables: DataFrame, *columns: str) -> DataFrame:
    """Each digest column replaced by its word, where the table has it."""
    for column in columns:
        known = tables.select(F.col("digest").alias("_digest"), F.col("word").alias("_word"))
        records = records.join(known, records[column] == F.col("_digest"), "left").withColumn(column, F.coalesce("_word", column)).drop("_digest", "_word")
    return records


def secret_line() -> Column:
    """``name:rid:lm:nt:::``, empty digests by their fixed values."""
    lm, nt = (F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(d)) for c, d in (("lm_hash", EMPTY_LM), ("nt_hash", EMPTY_NT)))
    return F.concat(F.concat_ws(":", F.col("sam_account_name"), F.col("rid").cast("string"), lm, nt), F.lit(":::"))


def history_rows(secrets: DataFrame) -> DataFrame:
    """``name_history<i>`` rows, as many as the longer history has; the shorter is filled up."""
    zipped = F.arrays_zip(F.col("lm_hash_history").alias("lm"), F.col("nt_hash_history").alias("nt"))
    rows = secrets.select("sam_account_name", "rid", F.posexplode(zipped).alias("at", "pair"))
    return rows.select(
        F.concat(F.col("sam_account_name"), F.lit("_history"), F.col("at").cast("string")).alias("sam_account_name"), "rid",
        F.coalesce("pair.lm", F.lit(EMPTY_LM)).alias("lm_hash"), F.coalesce("pair.nt", F.lit(EMPTY_NT)).alias("nt_hash"),
    )


def single_digest(records: DataFrame, kind: str) -> DataFrame:
    """``line``: one digest of each record and nothing else, ``lm`` or ``nt``; an absent one is that of the empty password."""
    column, empty = {"lm": ("lm_hash", EMPTY_LM), "nt": ("nt_hash", EMPTY_NT)}[kind]
    return records.select(F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit(empty)).alias("line"))
