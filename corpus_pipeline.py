"""The corpus pipeline: quality rules, near-duplicates, secrets, mixing and packing, in this order.

Each stage takes all that its predecessor kept. The first four return the columns of ``documents``;
the last returns the packed pieces.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gritstone.llm import mixing, packing, quality_rules, secret_scan, simhash
from gritstone.llm.common import drop_tables, shared_folder, written
from gritstone.llm.queries import vocabulary

#: The tokenizer's vocabulary and the EM's verdict are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


#: The tables that the stage before wrote on its way; its result has been written when the next one starts.
_left: dict[str, list[str]] = {}


def stage(f: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage that deletes what its predecessor no longer needs."""

    @functools.wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        app = spark.sparkContext.applicationId
        drop_tables(spark, _left.pop(app, []))
        before = set(written(spark))
        out = f(spark, docs, sf_dir)
        _left[app] = [x for x in written(spark) if x not in before]
        return out

    return run_stage


@stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality_rules.keep_good(docs)


@stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, linked by five-word shingles of similarity 0.8 or more."""
    return simhash.keep_first(docs, size=5, similarity=0.8)


@stage
def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every reported span is replaced by a mark."""
    return secret_scan.redact(docs)


@stage
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Small sources are repeated, at most twice against the largest; no document is lost."""
    return mixing.mix(docs, cover=True, most_epochs=2.0)


@stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 1024 tokens."""
    return packing.pack_documents(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [("quality rules", quality), ("near-duplicates", near_duplicates), ("secrets", secrets), ("mixing", mix), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again as the next one's input."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, work) in enumerate(STAGES):
        out = work(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/{k}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{k}")
    return docs
