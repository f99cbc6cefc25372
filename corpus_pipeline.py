"""From raw documents to a sharded training corpus: five stages, each over all its predecessor kept.

Defined results: documents with a null or empty text fail the quality rules; rows with a null doc_id are no near-duplicates of others, leave if their text is leaked, and
are mixed and sharded like any other; rows that share a doc_id are told apart by their texts; of repeated rows all or none leave, but for copies, which leave for the
smallest doc_id; very long texts are read whole, each by one task; an empty table of documents gives no rows; other columns are kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from predaudit.functions.lineage import store
from predaudit.llm.decontaminate import drop_leaked
from predaudit.llm.mixing import mix_sources
from predaudit.llm.quality import keep_good
from predaudit.llm.setsketch import drop_near_duplicates
from predaudit.llm.sharding import shard_documents

SHARDS = 24


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the n-gram ratio."""
    return keep_good(docs, _table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items."""
    return drop_leaked(docs, _table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the proportions of the mixture; those of repeated sources more than once."""
    return mix_sources(docs).select(*docs.columns)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the shard they go to and their place in it."""
    return shard_documents(docs, SHARDS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

ORACLE_SQL = None  # sketches, model scores and alignments are beyond SQL; tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents; each stage is written and read again before the next."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
