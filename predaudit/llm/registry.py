"""Queries of the training-data operators and their reference SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from predaudit.functions.lineage import store
from predaudit.llm import oracles, secrets, warc
from predaudit.llm.collocations import collocations
from predaudit.llm.decontaminate import leaks
from predaudit.llm.extract import main_text
from predaudit.llm.lines import drop_repeated_lines
from predaudit.llm.mixing import mix_sources
from predaudit.llm.partenum import linked_classes
from predaudit.llm.quality import quality
from predaudit.llm.repeats import repeated_units
from predaudit.llm.setsketch import near_duplicates
from predaudit.llm.sharding import shard_documents
from predaudit.llm.spelling import variants, vocabulary


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op2_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_documents(_table(spark, sf_dir, "documents"), 24)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op3_setsketch_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), 75)


def op8_quality_ngram_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_spaced_seed_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), "n_tokens", "epoch", "block", "start_token", "position")


def op6_blob_ledger_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    ledger = store(secrets.scan(docs), "secret-ledger")
    return secrets.digest(secrets.report(docs, ledger))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = drop_repeated_lines(_table(spark, sf_dir, "documents"), 10)
    return left.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


def op4_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_units(_table(spark, sf_dir, "documents"))


def op1_seekable_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.write(_table(spark, sf_dir, "pages"), warc.new_folder(spark))
    return warc.read(index, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_dom_sum_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(_table(spark, sf_dir, "pages"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = vocabulary(_table(spark, sf_dir, "documents"), 7, 2, noise=31)
    return variants(words).select("word", "form", "root", "n", "n_near", "form_n")


def op12_partenum_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_classes(_table(spark, sf_dir, "documents"), 80)


def op13_toivonen_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(_table(spark, sf_dir, "documents"))


LLM_QUERIES = {
    "op1_seekable_warc": op1_seekable_warc,
    "op2_minimax_shards": op2_minimax_shards,
    "op3_setsketch_near_dedup": op3_setsketch_near_dedup,
    "op4_repeated_passages": op4_repeated_passages,
    "op5_temperature_mixing": op5_temperature_mixing,
    "op6_blob_ledger_secrets": op6_blob_ledger_secrets,
    "op7_dom_sum_product": op7_dom_sum_product,
    "op8_quality_ngram_ratio": op8_quality_ngram_ratio,
    "op9_spaced_seed_leaks": op9_spaced_seed_leaks,
    "op10_line_dedup": op10_line_dedup,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_partenum_join": op12_partenum_join,
    "op13_toivonen_collocations": op13_toivonen_collocations,
    "pipeline": corpus_pipeline.run,
}
LLM_ORACLES = {
    "op1_seekable_warc": oracles.OP1,
    "op3_setsketch_near_dedup": oracles.OP3,
    "op5_temperature_mixing": oracles.OP5,
    "op6_blob_ledger_secrets": oracles.OP6,
    "op10_line_dedup": oracles.OP10,
    "op11_spelling_variants": oracles.OP11,
    "op12_partenum_join": oracles.OP12,
    "op13_toivonen_collocations": oracles.OP13,
}
