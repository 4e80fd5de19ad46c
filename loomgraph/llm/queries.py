"""The registered queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import best_fit, conversation_repair, delta_lloyd, html_extract, iblt, mixing, oracle, packing, pu_quality, rule_ledger, shards, simhash, toxicity, unigram_count
from .common import documents


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(documents(spark, sf_dir))
    return out.select("doc_id", simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pu_quality.classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op5_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iblt.compare_with_edits(documents(spark, sf_dir))


def op6_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard(documents(spark, sf_dir))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op8_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rule_ledger.quality_report(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failures")


def op9_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram_count.count_tokens(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair(conversation_repair.damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


def op12_bestfit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit.pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delta_lloyd.inertias(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_html": op2_html,
    "op3_packing": op3_packing,
    "op4_quality": op4_quality,
    "op5_sketches": op5_sketches,
    "op6_shards": op6_shards,
    "op7_toxicity": op7_toxicity,
    "op8_rules": op8_rules,
    "op9_tokens": op9_tokens,
    "op10_mixing": op10_mixing,
    "op11_repair": op11_repair,
    "op12_bestfit": op12_bestfit,
    "op13_centroids": op13_centroids,
}
ORACLES: dict[str, str] = dict(oracle.ORACLES)
