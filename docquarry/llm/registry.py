"""Queries of the training-data operators over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe, count, decontaminate, licenses, lm, near, pii, shard, topk, toxicity

WORD_BPE = "word_bpe_49k.json"
PIECES = "piece_bpe_32k.model"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.folds_scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digests(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.bpe_digests(docs, tokenizer_path(WORD_BPE)).drop("text")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard.digests(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.neighbours(table(spark, sf_dir, "embeddings"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.digests(table(spark, sf_dir, "documents"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.digests(table(spark, sf_dir, "documents"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count.count_tokens(docs, count.pieces_of(tokenizer_path(PIECES))).drop("text")


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digests(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_decontamination": op2_decontamination,
    "op3_bpe": op3_bpe,
    "op4_sharding": op4_sharding,
    "op5_licenses": op5_licenses,
    "op6_pii": op6_pii,
    "op7_near_dedup": op7_near_dedup,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_topk": op9_topk,
    "op10_token_counts": op10_token_counts,
}
ORACLES = {
    "op2_decontamination": decontaminate.ORACLE,
    "op4_sharding": shard.ORACLE,
    "op5_licenses": licenses.ORACLE,
    "op9_topk": topk.ORACLE,
}
