"""The registered queries of this subpackage, and their SQL counterparts where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreloom.llm import (
    bpe, chat, codes, decontaminate, dedup, divergence, jaccard, passages, pii, shards, simhash, toxicity, warc,
)

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def op1_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Encode every text, decode it again; counts and digests of both."""
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    return bpe.digests(bpe.encode_and_decode(docs, TOKENIZER))


def op2_chat(spark: SparkSession, folder: str) -> DataFrame:
    """Pack all conversations and a probe into prefix trees, and read every conversation back from them."""
    return chat.read_back(*chat.pack(chat.with_probe(_table(spark, folder, "conversations"))))


def op3_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op4_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.report(_table(spark, folder, "pages"))


def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.report(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op6_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return passages.repeated_passages(_table(spark, folder, "documents"))


def op7_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.jaccard_components(_table(spark, folder, "documents"), n=3, percent=90)


def op8_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return shards.shard_documents(_table(spark, folder, "documents"))


def op9_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return dedup.exact_groups(_table(spark, folder, "documents")).drop("_place")


def op10_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.report(_table(spark, folder, "documents"))


def op11_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    return codes.compress(_table(spark, folder, "embeddings"))


def op12_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_copies(_table(spark, folder, "documents"))


def op13_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.audit(_table(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_chat": op2_chat,
    "op3_decontamination": op3_decontamination,
    "op4_warc": op4_warc,
    "op5_toxicity": op5_toxicity,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_ngram_jaccard": op7_ngram_jaccard,
    "op8_sharding": op8_sharding,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_pii": op10_pii,
    "op11_vector_codes": op11_vector_codes,
    "op12_simhash": op12_simhash,
    "op13_source_divergence": op13_source_divergence,
}

ORACLES: dict[str, str] = {
    "op2_chat": chat.ORACLE,
    "op4_warc": warc.ORACLE,
    "op9_exact_dedup": dedup.ORACLE,
    "op11_vector_codes": codes.oracle(),
    "op13_source_divergence": divergence.ORACLE,
}
