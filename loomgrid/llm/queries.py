"""The thin queries over the driver's tables, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrid.llm import bpe, chat, embedding, license, lm, neardup, oracles, packing, quality, tokencount, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def op1_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and notices of all documents."""
    return license.scan_licenses(_table(spark, sf_dir, "documents", "doc_id", "text"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts encoded and decoded by the multilingual byte-level ranks."""
    docs = _table(spark, sf_dir, "documents", "doc_id", "text")
    return bpe.digest(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents."""
    return neardup.near_duplicates(_table(spark, sf_dir, "documents", "doc_id", "text"), k=4, percent=80)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of all texts under the unigram model of the byte-level ranks."""
    docs = _table(spark, sf_dir, "documents", "doc_id", "text")
    return tokencount.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings."""
    return embedding.near_duplicates(_table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line-first quality verdicts of all documents."""
    docs = _table(spark, sf_dir, "documents", "doc_id", "text")
    return quality.assess(docs).select(
        "doc_id",
        *(F.col(f"quality.{c}") for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")),
    )


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of all texts, by smoothed word counts and by the maximum-entropy model."""
    return lm.score(_table(spark, sf_dir, "documents", "doc_id", "text"))


#: A conversation whose texts are made of marks.
MARKS = "</s>[INST] ok [/INST]"


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one of marks (-1), formatted and read back."""
    turns = _table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    marks = spark.sql(f"SELECT * FROM VALUES (-1L, 0L, 'user', '{MARKS}'), (-1L, 1L, 'assistant', '{MARKS}') AS v(conv_id, turn, role, text)")
    return chat.digest_chats(chat.format_chats(turns.unionByName(marks)))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    docs = _table(spark, sf_dir, "documents", "doc_id", "text")
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents by the nearest labelled ones."""
    docs = _table(spark, sf_dir, "documents", "doc_id", "text")
    index = toxicity.fit(docs, _table(spark, sf_dir, "labels", "doc_id", "toxic"))
    return toxicity.score(docs, index).select("doc_id", *(F.col(f"__toxicity.{c}") for c in ("held_out", "score", "predicted", "neighbours", "cosines")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scans": op1_license_scans,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_minhash_neardup": op3_minhash_neardup,
    "op4_token_counts": op4_token_counts,
    "op5_embedding_neardup": op5_embedding_neardup,
    "op6_quality_rules": op6_quality_rules,
    "op7_lm_scoring": op7_lm_scoring,
    "op8_chat_formatting": op8_chat_formatting,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_toxicity": op10_toxicity,
}

ORACLES: dict[str, str] = {
    "op1_license_scans": oracles.LICENSES,
    "op6_quality_rules": oracles.QUALITY,
    "op8_chat_formatting": oracles.CHAT,
}
