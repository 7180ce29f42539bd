"""The corpus pipeline: toxic documents go, then those of poor quality, then near copies; the rest is packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns they got.
Defined cases are those of the operators: null and empty texts score the prior of toxicity, fail the quality
rules, and so are gone before packing; rows with a null doc_id are linked with nothing; rows that
share a doc_id are compared by their texts as any others; empty tables pass through.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrid.llm import neardup, packing, quality, toxicity
from loomgrid.llm._spark import cut, discard, small


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest labelled examples don't vote toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = toxicity.score(docs, toxicity.fit(docs, labels))
    return scored.filter("__toxicity.predicted = 0").drop("__toxicity")


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return quality.quality_filter(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, a Jaccard similarity of 0.8 or more)."""
    again = cut(docs.groupBy("doc_id").count().filter("count > 1 AND doc_id IS NOT NULL").select(F.col("doc_id").alias("__again")))
    if again.isEmpty():
        return _kept(docs, "doc_id")
    # rows that share an id are told apart by their text, with keys over all ids that are likely
    own = F.xxhash64("doc_id", "text").bitwiseAND(F.lit((1 << 62) - 1)) + F.lit(1 << 62)
    keyed = docs.join(small(again), docs["doc_id"] == again["__again"], "left").withColumn("__key", F.when(F.col("__again").isNull(), F.col("doc_id").cast("long")).otherwise(own))
    stay = _kept(cut(keyed), "__key")
    # rows alike in id and text: the least by the other columns
    first = stay.filter("__again IS NOT NULL").groupBy("__key").agg(F.min(F.struct(*docs.columns)).alias("row")).select("row.*")
    return stay.filter("__again IS NULL").select(docs.columns).union(first)


def _kept(docs: DataFrame, key: str) -> DataFrame:
    gone = cut(neardup.near_duplicates(docs, key, k=5, percent=80).filter("NOT kept").select(F.col(key).alias("__gone")).distinct())
    return docs.join(small(gone), docs[key] == gone["__gone"], "left_anti")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents left, in sequences of 2048 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality rules", drop_poor),
    ("minhash near-dedup", drop_copies),
    ("best-fit packing", pack),
]

#: Tokenizing and packing have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another, over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs)
            discard(before)
    return docs
