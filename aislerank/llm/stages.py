"""Stages of the corpus pipeline. Each takes (spark, docs, sf_dir); all but the last return the columns of docs.

Every stage works on all rows it is given. Empty tables give empty tables, and columns beside doc_id, text, source and
n_chars are carried along. A null or empty text is scored as such by the toxicity stage, is one group of near copies
with all others of its kind, holds no secrets, and has no words that the mix could take.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aislerank.llm import mixing, packing, secret_scan, simhash, toxicity
from aislerank.llm.common import free_name, row_keyed, stage_scratch, store


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents that the model calls toxic go. The labels that are not held out train it."""
    with stage_scratch(spark):
        name = free_name(docs.columns, "score")
        scored = toxicity.scores(docs, toxicity.model(spark, sf_dir), docs.columns, name)
        return scored.where(F.col(name) < toxicity.THRESHOLD).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: one document of each component stays; shingles of three words, at most two bits apart."""
    with stage_scratch(spark):
        return simhash.one_of_each(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: secrets are replaced by a mark; n_chars follows the new text."""
    with stage_scratch(spark):
        masked = secret_scan.mask(docs)
        if "n_chars" not in docs.columns:
            return masked
        changed = F.when(F.col("text").isNotNull(), F.length("text")).otherwise(F.col("n_chars"))
        return masked.withColumn("n_chars", changed.cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: every copy that the mix takes is a row, so a document may come up to three times.

    Rows are dealt to the shards of the mix and lie in each in its shuffled order.
    """
    with stage_scratch(spark):
        rows, key = row_keyed(docs)
        taken, _ = mixing.mix(rows, key)
        shard, place = free_name(rows.columns, "shard"), free_name(rows.columns, "place")
        copies = store(taken.select(F.col("row").alias(key), F.col("shard").alias(shard), F.col("place").alias(place)), "mix-copies")
        return (rows.join(copies, key).repartition(shard).sortWithinPartitions(shard, place).select(*docs.columns))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: the pieces of every row with their places in sequences of 1024 tokens."""
    with stage_scratch(spark):
        return packing.packed(docs)
