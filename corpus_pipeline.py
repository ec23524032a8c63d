"""The corpus pipeline: stages over `documents`, each one of the operators in aislerank/llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from aislerank.llm import stages
from aislerank.llm.common import store, table

#: (name, function); a function takes (spark, docs, sf_dir). All but the last return the columns of documents.
STAGES = [
    ("toxicity", stages.drop_toxic),
    ("near_duplicates", stages.drop_near_duplicates),
    ("secrets", stages.mask_secrets),
    ("mixing", stages.mix_sources),
    ("packing", stages.pack_sequences),
]

#: The trained scores and fingerprints cannot be put in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
