"""Explanations and catalogue fields for recommendation rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aislerank.functions import text
from aislerank.functions.numbers import rounded, safe_text
from aislerank.operators.skew import salted_join
from aislerank.operators.strategies import grade
from aislerank.session import stored


def with_catalogue(recs: DataFrame, catalogue: DataFrame) -> DataFrame:
    """The full recommendation row.  Candidates not in the catalogue drop out."""
    plain = lambda c: F.coalesce(F.nanvl(F.col(c), F.lit(0.0)), F.lit(0.0))
    fields = catalogue.select(
        "product_id", "product_name",
        *[safe_text(F.col(c)).alias(c) for c in (
            "category", "category_l1", "category_l2", "brand", "price_bucket", "img_link", "product_link")],
        plain("discounted_price").alias("price"), plain("actual_price").alias("actual_price"),
        plain("discount_percentage").alias("discount_percentage"), plain("rating").alias("rating"),
        plain("rating_count").cast("bigint").alias("rating_count"),
        plain("popularity_score").alias("popularity_score"))
    carried = [c for c in recs.columns if c.startswith("c_")]
    # A best seller may be in very many lists.
    return salted_join(stored(recs.drop(*carried)), fields, "product_id")


def keywords_for(recs: DataFrame, texts: DataFrame, limit: int = 5) -> DataFrame:
    """Adds ``matched_keywords`` from (product_id, keywords) of the query and of the candidate."""
    q = texts.select(F.col("product_id").alias("query_id"), F.col("keywords").alias("_q"))
    c = texts.select("product_id", F.col("keywords").alias("_c"))
    joined = salted_join(stored(recs), c, "product_id", "left").join(q, "query_id", "left")
    shared = text.matched_keywords(F.col("_q"), F.col("_c"), limit)
    return joined.withColumn(
        "matched_keywords", F.coalesce(shared, F.array().cast("array<string>"))).drop("_q", "_c")


def keyword_table(catalogue: DataFrame, column: str) -> DataFrame:
    """(product_id, keywords): each text is cut into its keywords once, not once per pair."""
    return catalogue.select("product_id", text.keyword_set(F.col(column)).alias("keywords"))


def explanation(recs: DataFrame) -> DataFrame:
    """Adds ``confidence_grade`` and the nested ``reason`` document."""
    confidence = rounded(F.col("confidence_score"), 3)
    named = lambda c, *unset: F.when(~F.col(c).isin("", *unset), F.col(c))
    graded = recs.withColumn("confidence_grade", grade(F.col("confidence_score")))
    return graded.withColumn("reason_document", F.struct(
        F.col("product_name").alias("product"),
        confidence.alias("score"),
        F.struct(
            F.coalesce(named("category_l1"), named("category_l2"), F.lit("N/A")).alias("category"),
            F.coalesce(named("brand", "Unknown", "nan"), F.lit("N/A")).alias("brand"),
            F.col("matched_keywords"),
            engine_title(F.col("strategy")).alias("engine"),
            F.col("confidence_grade").alias("confidence"),
            confidence.alias("confidence_score"),
            F.col("reason_tags"),
            F.col("recommendation_reason").alias("primary_reason"),
        ).alias("reason")))


def engine_title(strategy: Column) -> Column:
    return F.initcap(F.translate(strategy, "_", " "))
