"""Stage tables, serving table, logs and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aislerank.functions.numbers import to_number
from aislerank.operators.cleaning import keep_first


def write_stage(df: DataFrame, path: str) -> DataFrame:
    """Write a stage as Parquet and go on from the files."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def serving_rows(raw: DataFrame, order: str = "ingest_order") -> DataFrame:
    """The serving table: named products, first row per id, plain numbers, 0 for what is missing."""
    stripped = lambda c, chars: F.coalesce(
        to_number(F.regexp_replace(c, chars, "")), F.lit(0.0))
    plain_rating = F.regexp_replace("rating", "^([0-9]*)[.]?([0-9]*)$", "$1$2")
    usable = raw.filter(F.col("product_id").isNotNull() & F.col("product_name").isNotNull())
    return keep_first(usable, [F.col("product_id")], order).select(
        "product_id",
        "product_name",
        F.coalesce("category", F.lit("nan")).alias("category"),
        stripped("discounted_price", "[₹,]").alias("discounted_price"),
        stripped("actual_price", "[₹,]").alias("actual_price"),
        stripped("discount_percentage", "%").alias("discount_percentage"),
        F.when(plain_rating.rlike("^[0-9]+$"), F.col("rating").try_cast("double"))
        .otherwise(0.0).alias("rating"),
        F.coalesce(
            F.when(
                F.regexp_replace("rating_count", ",", "").rlike("^[0-9]+$"),
                F.regexp_replace("rating_count", ",", "").cast("bigint")),
            F.lit(0)).alias("rating_count"),
        F.coalesce("about_product", F.lit("nan")).alias("about_product"),
        F.coalesce("img_link", F.lit("nan")).alias("img_link"),
        F.coalesce("product_link", F.lit("nan")).alias("product_link"),
    )


def append_recommendations(recs: DataFrame, path: str, engine: str | None = None,
                           at: Column | None = None, mode: str = "append") -> None:
    """Append shown recommendations with the confidence users saw (the score, where there is none) to the
    log; clicks and purchases start at 0."""
    shown = "confidence_score" if "confidence_score" in recs.columns else "score"
    recs.select(
        F.col("query_id").cast("string").alias("session_id"),
        F.col("source_product_id"),
        F.col("product_id").alias("recommended_product_id"),
        (F.lit(engine) if engine else F.col("strategy")).alias("engine"),
        F.col(shown).alias("score"),
        (F.current_timestamp() if at is None else at).alias("timestamp"),
        F.lit(0).alias("clicked"),
        F.lit(0).alias("purchased"),
    ).write.mode(mode).parquet(path)


def append_training_run(metrics: DataFrame, path: str) -> None:
    """Append the one-row summary of a run."""
    metrics.write.mode("append").parquet(path)


def json_report(df: DataFrame, **fields: Column) -> DataFrame:
    """One JSON document per row of ``df``."""
    return df.select(F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()])).alias("report"))


def write_json_report(report: DataFrame, path: str) -> None:
    report.coalesce(1).write.mode("overwrite").text(path)
