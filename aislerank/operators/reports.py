"""Documents of a run: its evaluation, its summary and the drift of its data.

Each function returns one row whose columns are the parts of the document; ``document`` makes it JSON.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aislerank.functions.numbers import rounded
from aislerank.operators import cleaning, drift, features, metrics, quality
from aislerank.session import cut
from aislerank.settings import RAW_COLUMNS
from aislerank.sources import csv_catalogue


def document(parts: DataFrame) -> DataFrame:
    return parts.select(F.to_json(F.struct("*")).alias("report"))


def _row(df: DataFrame) -> Column:
    """The one row of ``df`` as a struct; real numbers to six digits."""
    return df.select(F.struct(*[
        rounded(F.col(c), 6).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])).scalar()


def evaluation(recs: DataFrame, catalogue: DataFrame, vocab: DataFrame, vecs: DataFrame,
               ks: Sequence[int] = (5, 10), min_precision: float = 0.50) -> DataFrame:
    """Precision and recall for each k (the first one is held against ``min_precision``) and the list
    metrics, over all queries.  ``recs`` is read once per metric, so write it first."""
    at = [cut(metrics.category_precision_recall(recs, catalogue, k)) for k in ks]
    lists = cut(metrics.diversity(recs, vecs))
    value = lambda df, c: df.select(rounded(F.col(c), 6)).scalar().alias(c)
    size = catalogue.agg(F.count("*").alias("n"))
    judged = metrics.threshold_verdict(at[0], min_precision).select(
        F.col("threshold").alias("min_precision_required"), F.col("precision").alias("precision_achieved"),
        F.col("accepted").alias("meets_threshold"))
    return recs.sparkSession.range(1).select(
        F.current_timestamp().alias("evaluated_at"),
        F.struct(vocab.agg(F.count("*")).scalar().alias("vocabulary_size"), size.scalar().alias("documents")).alias("model_params"),
        F.struct(
            value(metrics.coverage(recs, catalogue), "coverage"), value(lists, "diversity"),
            value(metrics.novelty(recs, catalogue), "novelty"), value(metrics.average_similarity(recs), "avg_similarity"),
            value(lists, "intra_list_similarity")).alias("metrics"),
        F.array(*[
            F.struct(F.lit(k).alias("k"), value(row, "precision"), value(row, "recall"))
            for k, row in zip(ks, at)]).alias("precision_recall_by_k"),
        _row(judged).alias("thresholds"),
        F.struct(at[0].select("queries").scalar().alias("sample_size"),
                 F.array(*map(F.lit, ks)).alias("k_values")).alias("sample_config"))


def pipeline_summary(raw: DataFrame, full: DataFrame, vocab: DataFrame, evaluated: DataFrame, source: str = "",
                     error: str | None = None) -> DataFrame:
    """What each stage of a run took in and left: ``full`` is the feature table that the run wrote and
    ``evaluated`` its evaluation."""
    version = csv_catalogue.content_version(raw)
    judged = cut(quality.issues(quality.measure(raw)))
    kept = judged.filter("failed").agg(F.count("*").alias("issues_count")).scalar()
    passed = quality.verdict(judged).select(F.struct(
        F.col("passed").alias("status"), kept.alias("issues_count"), "errors", "warnings", "missing_values", "duplicate_values"))
    buckets = features.bucket_distribution(full).agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("price_bucket", "products")))))
    return evaluated.select(
        F.lit("failed" if error else "success").alias("pipeline_status"), F.current_timestamp().alias("finished_at"),
        F.lit(error).alias("error_message"),
        F.struct(
            F.lit(source).alias("source"), version.select("records").scalar().alias("record_count"),
            F.lit(sum(c in RAW_COLUMNS for c in raw.columns)).alias("column_count"), version.select("version").scalar().alias("dataset_version"),
        ).alias("ingestion"),
        passed.scalar().alias("validation"),
        _row(cleaning.row_accounting(raw)).alias("transformation"),
        F.struct(
            F.lit(len(full.columns)).alias("feature_count"), F.array(*map(F.lit, full.columns)).alias("feature_columns"),
            features.vocabulary_estimate(full).scalar().alias("vocabulary_estimate"),
            buckets.scalar().alias("price_bucket_distribution")).alias("feature_engineering"),
        F.struct(
            vocab.agg(F.count("*")).scalar().alias("vocabulary_size"), full.agg(F.count("*")).scalar().alias("documents"),
            version.select("version").scalar().alias("dataset_version")).alias("model_training"),
        F.struct("metrics.*", F.col("thresholds.meets_threshold"), "precision_recall_by_k").alias("model_evaluation"),
        F.struct(F.col("thresholds.meets_threshold").alias("promoted")).alias("model_registry"))


def drift_summary(df: DataFrame, path: str) -> DataFrame:
    """``df`` against the stored baseline; the first run stores it and reports no feature."""
    stored = drift.load_baseline(df.sparkSession, path)
    rows = cut(drift.check(df, path, stored))
    compared = rows.filter("status = 'compared'")
    by_feature = compared.agg(F.map_from_entries(F.sort_array(F.collect_list(
        F.struct("feature", F.struct("metric", "value", "grade"))))))
    return df.agg(F.count("*").alias("record_count")).select(
        F.lit("compared" if stored else "baseline_established").alias("status"), F.current_timestamp().alias("checked_at"),
        F.lit(stored.version if stored else None).cast("string").alias("baseline_version"), "record_count",
        F.lit(stored.records if stored else None).cast("bigint").alias("baseline_record_count"),
        by_feature.scalar().alias("features"), drift.overall_grade(compared).scalar().alias("overall_grade"))
