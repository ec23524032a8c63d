"""Queries over the JSON documents of a run; each reads the written text back."""

from __future__ import annotations

from pyspark.sql import functions as F

from aislerank.operators import drift, reports, vectors
from aislerank.plans import pipeline
from aislerank.plans import sqltext as S
from aislerank.plans.book import query
from aislerank.plans.loading import _ALL as ALL_RULES
from aislerank.plans.loading import _ROW as ROW_TEXT
from aislerank.plans.loading import FILLED, TEXTED
from aislerank.plans.measuring import _LISTS, CON, CURRENT, GRADED, PSI, TVD, shifted
from aislerank.plans.ranking import K, shelf
from aislerank.plans.similarity import CONTENT, PAIRS, UNUSED_TEXTS, near_cte, texted
from aislerank.session import cut, scratch_path, stored
from aislerank.settings import RAW_COLUMNS
from aislerank.sources import tables
from aislerank.sources.driver_tables import raw_catalogue


def read_back(spark, parts, schema: str):
    path = scratch_path(spark, "report")
    tables.write_json_report(reports.document(parts), path)
    return spark.read.text(path).select(F.from_json("value", schema).alias("r"))


_SIZES = "sizes AS (SELECT category_l1, count(*) - 1 AS relevant FROM features GROUP BY 1)"


def _at(k: int) -> str:
    return f"""hits{k} AS (SELECT query_id, any_value(relevant) AS relevant, sum((c.category_l1 = q.category_l1)::INT) AS hits FROM con_r
  JOIN features q ON q.product_id = query_id JOIN features c ON c.product_id = con_r.product_id JOIN sizes s ON s.category_l1 = q.category_l1
  WHERE relevant > 0 AND rank <= {k} GROUP BY 1),
pr{k} AS (SELECT count(*) AS queries, {S.rnd(f'sum(hits) / (count(*) * {k})', 6)} AS precision, {S.rnd(f'avg(hits / least(relevant, {k}))', 6)} AS recall FROM hits{k})"""


EVALUATED = (_SIZES, _at(5), _at(10), _LISTS, f"""ev AS (SELECT
  (SELECT {S.rnd('count(DISTINCT product_id) / (SELECT count(*) FROM features)', 6)} FROM con_r) AS coverage,
  {S.rnd('avg(1 - mean_similarity)', 6)} AS diversity,
  (SELECT {S.rnd('avg(n)', 6)} FROM (SELECT query_id, 1 - avg(popularity_score) AS n FROM con_r JOIN features USING (product_id) GROUP BY 1)) AS novelty,
  (SELECT {S.rnd('avg(s)', 6)} FROM (SELECT query_id, avg(score) AS s FROM con_r GROUP BY 1)) AS avg_similarity,
  {S.rnd('avg(mean_similarity)', 6)} AS intra_list_similarity FROM per_list)""")
_METRICS = ("coverage", "diversity", "novelty", "avg_similarity", "intra_list_similarity")
_EVALUATION = ("metrics struct<" + ", ".join(f"{m}: double" for m in _METRICS) + ">, "
               "precision_recall_by_k array<struct<k: bigint, precision: double, recall: double>>")


@query("S7_training_run", S.with_(*CON, *EVALUATED) + """
SELECT true AS dated, (SELECT count(*) FROM features) AS dataset_rows, (SELECT count(*) FROM vocab) AS vocab_size,
  (SELECT precision FROM pr5) AS precision_at_5, (SELECT recall FROM pr10) AS recall_at_10, coverage, diversity, novelty FROM ev""")
def s7(spark, sf):
    path = scratch_path(spark, "training-history")
    tables.append_training_run(pipeline.training_run(texted(spark, sf)), path)
    return spark.read.parquet(path).select(
        F.col("training_date").isNotNull().alias("dated"), "dataset_rows", "vocab_size", "precision_at_5", "recall_at_10",
        "coverage", "diversity", "novelty")


@query("S8_evaluation_report", S.with_(*CON, *EVALUATED) + """
SELECT k, p.precision, p.recall, ev.*, (SELECT count(*) FROM vocab) AS vocabulary_size, (SELECT count(*) FROM features) AS documents,
  0.5::DOUBLE AS min_precision_required, (SELECT precision FROM pr5) AS precision_achieved, (SELECT precision >= 0.5 FROM pr5) AS meets_threshold,
  (SELECT queries FROM pr5) AS sample_size
FROM (SELECT 5::BIGINT AS k, * FROM pr5 UNION ALL SELECT 10, * FROM pr10) p, ev""")
def s8_evaluation(spark, sf):
    """One row for each k of the document."""
    df = stored(pipeline.features.labelled(texted(spark, sf)).drop(*UNUSED_TEXTS))
    vocab, vecs = vectors.fit(df)
    recs = stored(pipeline.shown(vectors.neighbours(vecs, K), K))
    back = read_back(spark, reports.evaluation(recs, df, vocab, vecs, (5, K)), _EVALUATION + (
        ", model_params struct<vocabulary_size: bigint, documents: bigint>, sample_config struct<sample_size: bigint>, "
        "thresholds struct<min_precision_required: double, precision_achieved: double, meets_threshold: boolean>"))
    return back.select("r.*").select(
        F.inline("precision_recall_by_k"), "metrics.*", "model_params.*", "thresholds.*", "sample_config.sample_size")


def _after(whole: str, mark: str) -> str:
    return whole[whole.index(mark):]


_FROM_RAW = ",\n".join((
    _after(FILLED, "typed AS"), _after(S.FEATURES, "scored AS").replace("FROM catalogue", "FROM whole"), _after(TEXTED, "joined AS"),
    _after(PAIRS, "tok AS"), near_cte(K), CONTENT, *EVALUATED))


@query("S8_pipeline_summary", ALL_RULES + f"""
, {_FROM_RAW},
h AS (SELECT ('0x' || substr(md5({ROW_TEXT}), 1, 15))::BIGINT AS d FROM raw),
a AS (SELECT count(*) AS records, bit_xor(d) AS x, sum(d % 2147483647)::BIGINT AS s FROM h),
v AS (SELECT count(*) FILTER (WHERE failed AND severity = 'error') = 0 AS status, count(*) FILTER (WHERE failed) AS issues_count FROM judged),
b AS (SELECT price_bucket, count(*) AS products FROM features GROUP BY 1)
SELECT 'success' AS pipeline_status, records AS record_count, {len(RAW_COLUMNS)}::BIGINT AS column_count,
  substr(md5(x || '-' || s || '-' || records), 1, 12) AS dataset_version, status, issues_count, records AS rows_in, (SELECT count(*) FROM whole) AS rows_out,
  (SELECT count(*) FROM raw) - (SELECT count(*) FROM uniq) AS exact_copies, (SELECT count(*) FROM uniq) - (SELECT count(*) FROM firsts) AS product_copies,
  (SELECT count(DISTINCT w) FROM (SELECT unnest(string_split(combined_text_tfidf, ' ')) AS w FROM texted) WHERE w <> '') AS vocabulary_estimate,
  (SELECT string_agg(price_bucket || '=' || products, ',' ORDER BY price_bucket) FROM b) AS buckets, (SELECT count(*) FROM vocab) AS vocabulary_size,
  (SELECT count(*) FROM features) AS documents, ev.*, (SELECT precision FROM pr5) AS precision_at_5, (SELECT recall FROM pr10) AS recall_at_10,
  (SELECT precision >= 0.5 FROM pr5) AS meets_threshold, (SELECT precision >= 0.5 FROM pr5) AS promoted FROM a, v, ev""")
def s8_summary(spark, sf):
    """The whole batch pipeline over the raw rows; what the rules say of them is part of the document."""
    folder = scratch_path(spark, "run")
    raw = cut(raw_catalogue(spark, sf))
    pipeline.run(raw.select(*RAW_COLUMNS, "ingest_order"), folder, K, strict=False)
    schema = (
        "pipeline_status string, ingestion struct<record_count: bigint, column_count: bigint, dataset_version: string>, "
        "validation struct<status: boolean, issues_count: bigint>, "
        "transformation struct<rows_in: bigint, rows_out: bigint, exact_copies: bigint, product_copies: bigint>, "
        "feature_engineering struct<vocabulary_estimate: bigint, price_bucket_distribution: map<string, bigint>>, "
        "model_training struct<vocabulary_size: bigint, documents: bigint>, "
        "model_evaluation struct<" + ", ".join(f"{m}: double" for m in _METRICS) +
        ", meets_threshold: boolean, precision_recall_by_k: array<struct<k: bigint, precision: double, recall: double>>>, "
        "model_registry struct<promoted: boolean>")
    r = spark.read.text(f"{folder}/reports/summary").select(F.from_json("value", schema).alias("r")).select("r.*")
    by_k = F.col("model_evaluation.precision_recall_by_k")
    return r.select(
        "pipeline_status", "ingestion.*", "validation.*", "transformation.*", "feature_engineering.vocabulary_estimate",
        F.array_join(F.transform(F.sort_array(F.map_entries("feature_engineering.price_bucket_distribution")),
                                 lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("buckets"),
        "model_training.*", *[f"model_evaluation.{m}" for m in _METRICS], by_k[0]["precision"].alias("precision_at_5"),
        by_k[1]["recall"].alias("recall_at_10"), "model_evaluation.meets_threshold", "model_registry.promoted")


@query("S8_drift_report", S.with_(S.FEATURES, CURRENT, PSI, TVD, GRADED) + """
SELECT 'compared' AS status, (SELECT count(*) FROM cur) AS record_count, (SELECT count(*) FROM features) AS baseline_record_count,
  (SELECT grade FROM graded ORDER BY CASE grade WHEN 'high' THEN 2 WHEN 'moderate' THEN 1 ELSE 0 END DESC LIMIT 1) AS overall_grade,
  feature, metric, value, grade FROM graded""")
def s8_drift(spark, sf):
    """One row for each feature of the document."""
    path = scratch_path(spark, "drift")
    df = shelf(spark, sf)
    drift.save_baseline(df, path)
    back = read_back(spark, reports.drift_summary(cut(shifted(df)), path), (
        "status string, record_count bigint, baseline_record_count bigint, overall_grade string, "
        "features map<string, struct<metric: string, value: double, grade: string>>"))
    return back.select("r.*").select(
        "status", "record_count", "baseline_record_count", "overall_grade", F.explode("features").alias("feature", "f")).select(
            "status", "record_count", "baseline_record_count", "overall_grade", "feature", "f.*")
