"""Queries over co-purchase, windows, attribution, shelves and spelling, and over logs and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from aislerank.functions.numbers import rounded
from aislerank.operators import merchandising as M
from aislerank.operators import hybrid, quality, strategies
from aislerank.plans import sqltext as S
from aislerank.plans.book import query
from aislerank.plans.loading import _ALL as ALL_RULES
from aislerank.plans.loading import _ROW as ROW_TEXT
from aislerank.plans.loading import TREND
from aislerank.plans.ranking import _FBT, COMPLEMENTS, K, popular_cte, shelf
from aislerank.plans.similarity import TERMS, hybrid_ctes, inputs, texted
from aislerank.session import scratch_path
from aislerank.settings import RAW_COLUMNS
from aislerank.sources import csv_catalogue, tables
from aislerank.sources.driver_tables import catalogue, raw_catalogue, table

FEAT = S.with_(S.FEATURES)


@query("L1_co_purchases", """
WITH b AS (SELECT DISTINCT l_orderkey, l_partkey::VARCHAR AS p FROM lineitem),
pairs AS (SELECT a.p AS query_id, c.p AS product_id, count(*) AS together FROM b a JOIN b c ON a.l_orderkey = c.l_orderkey AND a.p <> c.p GROUP BY ALL HAVING count(*) >= 2)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY together DESC, product_id) AS rank FROM pairs QUALIFY rank <= 10""")
def l1(spark, sf):
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("basket"), F.col("l_partkey").cast("string").alias("product_id"))
    return M.co_purchases(lines, 10).select("query_id", "product_id", "together", F.col("rank").cast("bigint").alias("rank"))


_EV = """ev AS (SELECT event_id, user_id::VARCHAR AS session_id, json_extract_string(props, '$.k') AS product_id, event_type, epoch_us(ts) AS us FROM events)"""


def clicks(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", F.col("user_id").cast("string").alias("session_id"), F.get_json_object("props", "$.k").alias("product_id"),
        "event_type", F.col("ts").cast("timestamp").alias("ts"))


DAY = 86400000000


@query("L2_windowed_trend", S.with_(_EV) + f"""
, d AS (SELECT product_id, us, us // {DAY} * {DAY} AS window_start FROM ev),
s AS (SELECT window_start, product_id, count(*) AS events, {S.rnd(f'sum(pow(0.95, (window_start + {DAY} - us) / 3.6e9))', 6)} AS score FROM d GROUP BY ALL HAVING count(*) >= 3)
SELECT *, row_number() OVER (PARTITION BY window_start ORDER BY score DESC, product_id) AS rank FROM s QUALIFY rank <= 10""")
def l2(spark, sf):
    return M.windowed_trend(clicks(spark, sf), min_count=3).select(
        "window_start", "product_id", "events", "score", F.col("rank").cast("bigint").alias("rank"))


_ENGINE = "CASE product_id::BIGINT % 3 WHEN 0 THEN 'hybrid' WHEN 1 THEN 'trending' ELSE 'personalized' END"


def by_engine(spark, sf):
    rest = F.col("product_id").cast("bigint") % 3
    return clicks(spark, sf).withColumn(
        "engine", F.when(rest == 0, "hybrid").when(rest == 1, "trending").otherwise("personalized"))


@query("L3_click_through", S.with_(_EV) + f"""
SELECT us // {DAY} * {DAY} AS window_start, {_ENGINE} AS engine, count(*) FILTER (WHERE event_type = 'view') AS impressions,
  count(*) FILTER (WHERE event_type = 'click') AS clicks, {S.rnd("count(*) FILTER (WHERE event_type = 'click') / count(*) FILTER (WHERE event_type = 'view')", 6)} AS ctr
FROM ev GROUP BY 1, 2 HAVING count(*) FILTER (WHERE event_type = 'view') >= 10""")
def l3(spark, sf):
    return M.click_through(by_engine(spark, sf))


@query("L4_conversions", S.with_(_EV) + """
SELECT c.event_id, c.session_id, c.us AS clicked_at, min(p.us) AS purchased_at FROM (SELECT * FROM ev WHERE event_type = 'click') c
LEFT JOIN (SELECT * FROM ev WHERE event_type = 'purchase') p ON p.session_id = c.session_id AND p.us >= c.us AND p.us <= c.us + 43200000000
GROUP BY ALL""")
def l4(spark, sf):
    return M.conversions(clicks(spark, sf), minutes=720)


@query("L5_deals", S.with_(S.CATALOGUE) + """
SELECT product_id, discount_percentage FROM catalogue WHERE discount_percentage >= 6.0 ORDER BY 2 DESC, 1 LIMIT 10""")
def l5(spark, sf):
    # Discounts of the given tables end at 10 percent.
    return M.deals(catalogue(spark, sf, text=False), 10, 6.0).select("product_id", "discount_percentage")


@query("L6_new_arrivals", """
WITH a AS (SELECT l_partkey::VARCHAR AS product_id, min(l_shipdate)::DATE AS arrived FROM lineitem GROUP BY 1)
SELECT product_id, strftime(arrived, '%Y-%m-%d') AS arrived FROM a WHERE arrived >= (SELECT max(arrived) FROM a) - INTERVAL 30 DAY ORDER BY 2 DESC, 1 LIMIT 10""")
def l6(spark, sf):
    first = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").cast("string").alias("product_id")).agg(
        F.min("l_shipdate").cast("date").alias("arrived"))
    return M.new_arrivals(first).select("product_id", F.date_format("arrived", "yyyy-MM-dd").alias("arrived"))


@query("L7_top_rated", S.with_(S.CATALOGUE) + "SELECT product_id, rating FROM catalogue ORDER BY rating DESC, rating_count DESC, product_id LIMIT 10")
def l7(spark, sf):
    return M.top_rated(catalogue(spark, sf, text=False)).select("product_id", "rating")


@query("L7_best_sellers", FEAT + "SELECT product_id, popularity_score FROM features ORDER BY 2 DESC, 1 LIMIT 10")
def l7_best(spark, sf):
    return M.best_sellers(shelf(spark, sf)).select("product_id", "popularity_score")


_VOCAB = "SELECT DISTINCT w AS word FROM (SELECT unnest(string_split(combined_text_tfidf, ' ')) AS w FROM texted) WHERE length(w) >= 3"


@query("L8_corrections", S.with_(TERMS) + f"""
, words AS ({_VOCAB}), names AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS n FROM part),
typed AS (SELECT substr(n, 2) AS typed FROM names UNION SELECT substr(n, 1, 2) || substr(n, 2) FROM names UNION SELECT n || 'z' FROM names),
s AS (SELECT typed, word, {S.rnd('100 * (1 - levenshtein(typed, word) / greatest(length(typed), length(word)))', 6)} AS score FROM typed, words
  WHERE abs(length(typed) - length(word)) <= 4)
SELECT *, row_number() OVER (PARTITION BY typed ORDER BY score DESC, word) AS rank FROM s WHERE score >= 75 QUALIFY rank <= 3""")
def l8(spark, sf):
    vocabulary = texted(spark, sf).select(F.explode_outer(F.split("combined_text_tfidf", " ")).alias("word")).filter(F.length("word") >= 3)
    names = table(spark, sf, "part").select(F.explode(F.split("p_name", " ")).alias("n")).distinct()
    typed = names.select(F.expr("substr(n, 2)").alias("typed")).union(
        names.select(F.expr("substr(n, 1, 2) || substr(n, 2)"))).union(names.select(F.expr("n || 'z'")))
    return M.corrections(typed, vocabulary).select("typed", "word", "score", F.col("rank").cast("bigint").alias("rank"))


# ---------------------------------------------------------------- logs and reports


_LOGGED = {
    "content_based": ("con_r", "least(1.0, score)"), "category_similarity": ("cat_r", "least(1.0, score)"),
    "brand_similarity": ("br_r", S.rnd("least(1.0, score + 0.2::DOUBLE)", 9)), "price_similarity": ("pr_r", "least(1.0, score)"),
    "popularity": ("pk_r", "score"), "trending": ("tr_r", "score"), "frequently_bought_together": ("fb_r", "least(1.0, score)"),
    "hybrid": ("hybrid", "confidence_score"),
}
_TREND_ONLY = TREND[TREND.index("heat AS"):]


@query("S6_recommendation_log", S.with_(
    *hybrid_ctes(), popular_cte(K, "pk"), _TREND_ONLY,
    popular_cte(K, "tr", "trending_score", "trend", "coalesce(rating_count, 0) >= 5", "trend"), _FBT) + " UNION ALL ".join(
    f"SELECT '{name}' AS engine, count(*) AS shown, count(DISTINCT query_id) AS sessions, {S.rnd(f'sum({confidence})', 3)} AS total, "
    f"0::BIGINT AS clicked, true AS sourced FROM {rows} WHERE rank <= {K}" for name, (rows, confidence) in _LOGGED.items()))
def s6(spark, sf):
    """Every strategy's lists for every product, appended to one log and read back."""
    path = scratch_path(spark, "recommendation-log")
    df, edges = inputs(spark, sf)
    asked = strategies.as_queries(df)
    for name, recs in {
        "content_based": strategies.content_based(df, asked, edges, K),
        "category_similarity": strategies.category_similarity(df, asked, K),
        "brand_similarity": strategies.brand_similarity(df, asked, K),
        "price_similarity": strategies.price_similarity(df, asked, K),
        "popularity": strategies.popularity(df, asked, K),
        "trending": strategies.trending(df, asked, K),
        "frequently_bought_together": strategies.bought_together(df, asked, K, COMPLEMENTS),
        "hybrid": hybrid.hybrid(df, asked, edges, K),
    }.items():
        tables.append_recommendations(recs.withColumn("source_product_id", F.col("query_id")), path, name)
    log = spark.read.parquet(path)
    return log.groupBy("engine").agg(
        F.count("*").alias("shown"), F.count_distinct("session_id").alias("sessions"), rounded(F.sum("score"), 3).alias("total"),
        F.sum(F.col("clicked") + F.col("purchased")).alias("clicked"),
        F.every(F.col("source_product_id") == F.col("session_id")).alias("sourced"))


_NULL_CELLS = " + ".join(f"count(*) - count({c})" for c in RAW_COLUMNS)


@query("S8_validation_report", ALL_RULES + f"""
, h AS (SELECT ('0x' || substr(md5({ROW_TEXT}), 1, 15))::BIGINT AS d FROM raw),
a AS (SELECT count(*) AS records, bit_xor(d) AS x, sum(d % 2147483647)::BIGINT AS s FROM h),
v AS (SELECT count(*) FILTER (WHERE failed AND severity = 'error') AS errors, count(*) FILTER (WHERE failed AND severity = 'warning') AS warnings,
  count(*) FILTER (WHERE failed) AS issues, coalesce(sum(hits) FILTER (WHERE failed), 0)::BIGINT AS issue_hits FROM judged)
SELECT errors = 0 AS validation_status, substr(md5(x || '-' || s || '-' || records), 1, 12) AS dataset_version, records AS record_count,
  errors, warnings, issues, issue_hits, {len(RAW_COLUMNS)}::BIGINT AS columns, (SELECT {_NULL_CELLS} FROM raw)::BIGINT AS null_cells FROM a, v""")
def s8(spark, sf):
    """The written document, parsed back into columns."""
    path = scratch_path(spark, "report")
    tables.write_json_report(validation_report(raw_catalogue(spark, sf)), path)
    schema = ("validation_status boolean, dataset_version string, record_count bigint, errors bigint, warnings bigint, "
              "issues array<struct<hits: bigint>>, column_stats array<struct<null_count: bigint>>")
    total = lambda values: F.aggregate(values, F.lit(0).cast("bigint"), lambda s, x: s + x)
    return spark.read.text(path).select(F.from_json("value", schema).alias("r")).select(
        *[f"r.{c}" for c in ("validation_status", "dataset_version", "record_count", "errors", "warnings")],
        F.size("r.issues").cast("bigint").alias("issues"), total(F.col("r.issues.hits")).alias("issue_hits"),
        F.size("r.column_stats").cast("bigint").alias("columns"), total(F.col("r.column_stats.null_count")).alias("null_cells"))


def validation_report(raw):
    judged = quality.issues(quality.measure(raw))
    summary = quality.verdict(judged)
    found = judged.filter("failed").agg(F.sort_array(F.collect_list(F.struct(
        "column_name", "issue_type", "severity", "hits", "ratio"))).alias("issues"))
    profile = quality.column_profile(raw).agg(F.sort_array(F.collect_list(F.struct(
        "column_name", "null_count", "null_pct", "unique_count", "dtype"))).alias("stats"))
    version = csv_catalogue.content_version(raw)
    # Each side is one row, read as a scalar.
    return tables.json_report(
        summary,
        validation_status=F.col("passed"),
        dataset_version=version.select("version").scalar(),
        record_count=version.select("records").scalar(),
        errors=F.col("errors"), warnings=F.col("warnings"),
        issues=found.scalar(), column_stats=profile.scalar())
