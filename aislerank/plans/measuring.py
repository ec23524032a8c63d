"""Queries over ranking metrics, drift and monitoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from aislerank.functions.numbers import rounded
from aislerank.operators import drift, metrics, strategies, vectors
from aislerank.plans import sqltext as S
from aislerank.plans.book import query
from aislerank.plans.loading import TREND
from aislerank.plans.ranking import K, shelf
from aislerank.plans.sessions import EVENTS, events
from aislerank.plans.similarity import CONTENT, PAIRS, described, fitted, near_cte
from aislerank.session import cut, scratch_path, stored
from aislerank.sources.driver_tables import catalogue, table

CON = (PAIRS, near_cte(K), CONTENT)


def content_recs(spark, sf):
    df = described(spark, sf)
    _, vecs = vectors.fit(df)
    recs = stored(vectors.neighbours(vecs, K)).select(
        F.col("src").alias("query_id"), F.col("dst").alias("product_id"), "rank", "score")
    return df, vecs, recs


def six(df, *names):
    return df.select(*[rounded(F.col(n), 6).alias(n) if n in names else F.col(n) for n in df.columns])


_PR = f"""sizes AS (SELECT category_l1, count(*) - 1 AS relevant FROM features GROUP BY 1),
hits AS (SELECT query_id, any_value(relevant) AS relevant, sum((c.category_l1 = q.category_l1)::INT) AS hits FROM con_r
  JOIN features q ON q.product_id = query_id JOIN features c ON c.product_id = con_r.product_id JOIN sizes s ON s.category_l1 = q.category_l1
  WHERE relevant > 0 GROUP BY 1),
pr AS (SELECT count(*) AS queries, {S.rnd(f'sum(hits) / (count(*) * {K})', 6)} AS precision, {S.rnd(f'avg(hits / least(relevant, {K}))', 6)} AS recall FROM hits)"""


@query("M1_precision_recall", S.with_(*CON, _PR) + "SELECT * FROM pr")
def m1(spark, sf):
    df, _, recs = content_recs(spark, sf)
    return six(metrics.category_precision_recall(recs, df, K), "precision", "recall")


@query("M2_coverage", S.with_(*CON) + f"""
SELECT count(DISTINCT product_id) AS recommended, {S.rnd('count(DISTINCT product_id) / (SELECT count(*) FROM features)', 6)} AS coverage FROM con_r""")
def m2(spark, sf):
    df, _, recs = content_recs(spark, sf)
    return six(metrics.coverage(recs, df), "coverage")


_LISTS = """pairs_in AS (SELECT a.query_id, coalesce(s.score, 0) AS score FROM con_r a JOIN con_r b ON a.query_id = b.query_id AND a.rank < b.rank
  LEFT JOIN sims s ON s.src = a.product_id AND s.dst = b.product_id),
per_list AS (SELECT query_id, avg(score) AS mean_similarity FROM pairs_in GROUP BY 1)"""


@query("M3_diversity", S.with_(*CON, _LISTS) + f"SELECT {S.rnd('avg(1 - mean_similarity)', 6)} AS diversity FROM per_list")
def m3(spark, sf):
    _, vecs, recs = content_recs(spark, sf)
    return six(metrics.diversity(recs, vecs).select("diversity"), "diversity")


@query("M4_novelty", S.with_(*CON) + f"""
SELECT {S.rnd('avg(n)', 6)} AS novelty FROM (SELECT query_id, 1 - avg(popularity_score) AS n FROM con_r JOIN features USING (product_id) GROUP BY 1)""")
def m4(spark, sf):
    df, _, recs = content_recs(spark, sf)
    return six(metrics.novelty(recs, df), "novelty")


@query("M5_average_similarity", S.with_(*CON) + f"""
SELECT {S.rnd('avg(s)', 6)} AS avg_similarity FROM (SELECT query_id, avg(score) AS s FROM con_r GROUP BY 1)""")
def m5(spark, sf):
    return six(metrics.average_similarity(content_recs(spark, sf)[2]), "avg_similarity")


@query("M6_intra_list_similarity", S.with_(*CON, _LISTS) + f"SELECT {S.rnd('avg(mean_similarity)', 6)} AS intra_list_similarity FROM per_list")
def m6(spark, sf):
    _, vecs, recs = content_recs(spark, sf)
    return six(metrics.diversity(recs, vecs).select("intra_list_similarity"), "intra_list_similarity")


@query("M7_query_sample", "SELECT p_partkey::VARCHAR AS query_id FROM part ORDER BY md5(p_partkey::VARCHAR), 1 LIMIT 100")
def m7(spark, sf):
    return metrics.sample_queries(catalogue(spark, sf, text=False), 100)


@query("M8_threshold_verdict", S.with_(*CON, _PR) + "SELECT precision, 0.5::DOUBLE AS threshold, precision >= 0.5 AS accepted FROM pr")
def m8(spark, sf):
    df, _, recs = content_recs(spark, sf)
    verdict = metrics.threshold_verdict(metrics.category_precision_recall(recs, df, K))
    return six(verdict.select("precision", "threshold", "accepted"), "precision")


# ---------------------------------------------------------------- sessions with a hold-out

CUT_US = 1705708800000000  # 2024-01-20: events before it are history, later ones are what was relevant
HOLDOUT = f"""{EVENTS},
past AS (SELECT DISTINCT session_id, product_id FROM ev WHERE us < {CUT_US}),
later AS (SELECT DISTINCT session_id, product_id FROM ev WHERE us >= {CUT_US}),
seen AS (SELECT * FROM trend),
shown AS (SELECT 'popularity' AS scenario, product_id, row_number() OVER (ORDER BY popularity_score DESC, product_id) AS rank FROM seen
  UNION ALL SELECT 'trending', product_id, row_number() OVER (ORDER BY trending_score DESC, product_id) FROM seen
  UNION ALL SELECT 'rating', product_id, row_number() OVER (ORDER BY rating DESC, product_id) FROM seen),
recs AS (SELECT scenario, session_id, product_id, rank FROM shown, (SELECT DISTINCT session_id FROM ev) WHERE rank <= 8),
sizes AS (SELECT session_id, count(*) AS relevant FROM later GROUP BY 1),
lists AS (SELECT scenario, r.session_id, count(*) AS k, coalesce(any_value(relevant), 0) AS relevant, count(l.product_id) AS hits,
    coalesce(sum(CASE WHEN l.product_id IS NOT NULL THEN 1 / log2(rank + 1) END), 0) AS dcg
  FROM recs r LEFT JOIN later l ON l.session_id = r.session_id AND l.product_id = r.product_id LEFT JOIN sizes s ON s.session_id = r.session_id GROUP BY ALL),
rel AS (SELECT *, hits / k AS precision, coalesce(hits / nullif(relevant, 0), 0) AS recall,
    CASE WHEN relevant = 0 THEN 0 ELSE dcg / list_sum(list_transform(range(1, least(relevant, k) + 1), lambda i: 1 / log2(i + 1))) END AS ndcg,
    (hits > 0)::INT::DOUBLE AS hit_rate FROM lists)"""


def holdout(spark, sf):
    ev = events(spark, sf)
    cut_at = F.unix_micros("ts") < CUT_US
    past = ev.filter(cut_at).select("session_id", "product_id").distinct()
    later = ev.filter(~cut_at).select("session_id", "product_id").distinct()
    stock = shelf(spark, sf)
    sessions = ev.select(F.col("session_id").alias("query_id")).distinct()
    recs = None
    for name, score in (("popularity", "popularity_score"), ("trending", "trending_score"), ("rating", "rating")):
        rows = strategies.overall(stock, sessions, 8, score).select(
            F.lit(name).alias("scenario"), F.col("query_id").alias("session_id"), "product_id", "rank")
        recs = rows if recs is None else recs.unionByName(rows)
    return stock, past, later, recs


def _lists(spark, sf):
    _, _, later, recs = holdout(spark, sf)
    return metrics.relevance_metrics(recs, later, ("scenario", "session_id"))


@query("M9_explicit_precision_recall", S.with_(TREND, HOLDOUT) + f"""
SELECT scenario, session_id, hits, relevant, {S.rnd('precision', 6)} AS precision, {S.rnd('recall', 6)} AS recall FROM rel""")
def m9(spark, sf):
    return six(_lists(spark, sf).select("scenario", "session_id", "hits", "relevant", "precision", "recall"), "precision", "recall")


@query("M10_ndcg", S.with_(TREND, HOLDOUT) + f"SELECT scenario, session_id, {S.rnd('ndcg', 6)} AS ndcg FROM rel")
def m10(spark, sf):
    return six(_lists(spark, sf).select("scenario", "session_id", "ndcg"), "ndcg")


@query("M11_hit_rate", S.with_(TREND, HOLDOUT) + "SELECT scenario, session_id, hit_rate FROM rel")
def m11(spark, sf):
    return _lists(spark, sf).select("scenario", "session_id", "hit_rate")


@query("M12_session_checks", S.with_(PAIRS, TREND.replace(S.FEATURES + ",", "").strip(), HOLDOUT) + f"""
, leaks AS (SELECT scenario, r.session_id, count(p.product_id) AS history_leakage FROM recs r LEFT JOIN past p USING (session_id, product_id) GROUP BY ALL),
two AS (SELECT a.scenario, coalesce(s.score, 0) AS score FROM shown a JOIN shown b ON a.scenario = b.scenario AND a.rank < b.rank AND b.rank <= 8
  LEFT JOIN sims s ON s.src = a.product_id AND s.dst = b.product_id),
spread AS (SELECT scenario, 1 - avg(score) AS d FROM two GROUP BY 1)
SELECT scenario, session_id, {S.rnd('8 / (SELECT count(*) FROM trend)', 6)} AS coverage_session, history_leakage, {S.rnd('d', 6)} AS diversity_intra_list
FROM leaks JOIN spread USING (scenario)""")
def m12(spark, sf):
    stock, past, _, recs = holdout(spark, sf)
    _, vecs = fitted(spark, sf)
    checks = metrics.session_checks(recs, past, stock, vecs, ("scenario", "session_id"))
    return six(checks.select("scenario", "session_id", "coverage_session", "history_leakage", "diversity_intra_list"),
               "coverage_session", "diversity_intra_list")


@query("M13_scenarios", S.with_(TREND, HOLDOUT) + f"""
, leaks AS (SELECT scenario, count(*) AS n FROM recs JOIN past USING (session_id, product_id) GROUP BY 1)
SELECT scenario, count(*) AS sessions, {S.rnd('avg(precision)', 6)} AS precision, {S.rnd('avg(recall)', 6)} AS recall, {S.rnd('avg(ndcg)', 6)} AS ndcg,
  {S.rnd('avg(hit_rate)', 6)} AS hit_rate, any_value(n) AS history_leakage FROM rel LEFT JOIN leaks USING (scenario) GROUP BY 1""")
def m13(spark, sf):
    stock, past, later, recs = holdout(spark, sf)
    return six(metrics.compare_scenarios(recs, later, past, stock), "precision", "recall", "ndcg", "hit_rate")


@query("M14_scenario_overlap", S.with_(TREND, HOLDOUT) + """
SELECT a.session_id, a.scenario AS "left", b.scenario AS "right", count(*) AS shared FROM recs a JOIN recs b
  ON a.session_id = b.session_id AND a.product_id = b.product_id AND a.scenario < b.scenario GROUP BY ALL""")
def m14(spark, sf):
    return metrics.scenario_overlap(holdout(spark, sf)[3])


RUNS = f"""runs AS (SELECT o_orderpriority AS model, strftime(o_orderdate, '%Y-%m') AS training_date, o_orderpriority || '@' || strftime(o_orderdate, '%Y-%m') AS run_id,
  count(*) AS dataset_rows, {S.rnd("sum((o_orderstatus = 'F')::INT) / count(*)", 6)} AS precision_at_5 FROM orders GROUP BY ALL)"""


def runs(spark, sf):
    """One run per order priority and month; the share of finished orders stands for the precision."""
    month = F.date_format("o_orderdate", "yyyy-MM")
    return table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("model"), month.alias("training_date")).agg(
        F.count("*").alias("dataset_rows"),
        rounded(F.sum((F.col("o_orderstatus") == "F").cast("int")) / F.count("*"), 6).alias("precision_at_5")).withColumn(
            "run_id", F.concat("model", F.lit("@"), "training_date"))


@query("M15_latest_runs", S.with_(RUNS) + "SELECT model, training_date, run_id, dataset_rows, precision_at_5 FROM runs ORDER BY training_date DESC, run_id LIMIT 20")
def m15(spark, sf):
    return metrics.latest_runs(runs(spark, sf)).select("model", "training_date", "run_id", "dataset_rows", "precision_at_5")


@query("L10_promotions", S.with_(RUNS) + """
, p AS (SELECT *, lag(precision_at_5) OVER (PARTITION BY model ORDER BY training_date, run_id) AS previous FROM runs)
SELECT run_id, precision_at_5, previous, coalesce(precision_at_5 - previous >= 0.02, true) AS promoted FROM p""")
def l10(spark, sf):
    return metrics.promotions(runs(spark, sf)).select("run_id", "precision_at_5", "previous", "promoted")


# ---------------------------------------------------------------- drift

CURRENT = """cur AS (SELECT product_id, CASE WHEN discounted_price > 4000 THEN discounted_price * 0.7 ELSE discounted_price END AS discounted_price, actual_price,
  greatest(rating - 0.5, 0) AS rating, rating_count * 1.05 AS rating_count,
  CASE WHEN category_l1 = 'PROMO' AND rating > 3 THEN 'SMALL|' || category_l2 WHEN category_l1 = 'LARGE' THEN 'HUGE|x' ELSE category END AS category FROM features)"""


def shifted(df):
    """A later version of the catalogue: dear products got cheaper, ratings fell, categories moved."""
    price = F.col("discounted_price")
    return df.select(
        "product_id", F.when(price > 4000, price * 0.7).otherwise(price).alias("discounted_price"), "actual_price",
        F.greatest(F.col("rating") - 0.5, F.lit(0.0)).alias("rating"), (F.col("rating_count") * 1.05).alias("rating_count"),
        F.when((F.col("category_l1") == "PROMO") & (F.col("rating") > 3), F.concat(F.lit("SMALL|"), "category_l2"))
        .when(F.col("category_l1") == "LARGE", "HUGE|x").otherwise(F.col("category")).alias("category"))


def _edges(c: str) -> str:
    return "list_sort(list_distinct([" + ", ".join(
        f"quantile_cont({c}, {i / 10})" for i in range(11)) + "]))"


def _bins(c: str, source: str, name: str) -> str:
    return f"""{name} AS (SELECT bin, count(*) AS n FROM (SELECT least(len(list_filter(e, lambda x: x <= v)), len(e) - 1)::BIGINT AS bin
  FROM (SELECT {c}::DOUBLE AS v, e FROM {source}, e_{c}) WHERE v >= e[1] AND v <= e[len(e)]) GROUP BY 1)"""


PSI = ",\n".join(
    f"e_{c} AS (SELECT {_edges(c)} AS e FROM features),\n{_bins(c, 'features', f'b_{c}')},\n{_bins(c, 'cur', f'c_{c}')},\n"
    f"""g_{c} AS (SELECT unnest(range(1, len(e))) AS bin FROM e_{c}),
p_{c} AS (SELECT '{c}' AS feature, greatest(coalesce(b.n, 0) / (SELECT sum(n) FROM b_{c}), 0.0001) AS b, greatest(coalesce(c.n, 0) / (SELECT sum(n) FROM c_{c}), 0.0001) AS c
  FROM g_{c} LEFT JOIN b_{c} b USING (bin) LEFT JOIN c_{c} c USING (bin))""" for c in drift.NUMERIC)
PSI += ",\npsi AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, sum((c - b) * ln(c / b)) AS value FROM p_{c}" for c in drift.NUMERIC) + ")"
TVD = """lv AS (SELECT split_part(category, '|', 1) AS level, count(*) / (SELECT count(*) FROM features) AS p FROM features GROUP BY 1),
lc AS (SELECT split_part(category, '|', 1) AS level, count(*) / (SELECT count(*) FROM cur) AS q FROM cur GROUP BY 1),
tvd AS (SELECT sum(abs(coalesce(p, 0) - coalesce(q, 0))) / 2 AS value FROM lv FULL JOIN lc USING (level))"""
GRADED = f"""graded AS (SELECT feature, 'psi' AS metric, {S.rnd('value', 4)} AS value, CASE WHEN value < 0.1 THEN 'none' WHEN value < 0.25 THEN 'moderate' ELSE 'high' END AS grade FROM psi
  UNION ALL SELECT 'category', 'total_variation_distance', {S.rnd('value', 4)}, CASE WHEN value < 0.05 THEN 'none' WHEN value < 0.15 THEN 'moderate' ELSE 'high' END FROM tvd)"""


@query("D1_baseline", S.with_(S.FEATURES, "cur AS (SELECT * FROM features)", PSI) + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, bin, {S.rnd('e[bin]', 6)} AS edge_low, {S.rnd('e[bin + 1]', 6)} AS edge_high, coalesce(n, 0) AS n FROM g_{c} LEFT JOIN b_{c} USING (bin), e_{c}"
    for c in drift.NUMERIC))
def d1(spark, sf):
    return six(drift.baseline_bins(shelf(spark, sf)).withColumn("bin", F.col("bin").cast("bigint")), "edge_low", "edge_high")


@query("D2_psi", S.with_(S.FEATURES, CURRENT, PSI) + f"SELECT feature, {S.rnd('value', 6)} AS value FROM psi")
def d2(spark, sf):
    df = shelf(spark, sf)
    return six(drift.psi(cut(drift.baseline_bins(df)), drift.long_form(shifted(df))), "value")


_OPEN = PSI.replace(" WHERE v >= e[1] AND v <= e[len(e)]", "").replace(
    "least(len(list_filter(e, lambda x: x <= v)), len(e) - 1)", "greatest(1, least(len(list_filter(e, lambda x: x <= v)), len(e) - 1))")


@query("D2_psi_open_ended", S.with_(S.FEATURES, CURRENT, _OPEN) + f"SELECT feature, {S.rnd('value', 6)} AS value FROM psi")
def d2_open(spark, sf):
    df = shelf(spark, sf)
    return six(drift.psi(cut(drift.baseline_bins(df)), drift.long_form(shifted(df)), open_ended=True), "value")


@query("D3_total_variation", S.with_(S.FEATURES, CURRENT, TVD) + f"SELECT {S.rnd('value', 6)} AS value FROM tvd")
def d3(spark, sf):
    df = shelf(spark, sf)
    return six(drift.total_variation(drift.category_counts(df), drift.category_counts(shifted(df))), "value")


@query("D4_drift_grades", S.with_(S.FEATURES, CURRENT, PSI, TVD, GRADED) + """
SELECT feature, metric, value, grade, (SELECT grade FROM graded ORDER BY CASE grade WHEN 'high' THEN 2 WHEN 'moderate' THEN 1 ELSE 0 END DESC LIMIT 1) AS overall_grade FROM graded""")
def d4(spark, sf):
    df = shelf(spark, sf)
    rows = cut(drift.report(cut(drift.baseline_bins(df)), drift.category_counts(df), shifted(df)))
    return rows.withColumn("overall_grade", drift.overall_grade(rows).scalar())


@query("D5_stored_baseline", S.with_(S.FEATURES, CURRENT, PSI, TVD, GRADED) + """
SELECT 1::BIGINT AS run, 'baseline_established' AS status, 'dataset' AS feature, 0.0::DOUBLE AS value, 'none' AS grade
UNION ALL SELECT 2, 'compared', feature, value, grade FROM graded
UNION ALL SELECT 3, 'compared', feature, 0.0, 'none' FROM graded""")
def d5(spark, sf):
    path = scratch_path(spark, "drift")
    df = shelf(spark, sf)
    later = cut(shifted(df))
    first = cut(drift.check(df, path))
    second = cut(drift.check(later, path))
    drift.save_baseline(later, path)  # the model trained on it was promoted
    third = cut(drift.check(later, path))
    out = None
    for i, rows in enumerate((first, second, third), 1):
        rows = rows.select(F.lit(i).cast("bigint").alias("run"), "status", "feature", "value", "grade")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("D6_latency_summary", "SELECT event_type AS path, count(*) AS count, " + S.rnd("avg(value)", 2) + " AS avg_ms, " + ", ".join(
    f"list_sort(list(value))[1 + least(count(*) - 1, floor(count(*) * {p})::BIGINT)] AS p{round(p * 100)}_ms" for p in (0.50, 0.95, 0.99)) +
    " FROM events GROUP BY 1")
def d6(spark, sf):
    return drift.latency_summary(table(spark, sf, "events"), "event_type", "value").select(
        "path", "count", "avg_ms", "p50_ms", "p95_ms", "p99_ms")


@query("D6_sketched_latency", "SELECT event_type AS path, count(*) AS count, " + S.rnd("avg(value)", 2) + """ AS avg_ms,
true AS p50_near, true AS p95_near, true AS p99_near FROM events GROUP BY 1""")
def d6_sketched(spark, sf):
    """Sketches stored per day, merged per path, and their ranks held against the samples (2 percent)."""
    path = scratch_path(spark, "latency")
    samples = table(spark, sf, "events")
    drift.latency_sketches(samples, "event_type", "value").write.partitionBy("day").parquet(path)
    merged = drift.sketched_latency(spark.read.parquet(path))
    below = lambda p: F.avg((F.col("value") < F.col(f"p{p}_ms")).cast("int"))
    upto = lambda p: F.avg((F.col("value") <= F.col(f"p{p}_ms")).cast("int"))
    near = [((below(p) <= p / 100 + 0.02) & (upto(p) >= p / 100 - 0.02)).alias(f"p{p}_near") for p in (50, 95, 99)]
    # One row per path is looked up.
    ranks = samples.join(F.broadcast(merged), F.col("event_type") == F.col("path")).groupBy("path", "count", "avg_ms").agg(*near)
    return ranks.select("path", "count", "avg_ms", "p50_near", "p95_near", "p99_near")


@query("D7_latest_samples", "SELECT event_id, value FROM events ORDER BY ts DESC, event_id DESC LIMIT 500")
def d7(spark, sf):
    return drift.latest_samples(table(spark, sf, "events")).select("event_id", "value")
