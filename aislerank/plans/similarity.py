"""Queries over term vectors, nearest neighbours, content ranking and the blend."""

from __future__ import annotations

from pyspark.sql import functions as F

from aislerank.functions import text
from aislerank.functions.numbers import rounded
from aislerank.operators import cleaning, explain, features, hybrid, strategies, vectors
from aislerank.plans import sqltext as S
from aislerank.plans.book import query
from aislerank.plans.finding import search_cte
from aislerank.plans.ranking import (
    BASIC, CORE, K, basic, brand_cte, category_cte, popular_cte, price_cte, rated, spoken, tags)
from aislerank.session import cut, stored
from aislerank.settings import HYBRID_WEIGHTS, TextModel
from aislerank.sources.driver_tables import catalogue, table

MODEL = TextModel()
# Texts on the way to ``combined_text_tfidf``.
UNUSED_TEXTS = ("about_product", "about_product_clean", "product_name_clean", "category_clean", "combined_text")


def texted(spark, sf):
    return features.add_text(cleaning.add_clean_text(catalogue(spark, sf)))


def fitted(spark, sf):
    """The texts are written first, because the vocabulary and the vectors both read them."""
    return vectors.fit(stored(texted(spark, sf).select("product_id", "combined_text_tfidf")))


def described(spark, sf):
    """The labelled catalogue with its last text, written once; a strategy reads only the columns it names."""
    return stored(features.add_trend(features.labelled(texted(spark, sf))).drop(*UNUSED_TEXTS))


TERMS = f"""{S.FEATURES},
joined AS (SELECT product_id, trim({S.normalise('product_name')} || ' ' || {S.squeeze('category')} || ' ' ||
  {S.normalise(S.description('about_product'))}) AS combined_text FROM catalogue),
texted AS MATERIALIZED (SELECT product_id, combined_text, {S.drop_stops('combined_text')} AS combined_text_tfidf FROM joined),
tok AS (SELECT product_id AS id, list_filter(regexp_extract_all(lower(combined_text_tfidf), '[\\p{{L}}\\p{{N}}_]{{2,}}'),
  lambda w: w NOT IN {S.ENGLISH}) AS u FROM texted),
terms AS MATERIALIZED (SELECT id, list_concat(u, list_transform(range(1, greatest(len(u), 1)), lambda i: u[i] || ' ' || u[i + 1])) AS ts FROM tok)"""

TFIDF = f"""{TERMS},
occ AS MATERIALIZED (SELECT id, term, count(*) AS n FROM (SELECT id, unnest(ts) AS term FROM terms) GROUP BY ALL),
size AS (SELECT count(*) AS nd FROM terms),
vocab AS MATERIALIZED (SELECT row_number() OVER (ORDER BY tf DESC, term) AS t, term, df, tf, ln((1 + nd) / (1 + df)) + 1 AS idf FROM (
  SELECT term, count(*) AS df, sum(n)::BIGINT AS tf FROM occ GROUP BY 1), size
  WHERE df >= {MODEL.min_df} AND df <= nd * {MODEL.max_df} QUALIFY t <= {MODEL.max_features}),
raw_w AS (SELECT id, t, term, (1 + ln(n)) * idf AS w FROM occ JOIN vocab USING (term)),
tfidf AS MATERIALIZED (SELECT id, t, term, {S.rnd('w / sqrt(sum(w * w) OVER (PARTITION BY id))', 12)} AS w FROM raw_w)"""

PAIRS = f"""{TFIDF},
sims AS MATERIALIZED (SELECT a.id AS src, b.id AS dst, {S.rnd('sum(a.w * b.w)', 9)} AS score
  FROM tfidf a JOIN tfidf b ON a.t = b.t AND a.id <> b.id GROUP BY ALL)"""


def near_cte(k: int) -> str:
    return f"""near AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) AS rank FROM sims
  WHERE score > 0 QUALIFY rank <= {k})"""


@query("X1_terms", S.with_(TERMS) + "SELECT id AS product_id, array_to_string(ts, '|') AS terms FROM terms")
def x1(spark, sf):
    return vectors.terms(texted(spark, sf)).select(F.col("id").alias("product_id"), F.array_join("terms", "|").alias("terms"))


@query("X2_vocabulary", S.with_(TFIDF) + f"SELECT t, term, df, tf, {S.rnd('idf', 9)} AS idf FROM vocab")
def x2(spark, sf):
    vocab = vectors.vocabulary(vectors.terms(texted(spark, sf)))
    return vocab.select(F.col("t").cast("bigint").alias("t"), "term", F.col("df").cast("bigint").alias("df"),
                        F.col("tf").cast("bigint").alias("tf"), rounded(F.col("idf"), 9).alias("idf"))


@query("X3_tfidf_weights", S.with_(TFIDF) + f"SELECT id AS product_id, term, {S.rnd('w', 8)} AS w FROM tfidf")
def x3(spark, sf):
    vocab, vecs = fitted(spark, sf)
    return vectors.weights(vecs).join(F.broadcast(vocab.select("t", "term")), "t").select(
        F.col("id").alias("product_id"), "term", rounded(F.col("w"), 8).alias("w"))


@query("X4_top_terms", S.with_(TFIDF) + f"""
SELECT term, {S.rnd('sum(w) / any_value(nd)', 6)} AS importance, {S.rnd('any_value(idf)', 4)} AS idf
FROM tfidf JOIN vocab USING (term), size GROUP BY term ORDER BY importance DESC, term LIMIT 30""")
def x4(spark, sf):
    docs = stored(texted(spark, sf).select("product_id", "combined_text_tfidf"))
    vocab, vecs = vectors.fit(docs)
    return vectors.top_terms(vecs, vocab, docs)


@query("X5_pairwise_cosine", S.with_(PAIRS) + f"""
SELECT src, count(*) AS partners, {S.rnd('sum(score)', 4)} AS total, max(score) AS best FROM sims WHERE score > 0 GROUP BY 1""")
def x5(spark, sf):
    _, vecs = fitted(spark, sf)
    return vectors.similarity_per_document(vecs).withColumn("total", rounded(F.col("total"), 4))


@query("X6_all_pairs_top", S.with_(PAIRS, near_cte(20)) + "SELECT src, dst, score, rank FROM near")
def x6(spark, sf):
    _, vecs = fitted(spark, sf)
    return vectors.neighbours(vecs, 20).select("src", "dst", "score", F.col("rank").cast("bigint").alias("rank"))


@query("X6_approximate_top", S.with_(PAIRS, near_cte(20)) + "SELECT src, dst, score, rank FROM near WHERE score >= 0.97")
def x6_approximate(spark, sf):
    """The part of the lists that random hyperplanes find as good as surely."""
    _, vecs = fitted(spark, sf)
    return vectors.approximate_neighbours(vecs, 20, bits=6, bands=12).filter("score >= 0.97").select(
        "src", "dst", "score", F.col("rank").cast("bigint").alias("rank"))


@query("X7_average_similarity", S.with_(PAIRS) + f"""
SELECT count(*) AS positive_pairs, {S.rnd('avg(score)', 6)} AS avg_similarity FROM sims WHERE score > 0""")
def x7(spark, sf):
    _, vecs = fitted(spark, sf)
    return vectors.average_similarity(vecs)


@query("X7_similarity_histogram", S.with_(PAIRS) + """
SELECT least(floor(score * 10)::BIGINT, 9) AS bin, count(*) AS pairs FROM sims WHERE score > 0.01 GROUP BY 1""")
def x7_histogram(spark, sf):
    _, vecs = fitted(spark, sf)
    return vectors.similarity_histogram(vecs)


_KEYWORDS = f"""keyed AS MATERIALIZED (SELECT product_id, list_distinct(list_filter(regexp_extract_all(lower(combined_text_tfidf), '{text.KEYWORD}'),
  lambda w: length(w) >= 4 AND w NOT IN {S.KEY_STOPS})) AS ks FROM texted)"""


def _matched(source: str) -> str:
    return f"""found AS (SELECT query_id, r.product_id, unnest(list_intersect(q.ks, c.ks)) AS w FROM {source} r
  JOIN keyed q ON q.product_id = r.query_id JOIN keyed c ON c.product_id = r.product_id),
five AS (SELECT query_id, product_id, w, row_number() OVER (PARTITION BY query_id, product_id ORDER BY length(w) DESC, w) AS n FROM found QUALIFY n <= 5),
said AS (SELECT query_id, product_id, string_agg(upper(w[1:1]) || w[2:], ',' ORDER BY n) AS keywords FROM five GROUP BY ALL)"""


@query("X8_matched_keywords", S.with_(TERMS, category_cte(), _KEYWORDS, _matched("cat_r")) + """
SELECT r.query_id, r.product_id, coalesce(keywords, '') AS keywords FROM cat_r r LEFT JOIN said USING (query_id, product_id)""")
def x8(spark, sf):
    df = described(spark, sf)
    recs = strategies.category_similarity(df, strategies.as_queries(df), K).select("query_id", "product_id")
    keys = cut(explain.keyword_table(df, "combined_text_tfidf"))
    return explain.keywords_for(recs, keys).select(
        "query_id", "product_id", F.array_join("matched_keywords", ",").alias("keywords"))


@query("X9_dense_cosine", f"""
WITH flat AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings),
users AS (SELECT label AS user_id, i, avg(x) AS x FROM flat GROUP BY ALL),
un AS (SELECT user_id, sqrt(sum(x * x)) AS n FROM users GROUP BY 1), cn AS (SELECT vec_id, sqrt(sum(x * x)) AS n FROM flat GROUP BY 1),
s AS (SELECT user_id, vec_id, {S.rnd('sum(u.x * f.x) / any_value(un.n * cn.n)', 9)} AS score FROM users u JOIN flat f USING (i)
  JOIN un USING (user_id) JOIN cn USING (vec_id) GROUP BY ALL)
SELECT user_id, vec_id, score, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, vec_id) AS rank FROM s QUALIFY rank <= 20""")
def x9(spark, sf):
    rows = table(spark, sf, "embeddings")
    users = (rows.select(F.col("label").alias("user_id"), F.posexplode("embedding").alias("i", "x"))
             .groupBy("user_id", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
             .groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda e: e["x"]).alias("vector")))
    items = rows.select("vec_id", F.col("embedding").cast("array<double>").alias("vector"))
    ranked = vectors.dense_ranking(users, items, "user_id", "vec_id", 20)
    return ranked.select("user_id", "vec_id", "score", F.col("rank").cast("bigint").alias("rank"))


# ---------------------------------------------------------------- content ranking

CONTENT = f"""con_r AS (SELECT src AS query_id, dst AS product_id, score, rank FROM near)"""
CONTENT_ROWS = """con_x AS (SELECT r.query_id, r.score, r.rank, q.category_l1 AS q_l1, q.category_l2 AS q_l2, q.brand AS q_brand, c.*
  FROM con_r r JOIN features q ON q.product_id = r.query_id JOIN features c ON c.product_id = r.product_id)"""


def content(spark, sf, k=K):
    df = described(spark, sf)
    _, vecs = vectors.fit(df)
    return df, strategies.content_based(df, strategies.as_queries(df), stored(vectors.neighbours(vecs, k)), k)


@query("E1_content_based", S.with_(PAIRS, near_cte(K), CONTENT) + f"SELECT {CORE}, score, least(1.0, score) AS confidence_score FROM con_r")
def e1(spark, sf):
    return basic(content(spark, sf)[1])


_SAME_BRAND = "q_brand = brand AND brand NOT IN ('Unknown', '', 'nan')"
_CONTENT_REASON = f"""list_filter([CASE WHEN {_SAME_BRAND} THEN 'from ' || brand END,
  CASE WHEN q_l2 = category_l2 AND q_l2 <> '' THEN 'in ' || category_l2 WHEN q_l1 = category_l1 AND q_l1 <> '' THEN 'in ' || category_l1 END,
  CASE WHEN score >= 0.85 THEN 'with very similar features' WHEN score >= 0.6 THEN 'with similar specifications' END], lambda t: t IS NOT NULL)"""
_CONTENT_SAID = f"""CASE WHEN len({_CONTENT_REASON}) = 0 THEN 'Similar product based on content analysis'
  ELSE 'Recommended because it is ' || array_to_string({_CONTENT_REASON}, ', ') END AS recommendation_reason"""


@query("E2_content_reason", S.with_(PAIRS, near_cte(K), CONTENT, CONTENT_ROWS) + f"""
SELECT query_id, product_id, {_CONTENT_SAID}, {tags(
    f"CASE WHEN {_SAME_BRAND} THEN 'Same Brand' END",
    "CASE WHEN q_l2 = category_l2 AND q_l2 <> '' THEN 'Same Category' WHEN q_l1 = category_l1 AND q_l1 <> '' THEN 'Similar Category' END",
    "CASE WHEN score >= 0.85 THEN 'Highly Similar' WHEN score >= 0.6 THEN 'Similar Specifications' END",
    "CASE WHEN rating >= 4.0 THEN 'Highly Rated' END")} FROM con_x""")
def e2(spark, sf):
    return spoken(content(spark, sf)[1])


@query("E16_explanation", S.with_(PAIRS, near_cte(K), CONTENT, CONTENT_ROWS, _KEYWORDS, _matched("con_r")) + f"""
SELECT query_id, product_id, product_name AS product, {S.rnd('least(1.0, score)', 3)} AS score, category_l1 AS category,
  CASE WHEN brand IN ('Unknown', '', 'nan') THEN 'N/A' ELSE brand END AS brand, coalesce(keywords, '') AS keywords,
  'Content Based' AS engine, CASE WHEN score >= 0.75 THEN 'High' WHEN score >= 0.5 THEN 'Medium' ELSE 'Low' END AS confidence,
  {_CONTENT_SAID.replace('recommendation_reason', 'primary_reason')} FROM con_x LEFT JOIN said USING (query_id, product_id)""")
def e16(spark, sf):
    df, recs = content(spark, sf)
    keys = cut(explain.keyword_table(df, "combined_text_tfidf"))
    full = explain.explanation(explain.keywords_for(explain.with_catalogue(recs, df), keys))
    r = "reason_document.reason"
    return full.select(
        "query_id", "product_id", "reason_document.product", "reason_document.score", f"{r}.category", f"{r}.brand",
        F.array_join(f"{r}.matched_keywords", ",").alias("keywords"), f"{r}.engine", f"{r}.confidence", f"{r}.primary_reason")


# ---------------------------------------------------------------- the blend


def _norm(cte: str, name: str) -> str:
    return f"""SELECT query_id, product_id, '{name}' AS strategy, CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0::DOUBLE
  ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS ns FROM {cte} WINDOW w AS (PARTITION BY query_id)"""


_W = " ".join(f"WHEN '{n}' THEN {w}::DOUBLE" for n, w in HYBRID_WEIGHTS.items())
BLEND = f"""norms AS MATERIALIZED ({' UNION ALL '.join(_norm(c, n) for c, n in (
    ('cat_r', 'category_similarity'), ('br_r', 'brand_similarity'), ('pr_r', 'price_similarity'), ('po_r', 'popularity'), ('con_r', 'content_based')))}),
sums AS (SELECT query_id, product_id, sum(CASE strategy {_W} END * ns) AS s, max(CASE WHEN strategy = 'content_based' THEN 1 ELSE 0 END) AS from_content
  FROM norms GROUP BY ALL),
hy_s AS (SELECT q.product_id AS query_id, c.product_id, {S.rnd('coalesce(s, 0) + 0.05::DOUBLE * coalesce(c.rating, 0) / 5', 9)} AS score,
    coalesce(from_content, 0) AS from_content
  FROM features q JOIN features c ON q.product_id <> c.product_id
  LEFT JOIN sums ON sums.query_id = q.product_id AND sums.product_id = c.product_id),
hy_r AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, product_id) AS rank,
  max(score) OVER (PARTITION BY query_id) AS top FROM hy_s QUALIFY rank <= {K}),
hybrid AS (SELECT query_id, product_id, rank::BIGINT AS rank, score,
  {S.rnd('CASE WHEN top > 0 THEN least(1.0, score / top) ELSE 0 END', 9)} AS confidence_score, from_content FROM hy_r)"""


def hybrid_ctes(k: int = K) -> tuple[str, ...]:
    return (PAIRS, near_cte(3 * k), CONTENT, category_cte(3 * k), brand_cte(3 * k), price_cte(3 * k), popular_cte(3 * k), BLEND)


def inputs(spark, sf, k=K):
    df = described(spark, sf)
    _, vecs = vectors.fit(df)
    return df.drop("combined_text_tfidf"), stored(vectors.neighbours(vecs, 3 * k))


@query("E19_hybrid", S.with_(*hybrid_ctes()) + f"SELECT {', '.join(BASIC)} FROM hybrid")
def e19(spark, sf):
    df, edges = inputs(spark, sf)
    return basic(hybrid.hybrid(df, strategies.as_queries(df), edges, K))


@query("E20_hybrid_reason", S.with_(*hybrid_ctes()) + f"""
, hy_x AS (SELECT h.query_id, h.from_content, q.category_l1 AS q_l1, q.category_l2 AS q_l2, q.brand AS q_brand, q.price_bucket AS q_bucket, c.*
  FROM hybrid h JOIN features q ON q.product_id = h.query_id JOIN features c ON c.product_id = h.product_id),
sig AS (SELECT *, list_filter([CASE WHEN {_SAME_BRAND} THEN 'from ' || brand END,
  CASE WHEN q_l2 = category_l2 AND q_l2 <> '' THEN 'in ' || category_l2 WHEN q_l1 = category_l1 AND q_l1 <> '' THEN 'in ' || category_l1 END,
  CASE WHEN q_bucket = price_bucket AND q_bucket <> '' THEN price_bucket || ' price range' END,
  CASE WHEN rating >= 4.0 THEN {rated('rating')} END, CASE WHEN from_content = 1 THEN 'similar product specifications' END], lambda t: t IS NOT NULL) AS ss FROM hy_x)
SELECT query_id, product_id, CASE WHEN len(ss) = 0 THEN 'Recommended based on multiple similarity signals'
  ELSE 'Recommended because: ' || array_to_string(ss[1:3], ', ') END AS recommendation_reason, {tags(
    f"CASE WHEN {_SAME_BRAND} THEN 'Same Brand' END",
    "CASE WHEN q_l2 = category_l2 AND q_l2 <> '' THEN 'Same Category' WHEN q_l1 = category_l1 AND q_l1 <> '' THEN 'Similar Category' END",
    "CASE WHEN q_bucket = price_bucket AND q_bucket <> '' THEN 'Similar Price' END",
    "CASE WHEN rating >= 4.5 THEN 'Highly Rated' END", "CASE WHEN popularity_score >= 0.8 THEN 'Best Seller' END",
    "CASE WHEN from_content = 1 THEN 'Similar Specifications' END")} FROM sig""")
def e20(spark, sf):
    df, edges = inputs(spark, sf)
    return spoken(hybrid.hybrid(df, strategies.as_queries(df), edges, K))


_STRANGERS = f"""strangers AS (SELECT 'supplier-' || s_suppkey AS query_id FROM supplier),
best AS (SELECT product_id, popularity_score, row_number() OVER (ORDER BY popularity_score DESC, product_id) AS rank FROM features QUALIFY rank <= {K})"""


@query("E21_unknown_ids", S.with_(*hybrid_ctes(), _STRANGERS) + f"""
SELECT {', '.join(BASIC)}, 'hybrid' AS strategy FROM hybrid WHERE query_id IN (SELECT l_partkey::VARCHAR FROM lineitem)
UNION ALL SELECT query_id, product_id, rank, {S.rnd('popularity_score', 9)}, {S.rnd('popularity_score', 9)}, 'popularity' FROM strangers, best""")
def e21(spark, sf):
    df, edges = inputs(spark, sf)
    ids = table(spark, sf, "lineitem").select(F.col("l_partkey").cast("string").alias("query_id")).distinct().union(
        table(spark, sf, "supplier").select(F.concat(F.lit("supplier-"), "s_suppkey")))
    return hybrid.with_unknown(df, ids, edges, K).select(*BASIC, "strategy")


@query("E22_by_name", S.with_(*hybrid_ctes(), search_cte(1).replace("sums AS", "se_sums AS").replace("FROM sums", "FROM se_sums").replace("sums.product_id", "se_sums.product_id").replace("tok AS", "se_tok AS").replace("FROM tok", "FROM se_tok"),
                              _STRANGERS) + f"""
, hit AS (SELECT query, product_id AS source FROM se_r WHERE rank = 1)
SELECT query, source, product_id, h.rank, score FROM hit JOIN hybrid h ON h.query_id = source
UNION ALL SELECT query, NULL, product_id, rank, {S.rnd('popularity_score', 9)} FROM best, (SELECT query FROM asked WHERE query NOT IN (SELECT query FROM hit))""")
def e22(spark, sf):
    from aislerank.plans.finding import phrases

    df, edges = inputs(spark, sf)
    return hybrid.by_name(df, phrases(spark, sf), edges, K).select("query", "source", "product_id", "rank", "score")
