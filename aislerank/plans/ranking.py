"""Queries over the ranking strategies that need no text vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from aislerank import settings
from aislerank.functions.numbers import rounded
from aislerank.operators import features, strategies
from aislerank.plans import sqltext as S
from aislerank.plans.book import query
from aislerank.plans.loading import TREND
from aislerank.session import stored
from aislerank.sources.driver_tables import catalogue

K = 10
# Complementary top levels for the part types of the given tables.
COMPLEMENTS = {
    "ECONOMY": ["STANDARD", "PROMO", "SMALL"], "STANDARD": ["ECONOMY", "MEDIUM"],
    "PROMO": ["LARGE"], "SMALL": ["PROMO", "MEDIUM"],
}


def shelf(spark, sf):
    """The labelled catalogue, written once because every strategy reads some of its columns several times."""
    return stored(features.add_trend(features.labelled(catalogue(spark, sf, text=False))))


def rated(r: str) -> str:
    return f"'rated ' || {S.fmt(r, 1)} || '/5'"


def reviews(c: str) -> str:
    return f"{S.fmt(c, 0)} || ' reviews'"


def category_cte(k: int = K) -> str:
    return f"""cat_p AS (SELECT q.product_id AS query_id, c.*,
    CASE WHEN q.category_l2 <> '' AND q.category_l2 = c.category_l2 THEN 1.0::DOUBLE
         WHEN q.category_l1 <> '' AND q.category_l1 = c.category_l1 THEN 0.6::DOUBLE ELSE 0 END AS match
  FROM features q JOIN features c ON q.product_id <> c.product_id AND (q.category_l2 = c.category_l2 OR q.category_l1 = c.category_l1)),
cat_r AS (SELECT *, {S.rnd('match * 0.7::DOUBLE + popularity_score * 0.3::DOUBLE', 9)} AS score FROM
  (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY match DESC, popularity_score DESC, product_id) AS rank FROM cat_p WHERE match > 0)
  WHERE rank <= {k})"""


def brand_cte(k: int = K) -> str:
    return f"""br_p AS (SELECT q.product_id AS query_id, q.brand AS q_brand, c.* FROM features q JOIN features c
    ON q.product_id <> c.product_id AND CASE WHEN q.brand NOT IN ('Unknown', 'nan', '') THEN q.brand = c.brand ELSE q.category_l1 = c.category_l1 END),
br_r AS (SELECT *, {S.rnd('coalesce(nullif(popularity_score, 0), 0.5)', 9)} AS score FROM
  (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY popularity_score DESC, product_id) AS rank FROM br_p) WHERE rank <= {k})"""


_ADJ = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in settings.ADJACENT_BUCKET.items())


def price_cte(k: int = K) -> str:
    return f"""pr_p AS (SELECT q.product_id AS query_id, c.*,
    CASE WHEN q.price_bucket = c.price_bucket AND q.discounted_price > 0 AND c.discounted_price > 0 THEN
           CASE WHEN abs(c.discounted_price - q.discounted_price) / q.discounted_price <= 0.2::DOUBLE THEN 1.0::DOUBLE ELSE 0.7::DOUBLE END
         WHEN c.price_bucket = CASE q.price_bucket {_ADJ} END THEN 0.4::DOUBLE ELSE 0 END AS match
  FROM features q JOIN features c ON q.product_id <> c.product_id),
pr_r AS (SELECT *, {S.rnd('match * 0.65::DOUBLE + popularity_score * 0.35::DOUBLE', 9)} AS score FROM
  (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY match DESC, popularity_score DESC, product_id) AS rank FROM pr_p WHERE match > 0)
  WHERE rank <= {k})"""


def popular_cte(k: int = K, name: str = "po", score: str = "popularity_score", source: str = "features", where: str = "true",
                queries: str = "features") -> str:
    return f"""{name}_c AS (SELECT category_l1, count(*) AS members FROM {source} WHERE {where} AND category_l1 <> '' GROUP BY 1),
{name}_p AS (SELECT q.product_id AS query_id, c.* FROM {queries} q LEFT JOIN {name}_c n ON q.category_l1 = n.category_l1
  JOIN (SELECT * FROM {source} WHERE {where}) c ON q.product_id <> c.product_id
    AND (coalesce(n.members, 0) < {max(3, k)} OR c.category_l1 = q.category_l1)),
{name}_r AS (SELECT *, {S.rnd(score, 9)} AS score FROM
  (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {score} DESC, product_id) AS rank FROM {name}_p) WHERE rank <= {k})"""


CORE = "query_id, product_id, rank::BIGINT AS rank"
BASIC = ("query_id", "product_id", "rank", "score", "confidence_score")
SPOKEN = ("query_id", "product_id", "recommendation_reason")


def basic(df):
    return df.select(*BASIC)


def spoken(df):
    return df.select(*SPOKEN, F.array_join("reason_tags", ",").alias("tags"))


def tags(*items: str) -> str:
    return "array_to_string(list_filter([" + ", ".join(items) + "], lambda t: t IS NOT NULL), ',') AS tags"


_HIGH = "CASE WHEN rating >= 4.0 THEN 'Highly Rated' END"


@query("E3_category_similarity", S.with_(S.FEATURES, category_cte()) +
       f"SELECT {CORE}, score, least(1.0, score) AS confidence_score FROM cat_r")
def e3(spark, sf):
    df = shelf(spark, sf)
    return basic(strategies.category_similarity(df, strategies.as_queries(df), K))


@query("E4_category_reason", S.with_(S.FEATURES, category_cte()) + f"""
SELECT query_id, product_id, CASE WHEN match >= 1 THEN 'From the same category: ' || coalesce(nullif(category_l2, ''), category_l1)
    ELSE 'From a related category: ' || category_l1 END || CASE WHEN rating >= 4.0 THEN ' — ' || {rated('rating')} ELSE '' END AS recommendation_reason,
  {tags("CASE WHEN match >= 1 THEN 'Same Category' ELSE 'Similar Category' END", _HIGH)} FROM cat_r""")
def e4(spark, sf):
    df = shelf(spark, sf)
    return spoken(strategies.category_similarity(df, strategies.as_queries(df), K))


@query("E5_brand_similarity", S.with_(S.FEATURES, brand_cte()) +
       f"SELECT {CORE}, score, {S.rnd('least(1.0, score + 0.2::DOUBLE)', 9)} AS confidence_score FROM br_r")
def e5(spark, sf):
    df = shelf(spark, sf)
    return basic(strategies.brand_similarity(df, strategies.as_queries(df), K))


@query("E6_brand_reason", S.with_(S.FEATURES, brand_cte()) + f"""
SELECT query_id, product_id, array_to_string(list_filter(['Also from ' || q_brand, CASE WHEN rating >= 4.0 THEN {rated('rating')} END,
  CASE WHEN rating_count >= 1000 THEN {reviews('rating_count')} END], lambda t: t IS NOT NULL), ' — ') AS recommendation_reason,
  {tags("'Same Brand'", _HIGH)} FROM br_r""")
def e6(spark, sf):
    df = shelf(spark, sf)
    return spoken(strategies.brand_similarity(df, strategies.as_queries(df), K))


@query("E7_price_similarity", S.with_(S.FEATURES, price_cte()) +
       f"SELECT {CORE}, score, least(1.0, score) AS confidence_score FROM pr_r")
def e7(spark, sf):
    df = shelf(spark, sf)
    return basic(strategies.price_similarity(df, strategies.as_queries(df), K))


@query("E8_price_reason", S.with_(S.FEATURES, price_cte()) + f"""
SELECT query_id, product_id, CASE WHEN match >= 1 THEN 'Similar price range: Rs.' || {S.fmt('discounted_price', 0)}
    WHEN match >= 0.7 THEN 'In the same ' || price_bucket || ' price tier' ELSE 'In a nearby ' || price_bucket || ' price range' END AS recommendation_reason,
  {tags("CASE WHEN match >= 1 THEN 'Similar Price' WHEN match >= 0.7 THEN 'Same Price Tier' ELSE 'Nearby Price Range' END")} FROM pr_r""")
def e8(spark, sf):
    df = shelf(spark, sf)
    return spoken(strategies.price_similarity(df, strategies.as_queries(df), K))


@query("E9_popularity", S.with_(S.FEATURES, popular_cte()) + f"SELECT {CORE}, score, score AS confidence_score FROM po_r")
def e9(spark, sf):
    df = shelf(spark, sf)
    return basic(strategies.popularity(df, strategies.as_queries(df), K))


@query("E10_popularity_reason", S.with_(S.FEATURES, popular_cte()) + f"""
SELECT query_id, product_id, 'Best seller — ' || array_to_string(list_filter([CASE WHEN rating >= 4.0 THEN {rated('rating')} END,
  CASE WHEN rating_count >= 1000 THEN {reviews('rating_count')} END, 'in ' || category_l1], lambda t: t IS NOT NULL), ', ') AS recommendation_reason,
  {tags("'Best Seller'", "CASE WHEN rating >= 4.5 THEN 'Top Rated' END")} FROM po_r""")
def e10(spark, sf):
    df = shelf(spark, sf)
    return spoken(strategies.popularity(df, strategies.as_queries(df), K))


_TR = popular_cte(12, "tr", "trending_score", "trend", "coalesce(rating_count, 0) >= 5", "trend")


@query("E11_trending", S.with_(TREND, _TR) + f"SELECT {CORE}, score, score AS confidence_score FROM tr_r")
def e11(spark, sf):
    df = shelf(spark, sf)
    return basic(strategies.trending(df, strategies.as_queries(df), 12))


@query("E12_trending_reason", S.with_(TREND, _TR) + f"""
SELECT query_id, product_id, 'Trending #' || rank || ' — ' || array_to_string(list_filter(['in ' || category_l1,
  CASE WHEN rating >= 4.0 THEN {rated('rating')} END, CASE WHEN rating_count >= 500 THEN {reviews('rating_count')} END],
  lambda t: t IS NOT NULL), ', ') AS recommendation_reason, {tags("'Trending'", "'Trending in ' || category_l1")} FROM tr_r""")
def e12(spark, sf):
    df = shelf(spark, sf)
    return spoken(strategies.trending(df, strategies.as_queries(df), 12))


_LINKS = ", ".join(f"('{a}', '{b}')" for a, bs in COMPLEMENTS.items() for b in bs)
_FBT = f"""links(a, b) AS (VALUES {_LINKS}),
fb_p AS (SELECT q.product_id AS query_id, c.*, CASE WHEN q.category_l1 = c.category_l1 THEN 0.85::DOUBLE ELSE 0.65::DOUBLE END AS match
  FROM features q JOIN features c ON q.product_id <> c.product_id AND (
    (q.category_l1 = c.category_l1 AND q.category_l2 <> c.category_l2)
    OR (q.category_l1 <> c.category_l1 AND (q.category_l1, c.category_l1) IN (SELECT (a, b) FROM links)))),
fb_s AS (SELECT *, {S.rnd('match * 0.6::DOUBLE + popularity_score * 0.4::DOUBLE', 9)} AS score FROM fb_p),
fb_r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, product_id) AS rank FROM fb_s) WHERE rank <= {K})"""


@query("E13_bought_together", S.with_(S.FEATURES, _FBT) + f"SELECT {CORE}, score, least(1.0, score) AS confidence_score FROM fb_r")
def e13(spark, sf):
    df = shelf(spark, sf)
    return basic(strategies.bought_together(df, strategies.as_queries(df), K, COMPLEMENTS))


@query("E14_bought_together_reason", S.with_(S.FEATURES, _FBT) + f"""
SELECT query_id, product_id, CASE WHEN match >= 0.8 THEN 'Customers often buy this with ' || category_l2 || ' items'
  ELSE 'Customers who bought this also bought this product' END AS recommendation_reason,
  {tags("'Frequently Bought Together'", _HIGH)} FROM fb_r""")
def e14(spark, sf):
    df = shelf(spark, sf)
    return spoken(strategies.bought_together(df, strategies.as_queries(df), K, COMPLEMENTS))


@query("E15_confidence_grade", S.with_(S.FEATURES, category_cte()) + """
SELECT query_id, product_id, CASE WHEN score >= 0.75 THEN 'High' WHEN score >= 0.5 THEN 'Medium' ELSE 'Low' END AS confidence_grade FROM cat_r""")
def e15(spark, sf):
    df = shelf(spark, sf)
    recs = strategies.category_similarity(df, strategies.as_queries(df), K)
    return recs.select("query_id", "product_id", strategies.grade(F.col("confidence_score")).alias("confidence_grade"))


@query("E17_enriched", S.with_(S.FEATURES, brand_cte()) + """
SELECT query_id, product_id, rank::BIGINT AS rank, product_name, category, category_l1, category_l2, brand,
  discounted_price AS price, actual_price, discount_percentage, rating, rating_count::BIGINT AS rating_count,
  popularity_score, price_bucket, img_link, product_link FROM br_r""")
def e17(spark, sf):
    from aislerank.operators.explain import with_catalogue

    df = shelf(spark, sf)
    recs = strategies.brand_similarity(df, strategies.as_queries(df), K)
    return with_catalogue(recs, df).select(
        "query_id", "product_id", "rank", "product_name", "category", "category_l1", "category_l2", "brand", "price",
        "actual_price", "discount_percentage", "rating", "rating_count", "popularity_score", "price_bucket",
        "img_link", "product_link")


@query("E18_normalised_scores", S.with_(S.FEATURES, price_cte()) + f"""
SELECT query_id, product_id, {S.rnd('''CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0
  ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END''', 9)} AS norm_score
FROM pr_r WINDOW w AS (PARTITION BY query_id)""")
def e18(spark, sf):
    from aislerank.operators.hybrid import normalised

    df = shelf(spark, sf)
    recs = strategies.price_similarity(df, strategies.as_queries(df), K)
    return normalised(recs).select("query_id", "product_id", rounded(F.col("norm_score"), 9).alias("norm_score"))
