"""Queries over catalogue look-ups, keyword search and facets."""

from __future__ import annotations

from pyspark.sql import functions as F

from aislerank.operators import search
from aislerank.operators.interactions import validated
from aislerank.plans import sqltext as S
from aislerank.plans.book import query
from aislerank.plans.loading import RAW
from aislerank.plans.ranking import shelf
from aislerank.session import cut
from aislerank.sources.driver_tables import catalogue, interactions, raw_catalogue, table

FEAT = S.with_(S.FEATURES)


@query("Q1_point_lookup", FEAT + """
SELECT product_id, product_name, brand, discounted_price FROM features WHERE product_id IN (
  SELECT json_extract_string(props, '$.k') FROM events)""")
def q1(spark, sf):
    wanted = interactions(spark, sf).select("product_id")
    return search.by_ids(shelf(spark, sf), wanted).select("product_id", "product_name", "brand", "discounted_price")


@query("Q2_page", FEAT + """
SELECT product_id, product_name, category FROM features WHERE contains(category, 'widget') ORDER BY product_id LIMIT 50 OFFSET 20""")
def q2(spark, sf):
    return search.page(catalogue(spark, sf, text=False), 20, 50, "widget").select("product_id", "product_name", "category")


@query("Q3_category_tokens", FEAT + """
SELECT DISTINCT trim(c) AS category FROM (SELECT unnest(string_split(category, '|')) AS c FROM features) ORDER BY 1""")
def q3(spark, sf):
    return search.category_tokens(catalogue(spark, sf, text=False))


@query("Q4_top_categories", FEAT + """
SELECT category_l1, (SELECT count(*) FROM features) AS catalogue_size FROM features GROUP BY 1 ORDER BY 1""")
def q4(spark, sf):
    df = shelf(spark, sf)
    size = df.agg(F.count("*").alias("n")).scalar()
    return search.top_categories(df).select("category_l1", size.alias("catalogue_size"))


@query("Q5_dataset_stats", RAW + """
SELECT count(*) AS total_products, count(DISTINCT category) AS unique_categories,
  count(DISTINCT split_part(category, '|', 1)) AS top_level_count,
  count(*) FILTER (WHERE coalesce(img_link, '') = '') AS missing_images,
  count(*) FILTER (WHERE coalesce(discounted_price, '') = '') AS missing_prices,
  count(*) FILTER (WHERE coalesce(rating, '') = '') AS missing_ratings,
  count(*) - count(DISTINCT product_id) AS duplicate_ids FROM raw""")
def q5(spark, sf):
    return search.dataset_stats(raw_catalogue(spark, sf))


@query("Q5_top_level_counts", RAW + """
SELECT split_part(category, '|', 1) AS category_l1, count(*) AS products FROM raw WHERE category IS NOT NULL GROUP BY 1""")
def q5_counts(spark, sf):
    return search.top_level_counts(raw_catalogue(spark, sf))


@query("Q6_category_tree", FEAT + """
, p AS (SELECT DISTINCT string_split(category, '|') AS parts FROM features),
n AS (SELECT parts, unnest(range(1, len(parts) + 1)) AS i FROM p),
nodes AS (SELECT DISTINCT array_to_string(parts[1:i], '|') AS path, trim(parts[i]) AS name,
  CASE WHEN i > 1 THEN array_to_string(parts[1:i - 1], '|') END AS parent_path FROM n),
numbered AS (SELECT *, row_number() OVER (ORDER BY path) AS id FROM nodes)
SELECT c.id, c.path, c.name, p.id AS parent_id FROM numbered c LEFT JOIN numbered p ON c.parent_path = p.path""")
def q6(spark, sf):
    return search.category_tree(catalogue(spark, sf, text=False))


@query("Q6_brand_dimension", FEAT + """
SELECT row_number() OVER (ORDER BY brand) AS id, brand AS name FROM (SELECT DISTINCT brand FROM features)""")
def q6_brands(spark, sf):
    return search.brand_dimension(shelf(spark, sf))


_WORDS = "list_filter(regexp_split_to_array(trim(lower(product_name)), '\\s+'), lambda w: length(w) >= 3)"


@query("Q7_inverted_index", FEAT + f"SELECT unnest({_WORDS}) AS word, product_id FROM features")
def q7(spark, sf):
    return search.inverted_index(catalogue(spark, sf, text=False))


def phrases(spark, sf):
    """Every product name, the beginnings of names, and nation names that match nothing."""
    parts = table(spark, sf, "part")
    names = parts.select(F.col("p_name").alias("query"))
    starts = parts.select(F.substring("p_name", 1, 3).alias("query"))
    brands = parts.select(F.concat_ws(" ", F.substring_index("p_name", " ", -1), "p_brand").alias("query"))
    nations = table(spark, sf, "nation").select(F.col("n_name").alias("query"))
    return names.union(starts).union(brands).union(nations).distinct()


def search_cte(k: int, where: str = "true") -> str:
    return f"""phrases AS (SELECT p_name AS query FROM part UNION SELECT substr(p_name, 1, 3) FROM part
  UNION SELECT split_part(p_name, ' ', -1) || ' ' || p_brand FROM part UNION SELECT n_name FROM nation),
asked AS (SELECT query, list_filter(regexp_split_to_array(trim(lower(query)), '\\s+'), lambda w: length(w) >= 2) AS ts FROM phrases),
tok AS (SELECT query, len(ts) AS n, unnest(ts) AS token FROM asked),
idx AS (SELECT unnest({_WORDS}) AS word, product_id FROM features WHERE {where}),
words AS (SELECT DISTINCT word FROM idx),
hits AS (SELECT query, n, word, CASE WHEN word = token THEN 2.0::DOUBLE ELSE 0.5::DOUBLE END AS points FROM tok JOIN words ON starts_with(word, token)),
sums AS (SELECT query, n, product_id, sum(points) AS score FROM hits JOIN idx USING (word) GROUP BY ALL),
se_r AS (SELECT query, f.product_id, row_number() OVER (PARTITION BY query ORDER BY score DESC, popularity_score DESC, f.product_id) AS rank,
  score, {S.rnd('least(1.0, score / (n * 2.0)) * 0.7::DOUBLE + popularity_score * 0.3::DOUBLE', 9)} AS confidence_score,
  product_name, brand, category FROM sums JOIN features f ON sums.product_id = f.product_id)"""


@query("Q8_keyword_search", S.with_(S.FEATURES, search_cte(20)) +
       """SELECT query, product_id, rank, score, confidence_score, 'Matched ''' || query || ''' in product catalog' AS recommendation_reason
FROM se_r WHERE rank <= 20""")
def q8(spark, sf):
    return search.search(shelf(spark, sf), phrases(spark, sf), 20)


@query("Q8_search_in_category", S.with_(S.FEATURES, search_cte(20, "lower(category_l1) = 'promo'")) +
       "SELECT query, product_id, rank, score FROM se_r WHERE rank <= 20")
def q8_category(spark, sf):
    return search.search(shelf(spark, sf), phrases(spark, sf), 20, "Promo").select("query", "product_id", "rank", "score")


@query("Q9_suggestions", S.with_(S.FEATURES, search_cte(20)) + """
, kinds AS (SELECT query, product_id, rank, CASE WHEN starts_with(lower(product_name), lower(query)) THEN 1
  WHEN starts_with(lower(brand), lower(query)) THEN 2 WHEN contains(lower(product_name), ' ' || lower(query)) THEN 3
  WHEN contains(lower(category), lower(query)) THEN 4 WHEN contains(lower(product_name), lower(query)) THEN 5 ELSE 6 END::BIGINT AS match_class
  FROM se_r WHERE rank <= 20)
SELECT * FROM (SELECT query, product_id, match_class, row_number() OVER (PARTITION BY query ORDER BY match_class, rank) AS position FROM kinds)
WHERE position <= 6""")
def q9(spark, sf):
    df = shelf(spark, sf)
    return search.suggestions(search.search(df, phrases(spark, sf), 20), df)


@query("Q10_facets", FEAT + """
(SELECT 'brand' AS facet, trim(split_part(brand, '|', 1)) AS value FROM features WHERE brand <> '' GROUP BY 2 ORDER BY 2 LIMIT 8)
UNION ALL (SELECT 'category', trim(split_part(category, '|', 1)) AS value FROM features GROUP BY 2 ORDER BY 2 LIMIT 8)
UNION ALL SELECT 'max_price', (ceil(max(discounted_price) / 100) * 100)::BIGINT::VARCHAR FROM features""")
def q10(spark, sf):
    return search.facets(shelf(spark, sf))


_FILTER = """discounted_price <= 9000 AND rating >= 3.0 AND trim(split_part(category, '|', 1)) IN ('PROMO', 'SMALL')
  AND trim(split_part(brand, '|', 1)) IN ('Brand1', 'Brand2', 'Brand7', 'Brand11')"""


def narrowed(spark, sf):
    return search.faceted(shelf(spark, sf), 9000, 3.0, ["PROMO", "SMALL"], ["Brand1", "Brand2", "Brand7", "Brand11"])


@query("Q11_faceted_filter", FEAT + f"SELECT product_id, brand, category, discounted_price, rating FROM features WHERE {_FILTER}")
def q11(spark, sf):
    return narrowed(spark, sf).select("product_id", "brand", "category", "discounted_price", "rating")


@query("Q12_sort_modes", FEAT + f"""
, f AS (SELECT * FROM features WHERE {_FILTER})
SELECT product_id, row_number() OVER (ORDER BY discounted_price, product_id) AS by_price_asc,
  row_number() OVER (ORDER BY discounted_price DESC, product_id) AS by_price_desc,
  row_number() OVER (ORDER BY rating DESC, product_id) AS by_rating FROM f""")
def q12(spark, sf):
    rows = narrowed(spark, sf).select("product_id", "discounted_price", "rating")
    positions = None
    for mode, name in (("price_asc", "by_price_asc"), ("price_desc", "by_price_desc"), ("rating", "by_rating")):
        ordered = search.position_in(rows, mode, name)
        positions = ordered if positions is None else positions.join(ordered, "product_id")
    return positions


@query("Q12_relevance", S.with_(S.FEATURES, search_cte(20)) + f"""
SELECT query, product_id, row_number() OVER (PARTITION BY query ORDER BY rank, product_id) AS by_relevance,
  row_number() OVER (PARTITION BY query ORDER BY discounted_price, product_id) AS by_price_asc,
  row_number() OVER (PARTITION BY query ORDER BY discounted_price DESC, product_id) AS by_price_desc,
  row_number() OVER (PARTITION BY query ORDER BY rating DESC, product_id) AS by_rating
FROM (SELECT query, product_id, rank FROM se_r WHERE rank <= 20) JOIN (SELECT * FROM features WHERE {_FILTER}) USING (product_id)""")
def q12_relevance(spark, sf):
    found = cut(search.search(shelf(spark, sf), phrases(spark, sf), 20))
    return search.sorted_lists(found, narrowed(spark, sf), {
        "by_relevance": "relevance", "by_price_asc": "price_asc", "by_price_desc": "price_desc", "by_rating": "rating"})


@query("Q13_cart_totals", FEAT + f"""
, cart AS (SELECT DISTINCT user_id::VARCHAR AS session_id, json_extract_string(props, '$.k') AS product_id FROM events WHERE event_type = 'click')
SELECT session_id, count(*) AS items, {S.rnd('sum(coalesce(nullif(discounted_price, 0), nullif(actual_price, 0), 999))', 2)} AS subtotal
FROM cart JOIN features USING (product_id) GROUP BY 1""")
def q13(spark, sf):
    cart = validated(interactions(spark, sf)).filter("event_type = 'cart'")
    return search.cart_totals(cart, catalogue(spark, sf, text=False))


@query("Q14_biggest_categories", FEAT + """
SELECT category_l1, count(*) AS products FROM features GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def q14(spark, sf):
    return search.biggest_categories(shelf(spark, sf))


def _hist(column: str, bins: int, where: str) -> str:
    return FEAT + f"""
, v AS (SELECT {column} AS v FROM features WHERE {where}), b AS (SELECT min(v) AS lo, (max(v) - min(v)) / {bins} AS w FROM v),
i AS (SELECT least(floor((v - lo) / w)::BIGINT, {bins - 1}) AS bin, lo, w FROM v, b)
SELECT bin, {S.rnd('any_value(lo) + any_value(w) * bin', 6)} AS low, count(*) AS products FROM i GROUP BY 1"""


@query("Q15_rating_histogram", _hist("rating", 9, "rating > 0 AND rating <= 5"))
def q15(spark, sf):
    return search.histogram(catalogue(spark, sf, text=False).filter("rating > 0 AND rating <= 5"), "rating", 9)


@query("Q15_discount_histogram", _hist("discount_percentage", 8, "discount_percentage BETWEEN 0 AND 100"))
def q15_discount(spark, sf):
    rows = catalogue(spark, sf, text=False).filter("discount_percentage BETWEEN 0 AND 100")
    return search.histogram(rows, "discount_percentage", 8)
