"""Queries over interaction events and session personalisation."""

from __future__ import annotations

from pyspark.sql import functions as F

from aislerank.functions.numbers import rounded
from aislerank.operators import interactions as I
from aislerank.operators import personal, vectors
from aislerank.plans import sqltext as S
from aislerank.plans.book import query
from aislerank.plans.ranking import BASIC, rated, reviews, tags
from aislerank.plans.similarity import PAIRS, TFIDF, described, near_cte
from aislerank.session import cut, stored
from aislerank.settings import EVENT_WEIGHTS
from aislerank.sources.driver_tables import catalogue, interactions, table

GAP = 6 * 3600
POOL = 50
K = 8

EVENTS = """ev AS MATERIALIZED (SELECT event_id, user_id::VARCHAR AS session_id, json_extract_string(props, '$.k') AS product_id,
  CASE event_type WHEN 'click' THEN 'cart' WHEN 'signup' THEN 'wishlist' WHEN 'purchase' THEN 'purchase' ELSE 'view' END AS event_type,
  event_type AS raw_type, epoch_us(ts) AS us FROM events)"""
FEW = EVENTS + """,
few AS (SELECT event_id, session_id, (product_id::BIGINT % 3)::VARCHAR AS product_id, event_type, us FROM ev)"""


def events(spark, sf):
    return I.validated(interactions(spark, sf))


def timed(df, *columns):
    return df.select(*columns, F.unix_micros("ts").alias("us"))


@query("P1_validated_events", S.with_(EVENTS) + "SELECT event_id, session_id, product_id, event_type, us FROM ev")
def p1(spark, sf):
    return timed(events(spark, sf), "event_id", "session_id", "product_id", "event_type")


@query("I1_repeat_views", S.with_(FEW) + f"""
, flagged AS (SELECT *, event_type = 'view' AND coalesce(lag(product_id) OVER w = product_id AND lag(event_type) OVER w = 'view'
    AND us - lag(us) OVER w < {GAP * 1000000}, false) AS merged FROM few WINDOW w AS (PARTITION BY session_id ORDER BY us, event_id)),
islands AS (SELECT *, sum(CASE WHEN merged THEN 0 ELSE 1 END) OVER (PARTITION BY session_id ORDER BY us, event_id) AS island FROM flagged)
SELECT session_id, any_value(product_id) AS product_id, CASE WHEN count(*) > 1 THEN 'repeat_view' ELSE any_value(event_type) END AS event_type,
  max(us) AS us FROM islands GROUP BY session_id, island""")
def i1(spark, sf):
    few = events(spark, sf).withColumn("product_id", (F.col("product_id").cast("bigint") % 3).cast("string"))
    return timed(I.collapse_repeat_views(few, GAP), "session_id", "product_id", "event_type")


@query("I2_newest_events", S.with_(EVENTS) + """
SELECT session_id, event_id, row_number() OVER (PARTITION BY session_id ORDER BY us DESC, event_id DESC) - 1 AS position FROM ev QUALIFY position < 50""")
def i2(spark, sf):
    return I.newest(events(spark, sf)).select("session_id", "event_id", F.col("position").cast("bigint").alias("position"))


@query("I3_recently_viewed", S.with_(EVENTS) + """
, last AS (SELECT session_id, product_id, max(us) AS us FROM ev WHERE event_type = 'view' GROUP BY ALL)
SELECT session_id, product_id, row_number() OVER (PARTITION BY session_id ORDER BY us DESC, product_id) AS position, position <= 5 AS shown
FROM last QUALIFY position <= 15""")
def i3(spark, sf):
    return I.recently_viewed(events(spark, sf)).select(
        "session_id", "product_id", F.col("position").cast("bigint").alias("position"), "shown")


def removals(spark, sf):
    """Raw error events stand for "remove this product from the list"."""
    return interactions(spark, sf).filter("event_type = 'error'").select("session_id", "product_id", "ts")


_GONE = "gone AS (SELECT session_id, product_id, max(us) AS removed FROM ev WHERE raw_type = 'error' GROUP BY ALL)"


@query("I4_retracted_wishlist", S.with_(EVENTS, _GONE) + """
SELECT event_id, session_id, product_id, event_type FROM ev LEFT JOIN gone USING (session_id, product_id)
WHERE NOT coalesce(event_type = 'wishlist' AND removed >= us, false)""")
def i4(spark, sf):
    return I.retract_wishlist(events(spark, sf), removals(spark, sf)).select("event_id", "session_id", "product_id", "event_type")


@query("I5_wishlist", S.with_(EVENTS) + """
SELECT session_id, product_id FROM ev WHERE event_type = 'wishlist' GROUP BY ALL HAVING count(*) % 2 = 1""")
def i5(spark, sf):
    return I.wishlist(events(spark, sf))


@query("I5_cart", S.with_(EVENTS) + """
, acts AS (SELECT session_id, product_id, us, CASE WHEN event_type = 'cart' THEN 1 ELSE 0 END AS added FROM ev WHERE event_type = 'cart' OR raw_type = 'error')
SELECT session_id, product_id FROM (SELECT *, row_number() OVER (PARTITION BY session_id, product_id ORDER BY us DESC, added DESC) AS n FROM acts)
WHERE n = 1 AND added = 1""")
def i5_cart(spark, sf):
    return I.cart(events(spark, sf), removals(spark, sf))


@query("I6_history", S.with_(EVENTS) + """
SELECT session_id, event_id, row_number() OVER (PARTITION BY session_id ORDER BY us DESC, event_id DESC) - 1 AS position FROM ev""")
def i6(spark, sf):
    return I.positions(events(spark, sf)).select("session_id", "event_id", "position")


@query("I6_history_from_list", """
WITH l AS (SELECT c_custkey::VARCHAR AS session_id, string_split(c_custkey || ', ' || c_nationkey || ',,' || c_mktsegment || ' ', ',') AS xs FROM customer),
k AS (SELECT session_id, list_filter(list_transform(xs, lambda x: trim(x)), lambda x: x <> '') AS xs FROM l)
SELECT session_id, unnest(range(len(xs))) AS position, unnest(xs) AS product_id FROM k""")
def i6_list(spark, sf):
    lists = table(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias("session_id"),
        F.concat("c_custkey", F.lit(", "), "c_nationkey", F.lit(",,"), "c_mktsegment", F.lit(" ")).alias("history"))
    return I.history_from_list(lists).select("session_id", F.col("position").cast("bigint").alias("position"), "product_id")


HISTORY = EVENTS + """,
firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id, product_id ORDER BY us DESC, event_id DESC) AS n FROM ev)
  WHERE n = 1 AND product_id IN (SELECT p_partkey::VARCHAR FROM part)),
hist AS MATERIALIZED (SELECT session_id, product_id, event_type, row_number() OVER (PARTITION BY session_id ORDER BY us DESC, event_id DESC) - 1 AS position FROM firsts)"""
_BASE = "CASE event_type " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in EVENT_WEIGHTS.items()) + " ELSE 1.0::DOUBLE END"


def histories(spark, sf):
    return personal.history(interactions(spark, sf), catalogue(spark, sf, text=False))


@query("N8_first_occurrences", S.with_(EVENTS) + """
SELECT session_id, product_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY session_id, product_id ORDER BY us DESC, event_id DESC) AS n FROM ev) WHERE n = 1""")
def n8(spark, sf):
    return I.first_occurrences(events(spark, sf)).select("session_id", "product_id", "event_id")


@query("P2_known_history", S.with_(EVENTS) + """
SELECT event_id, session_id, product_id FROM ev WHERE product_id IN (SELECT p_partkey::VARCHAR FROM part WHERE p_size > 10)""")
def p2(spark, sf):
    shown = table(spark, sf, "part").filter("p_size > 10").select(F.col("p_partkey").cast("string").alias("product_id"))
    return personal.in_catalogue(events(spark, sf), shown).select("event_id", "session_id", "product_id")


@query("P3_item_weights", S.with_(HISTORY) + f"""
SELECT session_id, product_id, position, {S.rnd(f'{_BASE} * pow(0.85, position)', 9)} AS weight FROM hist""")
def p3(spark, sf):
    return personal.item_weights(histories(spark, sf)).select(
        "session_id", "product_id", "position", rounded(F.col("weight"), 9).alias("weight"))


PROFILE = f"""{TFIDF}, {HISTORY},
summed AS (SELECT session_id, t, sum({_BASE} * pow(0.85, position) * w) AS w FROM hist JOIN tfidf ON tfidf.id = hist.product_id GROUP BY ALL),
profile AS MATERIALIZED (SELECT session_id, t, {S.rnd('w / sqrt(sum(w * w) OVER (PARTITION BY session_id))', 12)} AS w FROM summed)"""
POOLED = f"""{PROFILE},
scores AS (SELECT session_id, id AS product_id, {S.rnd('sum(p.w * v.w)', 9)} AS score FROM profile p JOIN tfidf v USING (t) GROUP BY ALL),
pool AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY score DESC, product_id) AS rank FROM scores
  WHERE score > 0 AND (session_id, product_id) NOT IN (SELECT (session_id, product_id) FROM hist) QUALIFY rank <= {POOL})"""


def prepared(spark, sf):
    df = described(spark, sf)
    _, vecs = vectors.fit(df)
    return df, vecs, cut(personal.history(interactions(spark, sf), df))


@query("P4_user_profile", S.with_(PROFILE) + f"SELECT session_id, t, {S.rnd('w', 8)} AS w FROM profile")
def p4(spark, sf):
    _, vecs, hist = prepared(spark, sf)
    return vectors.weights(personal.profiles(hist, vecs)).select(
        F.col("id").alias("session_id"), F.col("t").cast("bigint").alias("t"), rounded(F.col("w"), 8).alias("w"))


SIGNAL = f"""kinds AS (SELECT session_id, event_type, sum({_BASE}) AS weight, min(position) AS first_at FROM hist GROUP BY ALL),
signal AS (SELECT session_id, event_type AS dominant_signal FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY weight DESC, first_at) AS n FROM kinds) WHERE n = 1)"""


@query("P5_dominant_signal", S.with_(HISTORY, SIGNAL) + "SELECT session_id, dominant_signal FROM signal")
def p5(spark, sf):
    return personal.dominant_signal(histories(spark, sf))


@query("P6_candidate_pool", S.with_(POOLED) + "SELECT session_id, product_id, score, rank FROM pool")
def p6(spark, sf):
    _, vecs, hist = prepared(spark, sf)
    pool = personal.candidate_pool(personal.profiles(hist, vecs), vecs, hist, POOL)
    return pool.select("session_id", "product_id", "score", F.col("rank").cast("bigint").alias("rank"))


def mmr_cte(pool: str, k: int) -> str:
    """The greedy choice written out step by step over a pool (session_id, product_id, score, rank)."""
    steps = [f"m1 AS MATERIALIZED (SELECT session_id, product_id, score, rank AS place, 1 AS rank FROM {pool} WHERE rank = 1)"]
    for i in range(2, k + 1):
        steps.append(f"""m{i} AS MATERIALIZED (SELECT * FROM m{i - 1} UNION ALL SELECT session_id, product_id, score, place, {i} FROM (
  SELECT session_id, product_id, score, place, row_number() OVER (PARTITION BY session_id ORDER BY 0.6::DOUBLE * score - 0.4::DOUBLE * worst DESC, place) AS n FROM (
    SELECT p.session_id, p.product_id, p.score, p.rank AS place, max(coalesce(s.score, 0)) AS worst
    FROM {pool} p JOIN m{i - 1} c ON c.session_id = p.session_id LEFT JOIN sims s ON s.src = p.product_id AND s.dst = c.product_id
    WHERE (p.session_id, p.product_id) NOT IN (SELECT (session_id, product_id) FROM m{i - 1}) GROUP BY ALL)) WHERE n = 1)""")
    return ",\n".join(steps)


MMR_OUT = f"SELECT session_id, product_id, score, rank::BIGINT AS rank FROM m{K}"
SIMS = PAIRS.replace(TFIDF + ",", "").strip()


def picks(spark, sf):
    df, vecs, hist = prepared(spark, sf)
    pool = stored(personal.candidate_pool(personal.profiles(hist, vecs), vecs, hist, POOL))
    return df, hist, pool, vecs


@query("P7_mmr", S.with_(POOLED, SIMS, mmr_cte("pool", K)) + MMR_OUT)
def p7(spark, sf):
    _, _, pool, vecs = picks(spark, sf)
    return personal.mmr(pool, vecs, K)


INTERESTS = """shelves AS (SELECT session_id, coalesce(nullif(category_l2, ''), category_l1) AS shelf, count(*) AS n FROM hist JOIN features USING (product_id) GROUP BY ALL),
top2 AS (SELECT session_id, shelf, row_number() OVER (PARTITION BY session_id ORDER BY n DESC, shelf) AS r FROM shelves QUALIFY r <= 2),
liked AS (SELECT session_id, list(shelf ORDER BY r) AS interests FROM top2 GROUP BY 1)"""


@query("P8_interests", S.with_(S.FEATURES, HISTORY, INTERESTS) + "SELECT session_id, array_to_string(interests, ',') AS interests FROM liked")
def p8(spark, sf):
    df = described(spark, sf)
    hist = personal.history(interactions(spark, sf), df)
    return personal.interests(hist, df).select("session_id", F.array_join("interests", ",").alias("interests"))


def _arm(signal: str, close: str, other: str) -> str:
    return (f"WHEN dominant_signal = '{signal}' THEN CASE WHEN list_contains(interests, category_l2) "
            f"THEN '{close} (' || category_l2 || ')' ELSE '{other}' END")


_SAID = "CASE " + " ".join([
    _arm("wishlist", "Based on products in your wishlist", "Recommended based on your wishlist items"),
    _arm("cart", "Related to items in your cart", "Complements items in your shopping cart"),
    _arm("purchase", "Inspired by your recent purchase", "Recommended based on your recent purchase history"),
    "WHEN list_contains(interests, category_l2) THEN 'Matches your recent interest in ' || category_l2",
    "WHEN list_contains(interests, category_l1) THEN 'Recommended based on your interest in ' || category_l1",
    "WHEN score >= 0.4 THEN 'Similar to products you recently explored'",
    "WHEN score >= 0.2 THEN 'Related to your recent browsing session'",
    "ELSE 'Curated pick based on your session' END"])
_TAG = """CASE WHEN dominant_signal = 'wishlist' THEN 'Wishlist Affinity' WHEN dominant_signal = 'cart' THEN 'Cart Affinity'
  WHEN dominant_signal = 'purchase' THEN 'Purchase Affinity' WHEN list_contains(interests, category_l2) OR list_contains(interests, category_l1) THEN 'Category Match'
  WHEN score >= 0.4 THEN 'High Similarity' WHEN score >= 0.2 THEN 'Session Affinity' ELSE 'Session Curated' END"""


@query("P9_personal_reason", S.with_(POOLED, SIGNAL, INTERESTS) + f"""
SELECT session_id AS query_id, product_id, {_SAID} AS recommendation_reason,
  {tags("'Personalized'", _TAG, "CASE WHEN rating >= 4.3 THEN 'Top Rated' END")}
FROM pool JOIN features USING (product_id) JOIN signal USING (session_id) LEFT JOIN liked USING (session_id)""")
def p9(spark, sf):
    df, hist, pool, _ = picks(spark, sf)
    rows = personal.personalised(pool, hist, df)
    return rows.select("query_id", "product_id", "recommendation_reason", F.array_join("reason_tags", ",").alias("tags"))


MODES = f"""{POOLED},
{SIMS},
{mmr_cte("pool", K)},
heat AS (SELECT *, least(greatest(popularity_score, 0), 1) * (1 + ln(1 + greatest(coalesce(rating_count, 0), 0)) * 0.95) AS heat FROM features),
trend AS (SELECT * EXCLUDE (heat), {S.rnd('heat / (SELECT max(heat) FROM heat)', 9)} AS trending_score FROM heat),
shown AS (SELECT session_id AS query_id, product_id, rank, score, 'personalized' AS mode FROM m{K}),
hot AS (SELECT product_id, trending_score, row_number() OVER (ORDER BY trending_score DESC, product_id) AS rank FROM trend QUALIFY rank <= {K}),
asked AS (SELECT c_custkey::VARCHAR AS query_id FROM customer),
modes AS (SELECT * FROM shown WHERE query_id IN (SELECT query_id FROM asked)
  UNION ALL SELECT query_id, product_id, rank, trending_score AS score,
    CASE WHEN query_id IN (SELECT session_id FROM hist) THEN 'fallback' ELSE 'cold_start' END
  FROM asked, hot WHERE query_id NOT IN (SELECT query_id FROM shown))"""


def moded(spark, sf):
    """Modes over every customer as a session, personal rows in their re-ranked order."""
    df, hist, pool, vecs = picks(spark, sf)
    sessions = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("session_id"))
    personal_rows = personal.personalised(stored(personal.mmr(pool, vecs, K)), hist, df)
    asked = personal_rows.join(sessions.withColumnRenamed("session_id", "query_id"), "query_id", "left_semi")
    return df, personal.with_modes(asked, sessions, hist, df, K)


@query("P10_modes", S.with_(MODES) + "SELECT query_id, product_id, rank, score, mode FROM modes")
def p10(spark, sf):
    return moded(spark, sf)[1].select("query_id", "product_id", "rank", "score", "mode")


@query("P11_output_rows", S.with_(MODES) + f"""
SELECT query_id, product_id, m.rank, p_name AS product_name, coalesce(nullif(f.discounted_price, 0), 0) AS price, f.actual_price,
  coalesce(nullif(f.rating, 0), 4.0) AS rating, coalesce(nullif(f.rating_count, 0), 10)::BIGINT AS rating_count, f.brand, f.category,
  {S.rnd('least(1.0, m.score)', 9)} AS score, CASE WHEN least(1.0, m.score) >= 0.75 THEN 'High' WHEN least(1.0, m.score) >= 0.5 THEN 'Medium' ELSE 'Low' END AS confidence_grade
FROM modes m JOIN features f USING (product_id) JOIN part ON p_partkey::VARCHAR = product_id""")
def p11(spark, sf):
    df, rows = moded(spark, sf)
    # Some serving fields are missing or zero, so that the fall-backs are taken.
    key = F.col("product_id").cast("bigint")
    serving = df.select(
        "product_id", F.substring_index("product_name", " ", -2).alias("product_name"),
        F.when(key % 3 != 0, F.col("discounted_price")).otherwise(0.0).alias("discounted_price"), "actual_price",
        "discount_percentage", F.when(key % 5 != 0, F.col("rating")).alias("rating"),
        F.when(key % 7 != 0, F.col("rating_count")).otherwise(float("nan")).alias("rating_count"), "category")
    return personal.shaped(rows, serving).drop("discount_percentage", "recommendation_reason")


@query("P12_single_item", S.with_(PAIRS, near_cte(POOL), "single AS (SELECT src AS session_id, dst AS product_id, score, rank FROM near)",
                                  mmr_cte("single", K)) + MMR_OUT)
def p12(spark, sf):
    df = described(spark, sf)
    _, vecs = vectors.fit(df)
    near = vectors.neighbours(vecs, POOL).select(
        F.col("src").alias("session_id"), F.col("dst").alias("product_id"), "score", F.col("rank").cast("bigint").alias("rank"))
    return personal.mmr(near, vecs, K)


_TREND_SAID = f"""'Trending #' || h.rank || ' — ' || array_to_string(list_filter(['in ' || category_l1,
  CASE WHEN rating >= 4.0 THEN {rated('rating')} END, CASE WHEN rating_count >= 500 THEN {reviews('rating_count')} END], lambda t: t IS NOT NULL), ', ')"""


@query("P_sessions_end_to_end", S.with_(MODES, SIMS, mmr_cte("pool", K), SIGNAL, INTERESTS) + f"""
SELECT session_id AS query_id, product_id, rank::BIGINT AS rank, score, least(1.0, score) AS confidence_score, 'personalized' AS mode, {_SAID} AS recommendation_reason
FROM m{K} JOIN features USING (product_id) JOIN signal USING (session_id) LEFT JOIN liked USING (session_id)
UNION ALL SELECT query_id, h.product_id, h.rank, h.trending_score, h.trending_score,
  CASE WHEN query_id IN (SELECT session_id FROM hist) THEN 'fallback' ELSE 'cold_start' END, {_TREND_SAID}
FROM asked, hot h JOIN trend t ON t.product_id = h.product_id WHERE query_id NOT IN (SELECT session_id FROM m{K})""")
def p_all(spark, sf):
    df = described(spark, sf)
    _, vecs = vectors.fit(df)
    sessions = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("session_id"))
    rows = personal.recommend_sessions(interactions(spark, sf), sessions, df, vecs, K)
    return rows.select(*BASIC, "mode", "recommendation_reason")
