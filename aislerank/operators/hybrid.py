"""The weighted blend of the strategies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aislerank.functions.numbers import rounded
from aislerank.operators import strategies
from aislerank.operators.skew import salted_join
from aislerank.operators.strategies import QUERY_FIELDS
from aislerank.session import cut, stored
from aislerank.settings import HYBRID_WEIGHTS


def normalised(recs: DataFrame) -> DataFrame:
    """Min-max per query and strategy; a list of equal scores becomes all 1."""
    per_list = Window.partitionBy("query_id", "strategy")
    low, high = F.min("score").over(per_list), F.max("score").over(per_list)
    return recs.withColumn(
        "norm_score", F.when(high == low, 1.0).otherwise((F.col("score") - low) / (high - low)))


def run_strategies(catalogue: DataFrame, queries: DataFrame, edges: DataFrame | None, k: int,
                   weights: dict = HYBRID_WEIGHTS) -> DataFrame:
    """Every weighted strategy at 3k, as (query_id, product_id, strategy, score, rating)."""
    n = 3 * k
    runs = {
        "category_similarity": lambda: strategies.category_similarity(catalogue, queries, n),
        "brand_similarity": lambda: strategies.brand_similarity(catalogue, queries, n),
        "price_similarity": lambda: strategies.price_similarity(catalogue, queries, n),
        "popularity": lambda: strategies.popularity(catalogue, queries, n),
    }
    rating = F.coalesce("c_rating", F.lit(0.0)).alias("rating")
    parts = [run().select("query_id", "product_id", "strategy", "score", rating)
             for name, run in runs.items() if weights.get(name, 0) > 0]
    if edges is not None and weights.get("content_based", 0) > 0:
        near = edges.filter(F.col("rank") <= n).select(
            F.col("src").alias("query_id"), F.col("dst").alias("product_id"),
            F.lit("content_based").alias("strategy"), "score")
        rated = salted_join(near, catalogue.select("product_id", F.coalesce("rating", F.lit(0.0)).alias("rating")), "product_id")
        parts.append(rated.join(queries.select("query_id"), "query_id", "left_semi"))
    return reduce(DataFrame.unionByName, parts)


def blend(catalogue: DataFrame, queries: DataFrame, edges: DataFrame | None, k: int = 10,
          weights: dict = HYBRID_WEIGHTS) -> DataFrame:
    """(query_id, product_id, rank, score, top, from_content): the k best by weighted sum.

    The lists are shuffled once, by query; the normalisation, the sum per candidate and the
    ranking all use that partitioning.

    The rating signal covers the whole catalogue.  A product in no list scores at most
    ``weight * best rating / 5``, so the overall best by rating are looked at only for queries whose
    k-th score does not already beat that, and the first k + |lists| + 1 of them then suffice.
    """
    share = weights.get("rating", 0.0)
    ratings = catalogue.select("product_id", F.coalesce("rating", F.lit(0.0)).alias("rating"))
    listed = run_strategies(catalogue, queries, edges, k, weights)
    listed = listed.repartition("query_id")
    weight = reduce(
        lambda c, w: c.when(F.col("strategy") == w[0], F.lit(float(w[1]))),
        list(weights.items())[1:], F.when(F.col("strategy") == list(weights)[0], F.lit(float(list(weights.values())[0]))))
    summed = normalised(listed).groupBy("query_id", "product_id").agg(
        F.sum(weight * F.col("norm_score")).alias("s"), F.first("rating").alias("rating"),
        F.max((F.col("strategy") == "content_based").cast("int")).alias("from_content"))
    scored = summed.withColumn("score", rounded(F.col("s") + share * F.col("rating") / 5, 9))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("product_id"))
    best = (
        scored.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k)
        .groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct(
            (-F.col("score")).alias("s"), F.col("product_id").alias("id"), F.col("from_content").alias("fc")))).alias("got")))
    if share > 0:
        best = _with_ratings(best, ratings, k, share, reach=k + 3 * k * 5 + 1)
    rows = best.select("query_id", F.posexplode(F.slice("got", 1, k)).alias("p", "e"), F.col("got")[0]["s"].alias("top"))
    return rows.select(
        "query_id", F.col("e.id").alias("product_id"), (F.col("p") + 1).alias("rank"),
        (-F.col("e.s")).alias("score"), (-F.col("top")).alias("top"), F.col("e.fc").alias("from_content"))


def _with_ratings(best: DataFrame, ratings: DataFrame, k: int, share: float, reach: int) -> DataFrame:
    alone = ratings.select("product_id", rounded(share * F.col("rating") / 5, 9).alias("score"))
    ceiling = alone.agg(F.max("score")).scalar()
    top = alone.orderBy(F.desc("score"), "product_id").limit(reach).agg(F.sort_array(F.collect_list(
        F.struct((-F.col("score")).alias("s"), F.col("product_id").alias("id"), F.lit(0).alias("fc"))))).scalar()
    short = (F.size("got") < k) | (-F.element_at("got", -1)["s"] <= ceiling)
    ids = F.transform("got", lambda e: e["id"])
    extra = F.filter("all_rated", lambda e: (e["id"] != F.col("query_id")) & ~F.array_contains(ids, e["id"]))
    return best.withColumn("all_rated", top).withColumn("got", F.when(short, F.sort_array(F.concat("got", extra))).otherwise(F.col("got")))


def hybrid(catalogue: DataFrame, queries: DataFrame, edges: DataFrame | None, k: int = 10,
           weights: dict = HYBRID_WEIGHTS) -> DataFrame:
    """Full hybrid rows with reason and tags, in the layout of the other strategies."""
    rows = stored(blend(catalogue, queries, edges, k, weights))
    rows = strategies.enrich(rows, catalogue).join(queries, "query_id")
    reason, tags = hybrid_reason()
    confidence = F.when(F.col("top") > 0, F.col("score") / F.col("top")).otherwise(0.0)
    return strategies._finish(rows, "hybrid", F.col("score"), confidence, reason, tags)


def hybrid_reason(limit: int = 3) -> tuple[Column, Column]:
    brand = strategies._known_brand(F.col("q_brand")) == F.col("c_brand")
    l2 = strategies._known(F.col("q_l2")) == F.col("c_category_l2")
    l1 = strategies._known(F.col("q_l1")) == F.col("c_category_l1")
    bucket = F.nullif(F.col("q_bucket"), F.lit("")) == F.col("c_price_bucket")
    rating, content = F.col("c_rating"), F.col("from_content") == 1
    signals = strategies._texts(
        F.when(brand, F.concat(F.lit("from "), F.col("c_brand"))),
        F.when(l2, F.concat(F.lit("in "), F.col("c_category_l2")))
        .when(l1, F.concat(F.lit("in "), F.col("c_category_l1"))),
        F.when(bucket, F.concat(F.col("c_price_bucket"), F.lit(" price range"))),
        F.when(rating >= 4.0, strategies._rated(rating)),
        F.when(content, "similar product specifications"))
    tags = F.array(
        F.when(brand, "Same Brand"), F.when(l2, "Same Category").when(l1, "Similar Category"),
        F.when(bucket, "Similar Price"), F.when(rating >= 4.5, "Highly Rated"),
        F.when(F.col("c_popularity_score") >= 0.8, "Best Seller"), F.when(content, "Similar Specifications"))
    reason = F.when(F.size(signals) == 0, "Recommended based on multiple similarity signals").otherwise(
        F.concat(F.lit("Recommended because: "), F.array_join(F.slice(signals, 1, limit), ", ")))
    return reason, tags


def with_unknown(catalogue: DataFrame, ids: DataFrame, edges: DataFrame | None, k: int = 10,
                 weights: dict = HYBRID_WEIGHTS) -> DataFrame:
    """Hybrid for known ids; an id that is not in the catalogue gets the best sellers."""
    known = hybrid(catalogue, strategies.pick_queries(catalogue, ids), edges, k, weights)
    strangers = strategies.unknown_queries(catalogue, ids).select(
        "query_id", *[F.lit(None).cast("double" if c == "q_price" else "string").alias(c)
                      for c in QUERY_FIELDS if c != "query_id"])
    return known.unionByName(strategies.popularity(catalogue, strangers, k))


def by_name(catalogue: DataFrame, phrases: DataFrame, edges: DataFrame | None, k: int = 10,
            weights: dict = HYBRID_WEIGHTS) -> DataFrame:
    """Hybrid for the best search hit of each phrase; best sellers for a phrase without a hit.

    Many phrases may share one best hit, so its list is computed once.
    """
    from aislerank.operators.search import search

    hits = cut(search(catalogue, phrases, 1).select("query", F.col("product_id").alias("source")))
    wanted = hits.select(F.col("source").alias("query_id")).distinct()
    recs = hybrid(catalogue, strategies.pick_queries(catalogue, wanted), edges, k, weights)
    found = salted_join(hits, recs.select(F.col("query_id").alias("source"), "product_id", "rank", "score"), "source")
    missed = phrases.select("query").distinct().join(hits, "query", "left_anti").withColumnRenamed("query", "query_id")
    best = strategies.overall(catalogue, missed, k, "popularity_score").select(
        F.col("query_id").alias("query"), F.lit(None).cast("string").alias("source"), "product_id",
        F.col("rank").cast("bigint").alias("rank"), rounded(F.col("heat"), 9).alias("score"))
    return found.select("query", "source", "product_id", "rank", "score").unionByName(best)
