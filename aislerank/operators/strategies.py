"""Ranking strategies.  Each is ``f(catalogue, queries, k, **options) -> DataFrame`` with one row per
recommendation: query_id, product_id, rank, score, confidence_score, strategy,
recommendation_reason, reason_tags and the candidate's catalogue fields as c_*.

``catalogue`` is a featured catalogue; ``queries`` comes from ``as_queries`` or ``pick_queries``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aislerank import settings
from aislerank.functions.numbers import rounded
from aislerank.operators import lists as L
from aislerank.operators.skew import salted_join

QUERY_FIELDS = ("query_id", "q_l1", "q_l2", "q_brand", "q_price", "q_bucket")
CANDIDATE_FIELDS = tuple(f"c_{c}" for c in L.CARRIED if c != "product_id")


def as_queries(features: DataFrame) -> DataFrame:
    return features.select(
        F.col("product_id").alias("query_id"), F.col("category_l1").alias("q_l1"),
        F.col("category_l2").alias("q_l2"), F.col("brand").alias("q_brand"),
        F.col("discounted_price").alias("q_price"), F.col("price_bucket").alias("q_bucket"))


def pick_queries(features: DataFrame, ids: DataFrame) -> DataFrame:
    """The queries whose ``query_id`` is in ``ids`` and in the catalogue."""
    return as_queries(features).join(ids.select("query_id").distinct(), "query_id", "left_semi")


def unknown_queries(features: DataFrame, ids: DataFrame) -> DataFrame:
    return ids.select("query_id").distinct().join(
        features.select(F.col("product_id").alias("query_id")), "query_id", "left_anti")


def _known(text: Column) -> Column:
    """A category level, or NULL when it is missing, so that it matches nothing."""
    return F.when((text != "") & (text != "nan"), text)


def _known_brand(brand: Column) -> Column:
    return F.when(~brand.isin("Unknown", "nan", ""), brand)


def _not_self(items: Column) -> Column:
    return F.filter(items, lambda e: e["product_id"] != F.col("query_id"))


def _texts(*parts: Column) -> Column:
    return F.array_compact(F.array(*parts))


def _rated(rating: Column) -> Column:
    return F.concat(F.lit("rated "), F.format_number(rating, 1), F.lit("/5"))


def _reviews(count: Column) -> Column:
    return F.concat(F.format_number(count, 0), F.lit(" reviews"))


def _finish(rows: DataFrame, strategy: str, score: Column, confidence: Column,
            reason: Column, tags: Column) -> DataFrame:
    clip = F.least(F.lit(1.0), F.greatest(F.lit(0.0), confidence))
    return rows.select(
        "query_id", "product_id", F.col("rank").cast("bigint").alias("rank"),
        rounded(score, 9).alias("score"), rounded(clip, 9).alias("confidence_score"),
        F.lit(strategy).alias("strategy"), reason.alias("recommendation_reason"),
        F.array_compact(tags).alias("reason_tags"), *CANDIDATE_FIELDS)


# ---------------------------------------------------------------- category


def category_similarity(catalogue: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """Same second level first, then same top level; popularity inside each tier.

    The second tier is read only when the first has fewer than k others, so the best 2k + 1 rows of
    the top level always hold k rows outside the query's second level.
    """
    by_l2 = L.group_lists(catalogue.withColumn("g2", _known(F.col("category_l2"))).filter("g2 IS NOT NULL"), "g2", k + 1)
    by_l1 = L.group_lists(catalogue.withColumn("g1", _known(F.col("category_l1"))).filter("g1 IS NOT NULL"), "g1", 2 * k + 1)
    q = queries.withColumn("g2", _known(F.col("q_l2"))).withColumn("g1", _known(F.col("q_l1")))
    q = L.attach(L.attach(q, by_l2, "g2", "near"), by_l1, "g1", "wide")
    outside = F.filter(_not_self(F.col("wide")), lambda e: F.coalesce(e["category_l2"] != F.col("g2"), F.lit(True)))
    rows = L.unfold(q, L.tiers((_not_self(F.col("near")), 1.0), (outside, 0.6)), k, QUERY_FIELDS)
    blend = F.col("match") * 0.7 + F.col("c_popularity_score") * 0.3
    same = F.col("match") >= 1.0
    high = F.col("c_rating") >= 4.0
    reason = F.concat(
        F.when(same, F.concat(F.lit("From the same category: "),
                              F.coalesce(F.nullif(F.col("c_category_l2"), F.lit("")), F.col("c_category_l1"))))
        .otherwise(F.concat(F.lit("From a related category: "), F.col("c_category_l1"))),
        F.when(high, F.concat(F.lit(" — "), _rated(F.col("c_rating")))).otherwise(""))
    tags = F.array(F.when(same, "Same Category").otherwise("Similar Category"), F.when(high, "Highly Rated"))
    return _finish(rows, "category_similarity", blend, blend, reason, tags)


# ---------------------------------------------------------------- brand


def brand_similarity(catalogue: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """Same brand by popularity; a query without a brand reads its top-level category instead."""
    branded = catalogue.withColumn("g", F.concat(F.lit("b:"), _known_brand(F.col("brand"))))
    shelved = catalogue.withColumn("g", F.concat(F.lit("c:"), _known(F.col("category_l1"))))
    groups = L.group_lists(branded.unionByName(shelved).filter("g IS NOT NULL"), "g", k + 1)
    q = queries.withColumn("g", F.coalesce(
        F.concat(F.lit("b:"), _known_brand(F.col("q_brand"))), F.concat(F.lit("c:"), _known(F.col("q_l1")))))
    rows = L.unfold(L.attach(q, groups, "g", "items"), L.tiers((_not_self(F.col("items")), 1.0)), k, QUERY_FIELDS)
    # A popularity of exactly zero is reported as one half.
    score = F.coalesce(F.nullif(F.col("c_popularity_score"), F.lit(0.0)), F.lit(0.5))
    high = F.col("c_rating") >= 4.0
    reason = F.array_join(_texts(
        F.concat(F.lit("Also from "), F.col("q_brand")), F.when(high, _rated(F.col("c_rating"))),
        F.when(F.col("c_rating_count") >= 1000, _reviews(F.col("c_rating_count")))), " — ")
    return _finish(rows, "brand_similarity", score, score + 0.2, reason,
                   F.array(F.lit("Same Brand"), F.when(high, "Highly Rated")))


# ---------------------------------------------------------------- price

_FAN = 4
_MOST_CENTS = 4e18  # larger prices are taken for this one, so that a dirty value cannot overflow


def _cents(price: Column) -> Column:
    return F.rint(F.least(price * 100, F.lit(_MOST_CENTS))).cast("bigint")


def _levels(priced: DataFrame, tolerance: float) -> int:
    """Levels of the ladder of blocks: the top one holds every range in a few blocks."""
    most = (priced.agg(F.max("cents")).first()[0] or 0) * (1 + tolerance)
    levels = 1
    while _FAN**levels <= most:
        levels += 1
    return levels


def _cover(low: Column, high: Column, levels: int) -> Column:
    """The aligned blocks of 4^level cents that tile [low, high], as (level, block) structs.

    On each level only the blocks whose parent sticks out of the range are needed: at most three on
    either side, whatever the width of the range.
    """
    def full(level: int) -> tuple[Column, Column]:
        size = F.lit(_FAN**level).cast("bigint")
        first = F.ceil(low / size).cast("bigint")
        last = F.floor((high + 1) / size).cast("bigint") - 1
        return first, last

    def run(a: Column, b: Column, level: int) -> Column:
        seq = F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<bigint>"))
        return F.transform(seq, lambda x: F.struct(F.lit(level).alias("level"), x.alias("block")))

    parts = []
    for level in range(levels):
        first, last = full(level)
        if level == levels - 1:
            parts.append(run(first, last, level))
            continue
        up_first, up_last = full(level + 1)
        inside = up_first <= up_last
        parts.append(run(first, F.when(inside, F.least(last, up_first * _FAN - 1)).otherwise(last), level))
        parts.append(run(F.when(inside, F.greatest(first, up_last * _FAN + _FAN)).otherwise(last + 1), last, level))
    return F.concat(*parts)


def price_bands(catalogue: DataFrame, n: int, tolerance: float = 0.20) -> DataFrame:
    """(price_bucket, cents, items): for every distinct price the n most popular products of its
    bucket within the tolerance, best first.

    A range top-n without a range join.  Every product is filed under its block of 4^level cents on
    each level, each block keeps its n best, and a range is tiled by a few dozen blocks.  The cost
    is (products + distinct prices) x levels, however dense the prices are.
    """
    priced = catalogue.filter(F.col("discounted_price") > 0).withColumn("cents", _cents(F.col("discounted_price")))
    levels = _levels(priced, tolerance)
    filed = priced.select("*", F.explode(F.array(*[
        F.struct(F.lit(level).alias("level"),
                 F.floor(F.col("cents") / F.lit(_FAN**level)).cast("bigint").alias("block"))
        for level in range(levels)])).alias("_b")).select(
            "*", F.struct("price_bucket", "_b.level", "_b.block").alias("node"))
    nodes = L.group_lists(filed, "node", n)

    def within(c: Column) -> Column:
        return F.try_divide(F.abs(c / 100.0 - F.col("cents") / 100.0), F.col("cents") / 100.0) <= tolerance

    low = F.ceil(F.col("cents") * (1 - tolerance)).cast("bigint")
    high = F.floor(F.least(F.col("cents") * (1 + tolerance), F.lit(9e18))).cast("bigint")
    # The tolerance is a ratio of doubles; settle the two end points by that ratio itself.
    points = priced.select("price_bucket", "cents").distinct().select(
        "price_bucket", "cents",
        F.when(within(low - 1), low - 1).when(within(low), low).otherwise(low + 1).alias("low"),
        F.when(within(high + 1), high + 1).when(within(high), high).otherwise(high - 1).alias("high"))
    tiled = points.select("price_bucket", "cents", F.explode(_cover(F.col("low"), F.col("high"), levels)).alias("_b")).select(
        "price_bucket", "cents", F.struct("price_bucket", "_b.level", "_b.block").alias("node"))
    best = tiled.join(nodes, "node").groupBy("price_bucket", "cents").agg(
        F.flatten(F.collect_list("items")).alias("items"))
    ordered = F.sort_array(F.transform("items", lambda e: F.struct(
        (-e["popularity_score"]).alias("p"), e["product_id"].alias("i"), e.alias("c"))))
    return best.select("price_bucket", "cents", F.transform(
        F.slice(ordered, 1, n), lambda e: e["c"]).alias("items"))


def price_similarity(catalogue: DataFrame, queries: DataFrame, k: int = 10, tolerance: float = 0.20) -> DataFrame:
    """Same bucket within the tolerance, then same bucket, then the neighbouring bucket.

    The band's rule (whole cents) decides both tiers: the second one is the bucket without the ids
    of the band.  It is read only when the band holds fewer than k others, all of which are then in
    its list, so 2k + 1 rows of the bucket suffice; likewise k rows of the neighbour.
    """
    bands = price_bands(catalogue, k + 1, tolerance).withColumn("point", F.struct("price_bucket", "cents")).select("point", "items")
    tier = L.group_lists(catalogue.filter("discounted_price > 0").withColumn("bucket", F.col("price_bucket")), "bucket", 2 * k + 1)
    nearby = L.group_lists(catalogue.withColumn("beside", F.col("price_bucket")), "beside", k + 1)
    beside = F.create_map(*[F.lit(x) for pair in settings.ADJACENT_BUCKET.items() for x in pair])
    q = queries.select(
        "*", F.struct(F.col("q_bucket").alias("price_bucket"), _cents(F.col("q_price")).alias("cents")).alias("point"),
        F.when(F.col("q_price") > 0, F.col("q_bucket")).alias("bucket"),
        beside[F.col("q_bucket")].alias("beside"))
    # Nearly every query has a point of its own, so only points of very many queries are repeated.
    q = salted_join(q, bands.withColumnRenamed("items", "band"), "point", "left")
    q = L.attach(L.attach(q, tier, "bucket", "same", few=True), nearby, "beside", "next", few=True)
    in_band = F.coalesce(F.transform("band", lambda e: e["product_id"]), F.array().cast("array<string>"))
    rest = F.filter(_not_self(F.col("same")), lambda e: ~F.array_contains(in_band, e["product_id"]))
    rows = L.unfold(q, L.tiers((_not_self(F.col("band")), 1.0), (rest, 0.7), (_not_self(F.col("next")), 0.4)), k, QUERY_FIELDS)
    blend = F.col("match") * 0.65 + F.col("c_popularity_score") * 0.35
    cost, bucket = F.col("c_discounted_price"), F.col("c_price_bucket")
    close, same = F.col("match") >= 1.0, F.col("match") >= 0.7
    reason = (
        F.when(close & (cost > 0), F.concat(F.lit("Similar price range: Rs."), F.format_number(cost, 0)))
        .when(close, F.concat(F.lit("Similar price range ("), bucket, F.lit(")")))
        .when(same, F.concat(F.lit("In the same "), bucket, F.lit(" price tier")))
        .otherwise(F.concat(F.lit("In a nearby "), bucket, F.lit(" price range"))))
    tag = F.when(close, "Similar Price").when(same, "Same Price Tier").otherwise("Nearby Price Range")
    return _finish(rows, "price_similarity", blend, blend, reason, F.array(tag))


# ---------------------------------------------------------------- popularity and trend


def _by_category(catalogue: DataFrame, queries: DataFrame, k: int, score: str, extra: tuple[str, ...]) -> DataFrame:
    """The list of the query's top-level category if that has max(3, k) rows, else of everything.

    The size of a category is tested with the query product still in it.
    """
    shelved = catalogue.withColumn("g", _known(F.col("category_l1"))).filter("g IS NOT NULL")
    sizes = shelved.groupBy("g").agg(F.count("*").alias("members")).filter(F.col("members") >= max(3, k))
    large = L.group_lists(shelved, "g", k + 2, score, extra).join(sizes, "g", "left_semi")
    q = L.attach(queries.withColumn("g", _known(F.col("q_l1"))), large, "g", "shelf")
    return q.withColumn("items", F.coalesce("shelf", L.overall_list(catalogue, k + 2, score, extra)))


def popularity(catalogue: DataFrame, queries: DataFrame, k: int = 10, exclude: str | None = None) -> DataFrame:
    """Best sellers; ``exclude`` names a column of the queries with one more id to leave out."""
    q = _by_category(catalogue, queries, k, "popularity_score", ())
    shown = _not_self(F.col("items"))
    if exclude:
        shown = F.filter(shown, lambda e: F.coalesce(e["product_id"] != F.col(exclude), F.lit(True)))
    rows = L.unfold(q, L.tiers((shown, 1.0)), k, QUERY_FIELDS)
    pop, rating, shelf = F.col("c_popularity_score"), F.col("c_rating"), F.col("c_category_l1")
    parts = _texts(
        F.when(rating >= 4.0, _rated(rating)),
        F.when(F.col("c_rating_count") >= 1000, _reviews(F.col("c_rating_count"))),
        F.when((shelf != "") & (F.lower(shelf) != "nan"), F.concat(F.lit("in "), shelf)))
    reason = F.when(F.size(parts) == 0, F.concat(F.lit("One of the most popular products (rank #"), F.col("rank"), F.lit(")"))
                    ).otherwise(F.concat(F.lit("Best seller — "), F.array_join(parts, ", ")))
    return _finish(rows, "popularity", pop, pop, reason,
                   F.array(F.lit("Best Seller"), F.when(rating >= 4.5, "Top Rated")))


def trending(catalogue: DataFrame, queries: DataFrame, k: int = 12, min_count: int = 5) -> DataFrame:
    """Needs ``trending_score``; rarely rated products are dropped before anything else."""
    live = catalogue.filter(F.coalesce("rating_count", F.lit(0.0)) >= min_count)
    q = _by_category(live, queries, k, "trending_score", ("trending_score",))
    shown = _not_self(F.col("items"))
    rows = q.select(*QUERY_FIELDS, F.posexplode(F.slice(shown, 1, k)).alias("p", "c")).select(
        *QUERY_FIELDS, (F.col("p") + 1).alias("rank"), F.col("c.trending_score").alias("heat"),
        *[F.col(f"c.{n}").alias(n if n == "product_id" else f"c_{n}") for n in L.CARRIED])
    return trending_rows(rows)


def trending_rows(rows: DataFrame) -> DataFrame:
    rating, shelf, heat = F.col("c_rating"), F.col("c_category_l1"), F.col("heat")
    shelved = (shelf != "") & (F.lower(shelf) != "nan")
    parts = _texts(
        F.when(shelved, F.concat(F.lit("in "), shelf)), F.when(rating >= 4.0, _rated(rating)),
        F.when(F.col("c_rating_count") >= 500, _reviews(F.col("c_rating_count"))))
    reason = F.when(F.size(parts) == 0, F.concat(F.lit("Trending product (#"), F.col("rank"), F.lit(" this week)"))
                    ).otherwise(F.concat(F.lit("Trending #"), F.col("rank"), F.lit(" — "), F.array_join(parts, ", ")))
    return _finish(rows, "trending", heat, heat, reason,
                   F.array(F.lit("Trending"), F.when(shelved, F.concat(F.lit("Trending in "), shelf))))


def overall(catalogue: DataFrame, sessions: DataFrame, k: int, score: str) -> DataFrame:
    """Every query gets the same global list: (query_id, rank, heat, c_*)."""
    q = sessions.select("query_id", L.overall_list(catalogue, k, score, (score,) if score not in L.CARRIED else ()).alias("items"))
    return q.select("query_id", F.posexplode("items").alias("p", "c")).select(
        "query_id", (F.col("p") + 1).alias("rank"), F.col(f"c.{score}").alias("heat"),
        *[F.col(f"c.{n}").alias(n if n == "product_id" else f"c_{n}") for n in L.CARRIED])


# ---------------------------------------------------------------- bought together (by category)


def bought_together(catalogue: DataFrame, queries: DataFrame, k: int = 4, complements: dict | None = None) -> DataFrame:
    """Same top level but another second level, then complementary top levels.

    For "best k of a top level outside one second level" the best 2k rows of the top level suffice
    once no second level may hold more than k of them: at most k of the 2k belong to the excluded one.
    """
    complements = settings.COMPLEMENTS if complements is None else complements
    shelved = catalogue.withColumn("g", _known(F.col("category_l1"))).filter("g IS NOT NULL")
    capped = L.group_lists(shelved.withColumn("gg", F.struct("g", "category_l2")), "gg", k)
    capped = capped.select(F.col("gg.g").alias("g"), F.inline("items"))
    varied = L.group_lists(capped, "g", 2 * k)
    whole = L.group_lists(shelved, "g", k)
    pairs = [(a, b) for a, bs in complements.items() for b in bs]
    links = catalogue.sparkSession.createDataFrame(pairs, "q_g string, g string")
    # The complement table is a parameter of a few dozen rows.
    joined = whole.join(F.broadcast(links), "g").groupBy(F.col("q_g").alias("g")).agg(
        F.flatten(F.collect_list("items")).alias("items"))
    q = queries.withColumn("g", _known(F.col("q_l1")))
    q = L.attach(L.attach(q, varied, "g", "same"), joined, "g", "other")
    aside = F.filter(_not_self(F.col("same")), lambda e: e["category_l2"] != F.col("q_l2"))
    both = L.tiers((aside, 0.85), (_not_self(F.col("other")), 0.65))
    ranked = F.sort_array(F.transform(both, lambda e: F.struct(
        (-rounded(e["match"] * 0.6 + e["c"]["popularity_score"] * 0.4, 9)).alias("s"),
        e["c"]["product_id"].alias("i"), e.alias("e"))))
    rows = L.unfold(q, F.transform(ranked, lambda e: e["e"]), k, QUERY_FIELDS)
    blend = F.col("match") * 0.6 + F.col("c_popularity_score") * 0.4
    reason = F.when(F.col("match") >= 0.8, F.concat(
        F.lit("Customers often buy this with "), F.col("c_category_l2"), F.lit(" items"))
    ).otherwise("Customers who bought this also bought this product")
    return _finish(rows, "frequently_bought_together", blend, blend, reason,
                   F.array(F.lit("Frequently Bought Together"), F.when(F.col("c_rating") >= 4.0, "Highly Rated")))


# ---------------------------------------------------------------- content


def content_reason(rows: DataFrame) -> tuple[Column, Column]:
    brand = _known_brand(F.col("q_brand")) == F.col("c_brand")
    l2 = _known(F.col("q_l2")) == F.col("c_category_l2")
    l1 = _known(F.col("q_l1")) == F.col("c_category_l1")
    score = F.col("score")
    near = F.coalesce(l2, F.lit(False))
    parts = _texts(
        F.when(brand, F.concat(F.lit("from "), F.col("c_brand"))),
        F.when(near, F.concat(F.lit("in "), F.col("c_category_l2")))
        .when(l1, F.concat(F.lit("in "), F.col("c_category_l1"))),
        F.when(score >= 0.85, "with very similar features").when(score >= 0.60, "with similar specifications"))
    tags = F.array(
        F.when(brand, "Same Brand"), F.when(near, "Same Category").when(l1, "Similar Category"),
        F.when(score >= 0.85, "Highly Similar").when(score >= 0.60, "Similar Specifications"),
        F.when(F.col("c_rating") >= 4.0, "Highly Rated"))
    reason = F.when(F.size(parts) == 0, "Similar product based on content analysis").otherwise(
        F.concat(F.lit("Recommended because it is "), F.array_join(parts, ", ")))
    return reason, tags


def enrich(rows: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Adds c_* from the catalogue by ``product_id``; a product may be in very many lists."""
    fields = catalogue.select("product_id", *[F.col(n).alias(f"c_{n}") for n in L.CARRIED if n != "product_id"])
    return salted_join(rows, fields, "product_id")


def content_based(catalogue: DataFrame, queries: DataFrame, edges: DataFrame, k: int = 10) -> DataFrame:
    """``edges`` are the nearest neighbours (src, dst, score, rank)."""
    rows = edges.filter(F.col("rank") <= k).select(
        F.col("src").alias("query_id"), F.col("dst").alias("product_id"), "score", "rank")
    rows = enrich(rows, catalogue).join(queries, "query_id")
    reason, tags = content_reason(rows)
    return _finish(rows, "content_based", F.col("score"), F.col("score"), reason, tags)


# ---------------------------------------------------------------- explanation


def grade(confidence: Column) -> Column:
    return F.when(confidence >= 0.75, "High").when(confidence >= 0.50, "Medium").otherwise("Low")
