"""Catalogue queries, keyword search and facets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aislerank.operators.skew import salted_join
from aislerank.session import cut

# Shown where a review part is missing.
NO_NAME, NO_TITLE, NO_BODY = "Amazon Customer", "Review", "No review content provided."


def unnest_reviews(df: DataFrame, limit: int = 5) -> DataFrame:
    """Names, titles and bodies paired by position; missing parts take a default."""
    parts = lambda c: F.coalesce(
        F.split(F.nullif(F.col(c), F.lit("")), "[,|]"), F.array().cast("array<string>"))
    lists = df.select(
        "product_id", parts("user_name").alias("n"), parts("review_title").alias("t"),
        parts("review_content").alias("c"))
    shown = lists.filter(F.size("n") + F.size("t") + F.size("c") > 0)
    positions = F.sequence(F.lit(1), F.least(F.greatest(F.size("n"), F.lit(1)), F.lit(limit)))
    at = lambda array, default: F.coalesce(
        F.nullif(F.trim(F.get(F.col(array), F.col("i") - 1)), F.lit("")), F.lit(default))
    return shown.select("*", F.explode(positions).alias("i")).select(
        "product_id", F.col("i").cast("bigint").alias("position"),
        at("n", NO_NAME).alias("reviewer"), at("t", NO_TITLE).alias("title"),
        at("c", NO_BODY).alias("content"))


# ---------------------------------------------------------------- catalogue look-ups


def by_ids(catalogue: DataFrame, ids: DataFrame) -> DataFrame:
    """The products whose id is asked for."""
    return catalogue.join(ids.select("product_id").distinct(), "product_id", "left_semi")


def page(catalogue: DataFrame, offset: int, limit: int, category: str | None = None) -> DataFrame:
    rows = catalogue.filter(F.col("category").contains(category)) if category else catalogue
    return rows.orderBy("product_id").offset(offset).limit(limit)


def category_tokens(catalogue: DataFrame) -> DataFrame:
    """Every category name on any level.  Paths are made distinct before they are split."""
    paths = catalogue.select("category").distinct()
    return paths.select(F.explode(F.split("category", r"\|")).alias("c")).select(
        F.trim("c").alias("category")).distinct().orderBy("category")


def top_categories(catalogue: DataFrame) -> DataFrame:
    return catalogue.select("category_l1").filter("category_l1 <> ''").distinct().orderBy("category_l1")


def dataset_stats(df: DataFrame) -> DataFrame:
    """One row of totals.  The distinct counts and the duplicate count are taken over small grouped
    tables, so one pass over the rows never expands them."""
    top = F.split("category", r"\|")[0]
    absent = lambda c: F.coalesce(F.sum(F.when(F.col(c).isNull() | (F.col(c) == ""), 1).otherwise(0)), F.lit(0))
    per_path = df.groupBy("category").agg(F.count("*").alias("n"))
    paths = per_path.agg(F.count("category").alias("unique_categories"),
                         F.count_distinct(top).alias("top_level_count"))
    ids = df.groupBy("product_id").agg(F.count("*").alias("n")).agg(
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("d")).scalar()
    totals = df.agg(
        F.count("*").alias("total_products"), absent("img_link").alias("missing_images"),
        absent("discounted_price").alias("missing_prices"), absent("rating").alias("missing_ratings"))
    return totals.select(
        "total_products", paths.select("unique_categories").scalar().alias("unique_categories"),
        paths.select("top_level_count").scalar().alias("top_level_count"),
        "missing_images", "missing_prices", "missing_ratings", ids.alias("duplicate_ids"))


def top_level_counts(df: DataFrame) -> DataFrame:
    return df.filter("category IS NOT NULL").groupBy(
        F.split("category", r"\|")[0].alias("category_l1")).agg(F.count("*").alias("products"))


def category_tree(catalogue: DataFrame) -> DataFrame:
    """(id, path, name, parent_id): one node per distinct path prefix, numbered by path.

    Numbers come from a global sort followed by per-partition offsets, not from one big window.
    """
    nodes = (
        catalogue.select("category").distinct()
        .select(F.split("category", r"\|").alias("parts"))
        .select(F.col("parts"), F.posexplode("parts").alias("i", "name"))
        .select(
            F.array_join(F.slice("parts", F.lit(1), F.col("i") + 1), "|").alias("path"),
            F.trim("name").alias("name"),
            F.when(F.col("i") > 0, F.array_join(F.slice("parts", F.lit(1), F.greatest(F.col("i"), F.lit(1))), "|"))
            .alias("parent_path"))
        .distinct())
    numbered = number_rows(nodes, "path")
    parents = numbered.select(F.col("path").alias("parent_path"), F.col("id").alias("parent_id"))
    return numbered.join(parents, "parent_path", "left").select("id", "path", "name", "parent_id")


def number_rows(df: DataFrame, key: str) -> DataFrame:
    """Dense 1..n by a unique key: keys are exchanged by range, numbered inside each range, and the
    sizes of the ranges before are added.  How the keys begin does not matter."""
    # Written, so that a row keeps the number of its range.
    ranged = cut(df.repartitionByRange(F.col(key)).withColumn("_b", F.spark_partition_id()))
    sizes = ranged.groupBy("_b").agg(F.count("*").alias("_n"))
    # One row per range.
    offsets = sizes.select("_b", F.coalesce(
        F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_o"))
    inner = F.row_number().over(Window.partitionBy("_b").orderBy(key))
    return ranged.withColumn("_r", inner).join(F.broadcast(offsets), "_b").withColumn(
        "id", (F.col("_r") + F.col("_o")).cast("bigint")).drop("_b", "_r", "_o")


def brand_dimension(catalogue: DataFrame) -> DataFrame:
    brands = catalogue.select(F.col("brand").alias("name")).distinct()
    return number_rows(brands, "name").select("id", "name")


# ---------------------------------------------------------------- keyword search


def name_words(name: Column) -> Column:
    return F.filter(F.split(F.trim(F.lower(name)), r"\s+"), lambda w: F.length(w) >= 3)


def inverted_index(catalogue: DataFrame) -> DataFrame:
    """(word, product_id), one row per occurrence of the word in the name."""
    return catalogue.select(F.explode_outer(name_words(F.col("product_name"))).alias("word"), "product_id").filter(
        "word IS NOT NULL")


def name_prefixes(postings: DataFrame) -> DataFrame:
    """(word, token, points): every beginning a token may have of every distinct word."""
    lengths = F.sequence(F.least(F.lit(2), F.length("word")), F.length("word"))
    return postings.select("word").distinct().select("word", F.explode(F.transform(
        lengths, lambda n: F.substring(F.col("word"), F.lit(1), n))).alias("token")).withColumn(
            "points", F.when(F.col("token") == F.col("word"), 2.0).otherwise(0.5))


def name_scores(phrases: DataFrame, items: DataFrame, k: int, common: int = 1000) -> DataFrame:
    """(query, n, name_key, score) with the k best names of every phrase, and some more.

    A token that more than ``common`` names answer is a common one.  Phrases with the same common
    tokens share one list of the k best names for these tokens, so a word that very many phrases and
    names hold is scored once and not for each phrase.  The names that a rare token finds, at most
    ``common`` for each, are scored in full, by their own words.  That loses nothing: a name outside the list
    that no rare token finds has k names before it, whose scores the rare tokens can only raise.
    """
    postings = cut(items.select("name_key", F.explode_outer(name_words(F.col("name_key"))).alias("word")).filter(
        "word IS NOT NULL").groupBy("word", "name_key").agg(F.count("*").alias("times")))
    prefixes = cut(name_prefixes(postings))
    many = prefixes.join(postings.groupBy("word").agg(F.count("*").alias("names")), "word").groupBy("token").agg(
        F.sum("names").alias("names")).filter(F.col("names") > common).select("token", F.lit(True).alias("common"))
    tokens = phrases.select("query").distinct().select("query", F.filter(
        F.split(F.trim(F.lower("query")), r"\s+"), lambda w: F.length(w) >= 2).alias("tokens"))
    asked = tokens.select("query", F.size("tokens").alias("n"), F.explode_outer("tokens").alias("token")).filter(
        "token IS NOT NULL").groupBy("query", "n", "token").agg(F.count("*").alias("repeats")).join(many, "token", "left")
    token = F.struct("token", "repeats")
    split = cut(asked.groupBy("query", "n").agg(
        F.sort_array(F.collect_list(F.when(F.col("common"), token))).alias("shared"),
        F.collect_list(F.when(F.col("common").isNull(), token)).alias("rare")).withColumn("set", F.to_json("shared")))

    points = lambda rows, by: rows.join(prefixes, "token").join(postings, "word").groupBy(*by, "name_key").agg(
        F.sum(F.col("points") * F.col("times") * F.col("repeats")).alias("score"))
    # The common tokens: once for each distinct set of them.
    sets = split.filter("size(shared) > 0").groupBy("set").agg(F.first("shared").alias("shared")).select("set", F.inline("shared"))
    leader = F.col("items")[0]
    order = (F.desc("score"), leader["popularity_score"].desc(), leader["product_id"].asc())
    listed = points(sets, ["set"]).join(items, "name_key").withColumn(
        "_n", F.row_number().over(Window.partitionBy("set").orderBy(*order))).filter(F.col("_n") <= k).groupBy("set").agg(
            F.collect_list(F.struct("name_key", "score")).alias("list"))
    by_set = salted_join(split.filter("size(shared) > 0").select("query", "n", "set"), listed, "set").select(
        "query", "n", F.inline("list"))
    # The rare tokens, and what the common ones add to the names they find.
    added = F.aggregate("shared", F.lit(0.0), lambda total, t: total + t["repeats"] * F.aggregate(
        name_words(F.col("name_key")), F.lit(0.0), lambda s, w: s + F.when(w == t["token"], 2.0).when(
            F.startswith(w, t["token"]), 0.5).otherwise(0.0)))
    found = points(split.select("query", F.inline("rare")), ["query"])
    by_rare = found.join(split.select("query", "n", "shared"), "query").select(
        "query", "n", "name_key", (F.col("score") + added).alias("score"))
    return by_set.unionByName(by_rare).groupBy("query", "n", "name_key").agg(F.max("score").alias("score"))


def search(catalogue: DataFrame, phrases: DataFrame, k: int = 20, category: str | None = None, common: int = 1000) -> DataFrame:
    """The k best products per phrase: 2 per exact word, 1/2 per word the token properly begins.

    Products of one name score alike, so names are scored and each name carries its k most popular
    products.  The k best names, ordered by score and by their best product, hold the k best
    products.  Prefixes are looked up by equality in a table of the prefixes of the distinct words.
    ``common`` moves work, not results, see ``name_scores``.
    """
    from aislerank.functions.numbers import rounded
    from aislerank.operators.lists import group_lists

    shown = catalogue.filter(F.lower("category_l1") == category.lower()) if category else catalogue
    named = shown.withColumn("name_key", F.lower(F.trim("product_name"))).filter("name_key <> ''")
    items = cut(group_lists(named, "name_key", k))
    scored = name_scores(phrases, items, k, common)
    leader = F.col("items")[0]
    ranked = scored.join(items, "name_key").withColumn("_n", F.row_number().over(
        Window.partitionBy("query").orderBy(
            F.desc("score"), leader["popularity_score"].desc(), leader["product_id"].asc())))
    best = ranked.filter(F.col("_n") <= k).select("query", "n", "score", F.inline("items"))
    final = Window.partitionBy("query").orderBy(F.desc("score"), F.desc("popularity_score"), F.asc("product_id"))
    found = best.withColumn("rank", F.row_number().over(final)).filter(F.col("rank") <= k)
    share = F.least(F.lit(1.0), F.col("score") / (F.col("n") * 2.0))
    return found.select(
        "query", "product_id", F.col("rank").cast("bigint").alias("rank"), "score",
        rounded(share * 0.7 + F.col("popularity_score") * 0.3, 9).alias("confidence_score"),
        F.concat(F.lit("Matched '"), "query", F.lit("' in product catalog")).alias("recommendation_reason"))


def suggestions(found: DataFrame, catalogue: DataFrame, limit: int = 6) -> DataFrame:
    """Search results re-ordered by kind of match: name prefix, brand, word start, category,
    substring, none; the search order decides inside a kind."""
    rows = salted_join(
        cut(found.select("query", "product_id", F.col("rank").alias("found_at"))),
        catalogue.select("product_id", "product_name", "brand", "category"), "product_id")
    q = F.lower("query")
    name, brand, shelf = (F.lower(F.coalesce(F.col(c), F.lit(""))) for c in ("product_name", "brand", "category"))
    kind = (
        F.when(name.startswith(q), 1).when(brand.startswith(q), 2)
        .when(name.contains(F.concat(F.lit(" "), q)), 3).when(shelf.contains(q), 4)
        .when(name.contains(q), 5).otherwise(6))
    order = Window.partitionBy("query").orderBy("match_class", "found_at")
    return rows.withColumn("match_class", kind.cast("bigint")).withColumn(
        "position", F.row_number().over(order).cast("bigint")).filter(F.col("position") <= limit).select(
            "query", "product_id", "match_class", "position")


# ---------------------------------------------------------------- facets, filters, sorting


def first_part(column: str) -> Column:
    return F.trim(F.split(column, r"\|")[0])


def facets(catalogue: DataFrame, limit: int = 8) -> DataFrame:
    """(facet, value): the first brands and top categories, and the price slider's end."""
    def values(column: str, facet: str) -> DataFrame:
        return (catalogue.filter(F.col(column) != "").select(first_part(column).alias("value")).distinct()
                .orderBy("value").limit(limit).select(F.lit(facet).alias("facet"), "value"))

    slider = catalogue.agg((F.ceil(F.max("discounted_price") / 100) * 100).cast("bigint").cast("string").alias("value"))
    return values("brand", "brand").unionAll(values("category", "category")).unionAll(
        slider.select(F.lit("max_price").alias("facet"), "value"))


def faceted(catalogue: DataFrame, max_price: float, min_rating: float, categories=(), brands=()) -> DataFrame:
    keep = (F.coalesce("discounted_price", F.lit(0.0)) <= max_price) & (
        F.coalesce("rating", F.lit(0.0)) >= min_rating)
    if categories:
        keep &= first_part("category").isin(*categories)
    if brands:
        keep &= first_part("brand").isin(*brands)
    return catalogue.filter(keep)


SORT_MODES = {
    "price_asc": lambda: [F.asc("discounted_price")],
    "price_desc": lambda: [F.desc("discounted_price")],
    "rating": lambda: [F.desc("rating")],
    "relevance": lambda: [F.asc("rank")],
}


def sorted_by(rows: DataFrame, mode: str) -> DataFrame:
    return rows.orderBy(*SORT_MODES[mode](), F.asc("product_id"))


def sorted_lists(found: DataFrame, catalogue: DataFrame, modes: dict[str, str]) -> DataFrame:
    """The short list of every query (query, product_id, rank) with its place under each sort mode, by column name.

    Products that ``catalogue`` lacks, because a filter left them out, go; a product may be in very many lists.
    """
    facts = catalogue.select("product_id", "discounted_price", "rating")
    rows = salted_join(found.select("query", "product_id", "rank"), facts, "product_id")
    place = lambda mode: F.row_number().over(Window.partitionBy("query").orderBy(*SORT_MODES[mode](), F.asc("product_id")))
    return rows.select("query", "product_id", *[place(mode).cast("bigint").alias(name) for name, mode in modes.items()])


def cart_totals(cart: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Subtotal per session.  A product in very many carts is a hot key that adaptive execution splits."""
    from aislerank.functions.numbers import display_price, rounded

    priced = cart.select("session_id", "product_id").distinct().join(
        catalogue.select("product_id", display_price(
            F.col("discounted_price"), F.col("actual_price")).alias("price")), "product_id")
    return priced.groupBy("session_id").agg(
        F.count("*").alias("items"), rounded(F.sum("price"), 2).alias("subtotal"))


def biggest_categories(catalogue: DataFrame, limit: int = 10) -> DataFrame:
    return catalogue.groupBy("category_l1").agg(F.count("*").alias("products")).orderBy(
        F.desc("products"), "category_l1").limit(limit)


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """(bin, low, products): equal-width bins between the extremes, the last bin closed."""
    from aislerank.functions.numbers import rounded

    bounds = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    lo, hi = bounds.select("lo").scalar(), bounds.select("hi").scalar()
    width = (hi - lo) / bins
    index = F.least(F.floor((F.col(column) - lo) / width).cast("bigint"), F.lit(bins - 1))
    return df.filter(F.col(column).isNotNull() & (hi > lo)).groupBy(index.alias("bin")).agg(
        F.count("*").alias("products")).select("bin", rounded(lo + width * F.col("bin"), 6).alias("low"), "products")


def position_in(rows: DataFrame, mode: str, name: str, blocks: int = 64) -> DataFrame:
    """(product_id, position) under a sort mode: a rank inside each block of values, the blocks cut
    by a sketch of the values, plus the sizes of the blocks before."""
    value = {"price_asc": F.col("discounted_price"), "price_desc": -F.col("discounted_price"),
             "rating": -F.col("rating")}[mode]
    keyed = rows.select("product_id", value.alias("_v"))
    edges = keyed.agg(F.percentile_approx("_v", [i / blocks for i in range(1, blocks)], 1000)).scalar()
    blocked = keyed.withColumn("_edges", edges).withColumn(
        "_b", F.size(F.filter("_edges", lambda e: e < F.col("_v")))).drop("_edges")
    sizes = blocked.groupBy("_b").agg(F.count("*").alias("_n"))
    # One row per block.
    before = F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("_b", F.coalesce(before, F.lit(0)).alias("_o"))
    inner = F.row_number().over(Window.partitionBy("_b").orderBy("_v", "product_id"))
    return blocked.withColumn("_r", inner).join(offsets, "_b").select(
        "product_id", (F.col("_r") + F.col("_o")).cast("bigint").alias(name))
