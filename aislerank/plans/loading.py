"""Queries over sources, sinks, data quality, cleaning and features."""

from __future__ import annotations

from pyspark.sql import functions as F

from aislerank.functions import numbers, text
from aislerank.functions.numbers import rounded
from aislerank.operators import cleaning, features, quality
from aislerank.plans import sqltext as S
from aislerank.plans.book import query
from aislerank.session import scratch_path
from aislerank.settings import RAW_COLUMNS
from aislerank.sources import csv_catalogue, tables
from aislerank.sources.driver_tables import catalogue, raw_catalogue

RAW = S.with_(S.RAW)
CAT = S.with_(S.CATALOGUE)
FEAT = S.with_(S.FEATURES)
COLS = ", ".join(RAW_COLUMNS)

# ---------------------------------------------------------------- sources and sinks


@query("S1_csv_scan", RAW + f"SELECT {COLS} FROM raw")
def s1(spark, sf):
    path = scratch_path(spark, "catalogue-csv")
    raw_catalogue(spark, sf).select(*RAW_COLUMNS).write.csv(path, header=True, escape='"', quoteAll=False)
    return csv_catalogue.read_catalogue_csv(spark, path)


@query("S2_ingestion_profile", RAW + " UNION ALL ".join(
    f"SELECT {i}::BIGINT AS position, '{c}' AS column_name, 'string' AS dtype, "
    f"count(*) - count({c}) AS null_count, count(*) AS records, true AS source_named, true AS all_files, true AS size_plausible FROM raw"
    for i, c in enumerate(RAW_COLUMNS)))
def s2(spark, sf):
    """Of the written file set.  Its bytes hold each text once, plus at least a separator per cell."""
    path = scratch_path(spark, "catalogue-csv")
    raw = raw_catalogue(spark, sf).select(*RAW_COLUMNS)
    raw.write.csv(path, header=True, escape='"', quoteAll=False)
    files = csv_catalogue.source_files(spark, path)
    profile = csv_catalogue.ingestion_profile(csv_catalogue.read_catalogue_csv(spark, path), files=files)
    texts = raw.agg(F.sum(sum(F.coalesce(F.octet_length(c), F.lit(0)) + 1 for c in RAW_COLUMNS)).alias("n")).scalar()
    return profile.select(
        "position", "column_name", "dtype", "null_count", "records",
        F.contains("source_path", F.lit(path.rsplit("/", 1)[-1])).alias("source_named"),
        (F.col("files") == files.agg(F.count_distinct("path")).scalar()).alias("all_files"),
        ((F.col("bytes") >= texts) & (F.col("bytes") <= texts * 2 + 10**6)
         & (F.abs(F.col("size_mb") * 2**20 - F.col("bytes")) <= 1024)).alias("size_plausible"))


_ROW = "concat_ws(chr(31), " + ", ".join(f"coalesce({c}, chr(0))" for c in RAW_COLUMNS) + ")"


@query("S3_content_version", RAW + f"""
, h AS (SELECT ('0x' || substr(md5({_ROW}), 1, 15))::BIGINT AS d FROM raw),
a AS (SELECT count(*) AS records, bit_xor(d) AS x, sum(d % 2147483647)::BIGINT AS s FROM h)
SELECT records, substr(md5(x || '-' || s || '-' || records), 1, 12) AS version FROM a""")
def s3(spark, sf):
    return csv_catalogue.content_version(raw_catalogue(spark, sf))


def clean(spark, sf):
    return cleaning.cleaned(raw_catalogue(spark, sf))


NUMERIC = f"""{S.RAW},
typed AS (SELECT product_id, product_name, category,
  {S.price('discounted_price')} AS discounted_price, {S.price('actual_price')} AS actual_price,
  {S.percent('discount_percentage')} AS discount_percentage, {S.rating('rating')} AS rating,
  {S.digits('rating_count')} AS rating_count, about_product, img_link, product_link, ingest_order FROM raw),
uniq AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (
  PARTITION BY {COLS} ORDER BY ingest_order) AS rn FROM typed) WHERE rn = 1),
firsts AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (
  PARTITION BY product_id ORDER BY ingest_order) AS rn FROM uniq) WHERE rn = 1)"""

FILLED = f"""{NUMERIC},
filled AS (SELECT product_id, product_name, category,
  coalesce(discounted_price, actual_price) AS discounted_price,
  coalesce(actual_price, discounted_price) AS actual_price,
  coalesce(discount_percentage, 0) AS discount_percentage,
  coalesce(rating, (SELECT coalesce(median(rating), 4.0) FROM firsts)) AS rating,
  coalesce(rating_count, 0) AS rating_count, coalesce(about_product, '') AS about_product,
  img_link, product_link, ingest_order FROM firsts),
whole AS (SELECT * FROM filled WHERE product_id IS NOT NULL AND product_name IS NOT NULL AND category IS NOT NULL),
clean AS (SELECT *, {S.normalise('product_name')} AS product_name_clean, {S.squeeze('category')} AS category_clean,
  {S.normalise(S.description('about_product'))} AS about_product_clean FROM whole)"""

TEXTED = f"""{FILLED},
joined AS (SELECT *, trim(product_name_clean || ' ' || category_clean || ' ' || about_product_clean) AS combined_text FROM clean),
texted AS (SELECT *, {S.drop_stops('combined_text')} AS combined_text_tfidf FROM joined)"""


@query("S4_stage_tables", S.with_(TEXTED) + """
SELECT 'interim' AS stage, count(*) AS records, sum(length(about_product))::BIGINT AS text_chars FROM whole
UNION ALL SELECT 'cleaned', count(*), sum(length(about_product_clean))::BIGINT FROM clean
UNION ALL SELECT 'features', count(*), sum(length(combined_text_tfidf))::BIGINT FROM texted""")
def s4(spark, sf):
    base = scratch_path(spark, "stages")
    interim = tables.write_stage(
        cleaning.without_gaps(cleaning.deduplicated(raw_catalogue(spark, sf))), f"{base}/interim")
    cleaned = tables.write_stage(cleaning.add_clean_text(interim), f"{base}/cleaned")
    full = tables.write_stage(features.featured(cleaned), f"{base}/features")

    def size(df, stage, column):
        return df.agg(F.lit(stage).alias("stage"), F.count("*").alias("records"),
                      F.sum(F.length(column)).alias("text_chars"))

    return (size(interim, "interim", "about_product")
            .union(size(cleaned, "cleaned", "about_product_clean"))
            .union(size(full, "features", "combined_text_tfidf")))


@query("S5_serving_seed", RAW + f"""
, firsts AS (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY ingest_order) AS rn FROM raw
  WHERE product_id IS NOT NULL AND product_name IS NOT NULL)
SELECT product_id, product_name, coalesce(category, 'nan') AS category,
  coalesce({S.num("regexp_replace(discounted_price, '[₹,]', '', 'g')")}, 0) AS discounted_price,
  coalesce({S.num("regexp_replace(actual_price, '[₹,]', '', 'g')")}, 0) AS actual_price,
  coalesce({S.num("replace(discount_percentage, '%', '')")}, 0) AS discount_percentage,
  CASE WHEN regexp_full_match(rating, '[0-9]*[.]?[0-9]*') AND regexp_matches(rating, '[0-9]') THEN rating::DOUBLE ELSE 0 END AS rating,
  CASE WHEN regexp_full_match(replace(rating_count, ',', ''), '[0-9]+') THEN replace(rating_count, ',', '')::BIGINT ELSE 0 END AS rating_count,
  coalesce(about_product, 'nan') AS about_product, coalesce(img_link, 'nan') AS img_link,
  coalesce(product_link, 'nan') AS product_link
FROM firsts WHERE rn = 1""")
def s5(spark, sf):
    return tables.serving_rows(raw_catalogue(spark, sf))


# ---------------------------------------------------------------- data quality


@query("V1_schema_check", RAW + """
SELECT '' AS missing_columns, '' AS extra_columns, true AS passed, count(*) AS records FROM raw""")
def v1(spark, sf):
    return quality.schema_check(raw_catalogue(spark, sf))


def _rule_sql(rule) -> str:
    c, total = rule.column, "count(*)"
    extremes = "NULL::DOUBLE AS min_found, NULL::DOUBLE AS max_found"
    judged = total
    if rule.check == "missing":
        hits = f"count(*) - count({c})"
    elif rule.check == "empty":
        hits = f"count_if({c} IS NULL OR trim({c}) = '' OR {c} = 'nan')"
    elif rule.check == "dtype":
        hits = f"count_if({c} IS NOT NULL AND {S.checked(c)} IS NULL)"
    elif rule.check == "range":
        v = S.checked(c)
        hits, judged = f"count_if({v} < {rule.low} OR {v} > {rule.high})", f"count({v})"
        extremes = f"min({v}) AS min_found, max({v}) AS max_found"
    elif rule.check == "duplicate" and c:
        hits = f"count(*) - (SELECT count(*) FROM (SELECT DISTINCT {c} FROM raw))"
    elif rule.check == "duplicate":
        hits = f"count(*) - (SELECT count(*) FROM (SELECT DISTINCT {COLS} FROM raw))"
    else:
        hits = "0"
    limit = "NULL" if rule.threshold is None else rule.threshold
    return (f"SELECT '{rule.name}' AS rule, '{rule.check}' AS issue_type, '{c or 'dataset'}' AS column_name, "
            f"'{rule.severity}' AS severity, {limit}::DOUBLE AS threshold, ({hits})::BIGINT AS hits, "
            f"({judged})::BIGINT AS judged, {extremes} FROM raw")


def _rules_sql(checks) -> str:
    body = " UNION ALL ".join(_rule_sql(r) for r in quality.RULES if r.check in checks)
    return f"""{RAW}, measured AS ({body}),
judged AS (SELECT *, {S.rnd('hits / greatest(judged, 1)', 6)} AS ratio,
  CASE WHEN issue_type IN ('schema', 'range') THEN hits > 0 ELSE hits / greatest(judged, 1) > threshold END AS failed
  FROM measured)
"""


def _rules(*checks, column=True):
    chosen = [r for r in quality.RULES if r.check in checks and (r.column is not None) == column]
    return lambda spark, sf: quality.issues(quality.measure(raw_catalogue(spark, sf), chosen))


for _key, _check in (("V2_missing_ratio", "missing"), ("V3_empty_ratio", "empty"),
                     ("V4_unparseable_ratio", "dtype"), ("V5_out_of_range", "range")):
    query(_key, _rules_sql([_check]) + "SELECT * FROM judged")(_rules(_check))
query("V6_duplicate_keys", _rules_sql(["duplicate"]) + "SELECT * FROM judged WHERE column_name = 'product_id'")(
    _rules("duplicate"))
query("V7_duplicate_rows", _rules_sql(["duplicate"]) + "SELECT * FROM judged WHERE column_name = 'dataset'")(
    _rules("duplicate", column=False))


@query("V8_column_profile", RAW + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, 'string' AS dtype, count(*) - count({c}) AS null_count, "
    f"{S.rnd(f'(count(*) - count({c})) * 100 / greatest(count(*), 1)', 2)} AS null_pct, "
    f"count(DISTINCT {c}) AS unique_count FROM raw" for c in RAW_COLUMNS))
def v8(spark, sf):
    return quality.column_profile(raw_catalogue(spark, sf))


_ALL = _rules_sql(["schema", "missing", "empty", "dtype", "range", "duplicate"])


@query("V9_issue_table", _ALL + "SELECT * FROM judged")
def v9(spark, sf):
    return quality.issues(quality.measure(raw_catalogue(spark, sf)))


@query("V9_verdict", _ALL + """
SELECT count(*) FILTER (WHERE failed AND severity = 'error') AS errors, count(*) FILTER (WHERE failed AND severity = 'warning') AS warnings,
  sum(CASE WHEN issue_type = 'missing' THEN hits ELSE 0 END)::BIGINT AS missing_values,
  sum(CASE WHEN issue_type = 'duplicate' THEN hits ELSE 0 END)::BIGINT AS duplicate_values,
  count(*) FILTER (WHERE failed AND severity = 'error') = 0 AS passed FROM judged""")
def v9_verdict(spark, sf):
    return quality.verdict(quality.issues(quality.measure(raw_catalogue(spark, sf))))


_LOAD_RULES = (
    quality.Rule("discounted_price_range_valid", "range", "discounted_price", "warning", None, 0.0, 1e6),
    quality.Rule("actual_price_range_valid", "range", "actual_price", "warning", None, 0.0, 1e6),
    quality.Rule("rating_count_range_valid", "range", "rating_count", "warning", None, 0.0, 1e18),
)


@query("L9_load_limits", f"""{RAW}, measured AS ({' UNION ALL '.join(_rule_sql(r) for r in _LOAD_RULES)})
SELECT rule, hits, judged, min_found, max_found, (SELECT count(*) >= 100 FROM raw) AS enough_records FROM measured""")
def l9(spark, sf):
    raw = raw_catalogue(spark, sf)
    enough = raw.agg(F.count("*") >= quality.LOAD_LIMITS["min_records"]).scalar()
    return quality.measure(raw, _LOAD_RULES).select(
        "rule", "hits", "judged", "min_found", "max_found", enough.alias("enough_records"))


# ---------------------------------------------------------------- scalar cleaning

def scalar(key: str, sql_expr: str, expr, source=raw_catalogue, cte=RAW, view="raw", key_column="ingest_order"):
    """A projection of one cleaned value per row."""

    texts = "about_product" in sql_expr

    @query(key, cte + f"SELECT {key_column}, {sql_expr} AS value FROM {view}")
    def job(spark, sf):
        return source(spark, sf, texts).select(key_column, expr().alias("value"))

    return job


scalar("T1_parse_price", S.price("discounted_price"), lambda: numbers.parse_price(F.col("discounted_price")))
scalar("T2_parse_percent", S.percent("discount_percentage"),
       lambda: numbers.parse_percent(F.col("discount_percentage")))
scalar("T3_parse_rating", S.rating("rating"), lambda: numbers.parse_rating(F.col("rating")))
scalar("T4_parse_count", S.digits("rating_count"), lambda: numbers.parse_count(F.col("rating_count")))
_KEPT = "regexp_replace(trim(rating), '[^0-9.-]', '', 'g')"
scalar("T5_safe_number",
       f"coalesce(CASE WHEN lower(trim(rating)) NOT IN ('nan', 'none', 'null') THEN {S.num(_KEPT)} END, -1.0)",
       lambda: numbers.safe_number(F.col("rating"), -1.0))
_TRICKY = "CASE WHEN ingest_order % 5 = 0 THEN ' None ' ELSE product_name END"
scalar("T6_safe_text",
       f"CASE WHEN {_TRICKY} IS NULL OR lower(trim({_TRICKY})) IN ('nan', 'none', 'null') THEN '?' ELSE trim({_TRICKY}) END",
       lambda: numbers.safe_text(
           F.when(F.col("ingest_order") % 5 == 0, " None ").otherwise(F.col("product_name")), "?"))
scalar("T7_normalise_text", S.normalise("product_name || ' [x] ' || about_product"),
       lambda: text.normalise(F.concat("product_name", F.lit(" [x] "), "about_product")))
scalar("T8_clean_description", S.normalise(S.description("about_product")),
       lambda: text.normalise(text.clean_description(F.col("about_product"))))
scalar("T9_drop_stop_words", S.drop_stops(S.normalise("about_product"), S.NOISE),
       lambda: text.drop_stops(
           text.normalise(F.col("about_product")), text.english_stops() + text.CATALOGUE_NOISE))
scalar("T10_clean_category", S.squeeze("' ' || replace(category, '|', '  |  ')"),
       lambda: text.clean_category(F.concat(F.lit(" "), F.regexp_replace("category", r"\|", "  |  "))))
scalar("T12_first_image", "split_part(split_part(img_link, '|', 1), ',', 1) || ' ' || coalesce(starts_with(trim(img_link), 'http'), false)",
       lambda: F.concat(text.first_image(F.col("img_link")), F.lit(" "),
                        text.is_web_link(F.col("img_link")).cast("string")))
_CAMEL = "replace(product_name, ' ', '') || 'HDCables&' || replace(coalesce(category, ''), '|', 'XYz')"
scalar("T15_readable_category",
       f"trim(replace(regexp_replace(regexp_replace(coalesce({_CAMEL}, ''), '([a-z])([A-Z])', '\\1 \\2', 'g'), "
       "'([A-Z])([A-Z][a-z])', '\\1 \\2', 'g'), '&', ' & '))",
       lambda: text.readable_category(F.concat(
           F.regexp_replace("product_name", " ", ""), F.lit("HDCables&"),
           F.regexp_replace(F.coalesce("category", F.lit("")), r"\|", "XYz"))))
scalar("T17_short_description", "array_to_string(string_split(about_product, '|')[1:2], ' ')",
       lambda: text.short_description(F.col("about_product")))


@query("T11_format_price", CAT + f"""
SELECT product_id, '₹' || {S.fmt('discounted_price', 0)} AS price_text,
  CASE WHEN actual_price <= 0 THEN '0%' ELSE round_even((actual_price - discounted_price) / actual_price * 100, 0)::BIGINT || '%' END AS discount_text
FROM catalogue""")
def t11(spark, sf):
    return catalogue(spark, sf, text=False).select(
        "product_id",
        numbers.price_text(F.col("discounted_price")).alias("price_text"),
        numbers.discount_text(F.col("actual_price"), F.col("discounted_price")).alias("discount_text"))


_REVIEWS = f"""{S.CATALOGUE},
shown AS (SELECT product_id,
  replace(category, '|', ',') || CASE WHEN product_id::BIGINT % 3 = 0 THEN '|a|b|c' ELSE '' END AS user_name,
  CASE WHEN product_id::BIGINT % 4 <> 0 THEN replace(product_name, ' ', ',') END AS review_title,
  CASE WHEN about_product <> '' THEN about_product END AS review_content FROM catalogue)"""


def reviews(spark, sf):
    key = F.col("product_id").cast("bigint")
    return catalogue(spark, sf).select(
        "product_id",
        F.concat(F.regexp_replace("category", r"\|", ","),
                 F.when(key % 3 == 0, "|a|b|c").otherwise("")).alias("user_name"),
        F.when(key % 4 != 0, F.regexp_replace("product_name", " ", ",")).alias("review_title"),
        F.when(F.col("about_product") != "", F.col("about_product")).alias("review_content"))


@query("T13_unnest_reviews", S.with_(_REVIEWS) + """
, lists AS (SELECT product_id, coalesce(regexp_split_to_array(nullif(user_name, ''), '[,|]'), []) AS n,
  coalesce(regexp_split_to_array(nullif(review_title, ''), '[,|]'), []) AS t,
  coalesce(regexp_split_to_array(nullif(review_content, ''), '[,|]'), []) AS c FROM shown),
numbered AS (SELECT *, unnest(range(1, 1 + least(greatest(len(n), 1), 5))) AS i FROM lists
  WHERE len(n) + len(t) + len(c) > 0)
SELECT product_id, i::BIGINT AS position,
  coalesce(nullif(trim(n[i]), ''), 'Amazon Customer') AS reviewer,
  coalesce(nullif(trim(t[i]), ''), 'Review') AS title,
  coalesce(nullif(trim(c[i]), ''), 'No review content provided.') AS content FROM numbered""")
def t13(spark, sf):
    from aislerank.operators.search import unnest_reviews

    return unnest_reviews(reviews(spark, sf))


@query("T14_shown_discount", CAT + """
SELECT product_id, CASE WHEN actual_price > discounted_price AND p > 0 AND p < 100 THEN p END AS shown_pct
FROM (SELECT *, floor((actual_price - discounted_price) / actual_price * 100 + 0.5)::BIGINT AS p FROM catalogue)""")
def t14(spark, sf):
    return catalogue(spark, sf, text=False).select(
        "product_id",
        numbers.shown_discount(F.col("actual_price"), F.col("discounted_price")).alias("shown_pct"))


@query("T16_display_price", RAW + f"""
SELECT ingest_order, coalesce(nullif({S.price('discounted_price')}, 0), nullif({S.price('actual_price')}, 0), 999) AS price FROM raw""")
def t16(spark, sf):
    typed = cleaning.parse_numbers(raw_catalogue(spark, sf, text=False))
    return typed.select("ingest_order", numbers.display_price(
        F.col("discounted_price"), F.col("actual_price")).alias("price"))


# ---------------------------------------------------------------- duplicates and gaps


@query("N1_drop_exact_copies", S.with_(NUMERIC) + f"SELECT {COLS}, ingest_order FROM uniq")
def n1(spark, sf):
    return cleaning.drop_exact_copies(cleaning.parse_numbers(raw_catalogue(spark, sf)))


@query("N2_first_per_product", S.with_(NUMERIC) + f"SELECT {COLS}, ingest_order FROM firsts")
def n2(spark, sf):
    return cleaning.deduplicated(raw_catalogue(spark, sf))


@query("N3_median_rating", S.with_(FILLED) + "SELECT product_id, rating FROM filled")
def n3(spark, sf):
    return cleaning.impute_rating(cleaning.deduplicated(raw_catalogue(spark, sf))).select("product_id", "rating")


@query("N4_constant_fill", S.with_(FILLED) +
       "SELECT product_id, about_product, rating_count, discount_percentage FROM filled")
def n4(spark, sf):
    return cleaning.fill_constants(cleaning.deduplicated(raw_catalogue(spark, sf))).select(
        "product_id", "about_product", "rating_count", "discount_percentage")


@query("N5_mutual_price_fill", S.with_(FILLED) + "SELECT product_id, discounted_price, actual_price FROM filled")
def n5(spark, sf):
    return cleaning.fill_prices(cleaning.deduplicated(raw_catalogue(spark, sf))).select(
        "product_id", "discounted_price", "actual_price")


@query("N6_drop_incomplete", S.with_(FILLED) + f"SELECT {COLS}, ingest_order FROM whole")
def n6(spark, sf):
    return cleaning.without_gaps(cleaning.deduplicated(raw_catalogue(spark, sf)))


@query("N7_row_accounting", S.with_(FILLED) + """
SELECT (SELECT count(*) FROM raw) AS rows_in,
  (SELECT count(*) FROM raw) - (SELECT count(*) FROM uniq) AS exact_copies,
  (SELECT count(*) FROM uniq) - (SELECT count(*) FROM firsts) AS product_copies,
  (SELECT (count(*) - count(about_product)) + (count(*) - count(rating)) + (count(*) - count(rating_count))
    + (count(*) - count(discount_percentage)) + (count(*) - count(discounted_price)) + (count(*) - count(actual_price)) FROM firsts) AS values_filled,
  (SELECT count(*) FROM filled) - (SELECT count(*) FROM whole) AS rows_dropped,
  (SELECT count(*) FROM whole) AS rows_out""")
def n7(spark, sf):
    return cleaning.row_accounting(raw_catalogue(spark, sf))


# ---------------------------------------------------------------- features


@query("F1_combined_text", S.with_(TEXTED) + "SELECT product_id, combined_text, combined_text_tfidf FROM texted")
def f1(spark, sf):
    return features.add_text(clean(spark, sf)).select("product_id", "combined_text", "combined_text_tfidf")


@query("F2_vocabulary_estimate", S.with_(TEXTED) + """
SELECT count(DISTINCT w) AS vocabulary FROM (SELECT unnest(string_split(combined_text_tfidf, ' ')) AS w FROM texted) WHERE w <> ''""")
def f2(spark, sf):
    return features.vocabulary_estimate(features.add_text(clean(spark, sf)))


@query("F3_category_levels", S.with_(FILLED) +
       f"SELECT product_id, {S.level(1)} AS category_l1, {S.level(2)} AS category_l2, {S.level(3)} AS category_l3 FROM whole")
def f3(spark, sf):
    return features.add_levels(clean(spark, sf)).select("product_id", "category_l1", "category_l2", "category_l3")


@query("F4_brand", S.with_(FILLED) + f"SELECT product_id, {S.brand()} AS brand FROM whole")
def f4(spark, sf):
    return clean(spark, sf).select("product_id", text.brand_of(F.col("product_name")).alias("brand"))


@query("F5_price_bucket", RAW + f"""
SELECT ingest_order, {S.bucket(S.price('discounted_price'))} AS price_bucket FROM raw""")
def f5(spark, sf):
    return raw_catalogue(spark, sf, text=False).select(
        "ingest_order",
        features.price_bucket(numbers.parse_price(F.col("discounted_price"))).alias("price_bucket"))


@query("F6_bucket_distribution", S.with_(FILLED) + f"""
SELECT {S.bucket()} AS price_bucket, count(*) AS products FROM whole GROUP BY 1""")
def f6(spark, sf):
    df = clean(spark, sf).withColumn("price_bucket", features.price_bucket(F.col("discounted_price")))
    return features.bucket_distribution(df)


@query("F7_price_share", CAT + f"""
SELECT product_id, {S.rnd('discounted_price / (SELECT max(discounted_price) FROM catalogue)', 9)} AS price_normalized FROM catalogue""")
def f7(spark, sf):
    return features.add_price_share(catalogue(spark, sf, text=False)).select(
        "product_id", rounded(F.col("price_normalized"), 9).alias("price_normalized"))


@query("F8_popularity", FEAT + "SELECT product_id, popularity_score FROM features")
def f8(spark, sf):
    return features.add_popularity(catalogue(spark, sf, text=False)).select("product_id", "popularity_score")


@query("F9_popularity_stats", FEAT + f"""
SELECT {S.rnd('min(popularity_score)', 4)} AS min, {S.rnd('max(popularity_score)', 4)} AS max,
  {S.rnd('avg(popularity_score)', 4)} AS mean, {S.rnd('median(popularity_score)', 4)} AS median FROM features""")
def f9(spark, sf):
    return features.popularity_stats(features.add_popularity(catalogue(spark, sf, text=False)))


_TIER = ("CASE WHEN {0} IS NULL OR {0} <= 0 THEN 'No Discount' WHEN {0} < 20 THEN 'Low' "
         "WHEN {0} < 40 THEN 'Medium' ELSE 'High' END")


@query("F10_discount_tier", CAT + "SELECT product_id, " + _TIER.format("(discount_percentage * 8 - 20)") +
       " AS discount_tier FROM catalogue")
def f10(spark, sf):
    return catalogue(spark, sf, text=False).select(
        "product_id", features.discount_tier(F.col("discount_percentage") * 8 - 20).alias("discount_tier"))


@query("F11_flags", S.with_(FILLED) + f"""
SELECT product_id, (rating >= 4.0)::BIGINT AS is_highly_rated, ({S.bucket()} = 'Budget')::BIGINT AS is_budget,
  (length(trim(about_product)) > 10)::BIGINT AS has_description,
  coalesce(starts_with(trim(img_link), 'http'), false)::BIGINT AS has_image FROM whole""")
def f11(spark, sf):
    df = clean(spark, sf).withColumn("price_bucket", features.price_bucket(F.col("discounted_price")))
    return features.add_flags(df).select(
        "product_id", "is_highly_rated", "is_budget", "has_description", "has_image")


TREND = f"""{S.FEATURES},
heat AS (SELECT *, least(greatest(popularity_score, 0), 1) * (1 + ln(1 + greatest(coalesce(rating_count, 0), 0)) * 0.95) AS heat FROM features),
trend AS (SELECT * EXCLUDE (heat), {S.rnd('heat / (SELECT max(heat) FROM heat)', 9)} AS trending_score FROM heat)"""


@query("F12_trending_score", S.with_(TREND) + "SELECT product_id, trending_score FROM trend")
def f12(spark, sf):
    return features.add_trend(features.add_popularity(catalogue(spark, sf, text=False))).select(
        "product_id", "trending_score")
