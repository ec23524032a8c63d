"""Shared pieces of the DuckDB statements that check the Spark jobs.

Each statement is written on its own from the definition of the operator; only the views over the
given tables are shared, as common table expressions.
"""

from __future__ import annotations

from aislerank import settings
from aislerank.functions.text import CATALOGUE_NOISE, KEYWORD_STOPS, NOT_A_BRAND, english_stops

PLAIN = "[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?"


def rnd(expr: str, digits: int) -> str:
    scale = 10**digits
    return f"(round_even(({expr}) * {scale}.0::DOUBLE, 0) / {scale}.0::DOUBLE)"


def num(expr: str) -> str:
    return f"(CASE WHEN regexp_full_match(trim({expr}), '{PLAIN}') THEN try_cast(trim({expr}) AS DOUBLE) END)"


def words(items) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in items) + ")"


def fmt(expr: str, digits: int) -> str:
    return f"format('{{:,.{digits}f}}', {expr})"


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


ENGLISH = words(english_stops())
NOISE = words(tuple(english_stops()) + CATALOGUE_NOISE)
BRAND_STOPS = words(NOT_A_BRAND)
KEY_STOPS = words(KEYWORD_STOPS)

CATALOGUE = f"""
li AS (
  SELECT l_partkey, count(*) AS n,
         sum(round_even(l_discount * 100, 0)::BIGINT)::BIGINT AS cents,
         sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END)::BIGINT AS returned
  FROM lineitem GROUP BY l_partkey),
parts AS (
  SELECT *, {rnd('p_retailprice * p_size / 3', 2)} AS ap FROM part),
catalogue AS (
  SELECT p_partkey::VARCHAR AS product_id,
         p_brand || ' ' || p_name AS product_name,
         p_type || '|' || split_part(p_name, ' ', 2) || '|' || split_part(p_name, ' ', 1) AS category,
         {rnd('ap * (100 * n - cents) / (100 * n)', 2)} AS discounted_price,
         ap AS actual_price,
         {rnd('cents / n', 2)} AS discount_percentage,
         {rnd('5.0::DOUBLE * (n - returned) / n', 1)} AS rating,
         (n * 40)::DOUBLE AS rating_count,
         coalesce(text, '') AS about_product,
         'https://img.example/' || p_partkey || '.jpg|https://img.example/x.jpg' AS img_link,
         'https://shop.example/' || p_partkey AS product_link
  FROM parts LEFT JOIN li ON p_partkey = l_partkey LEFT JOIN documents ON doc_id = p_partkey)"""


def _gap(rest: int, expr: str) -> str:
    return f"CASE WHEN k % 17 <> {rest} THEN {expr} END"


RAW = f"""{CATALOGUE},
keyed AS (SELECT *, product_id::BIGINT AS k FROM catalogue),
raw_once AS (
  SELECT product_id,
    CASE WHEN k % 101 <> 0 THEN CASE WHEN k % 19 = 0 THEN 'The ' || product_name ELSE product_name END END AS product_name,
    CASE WHEN k % 103 <> 0 THEN category END AS category,
    {_gap(3, "'₹' || " + fmt('discounted_price', 2))} AS discounted_price,
    {_gap(5, "'₹' || " + fmt('actual_price', 2))} AS actual_price,
    {_gap(7, fmt('discount_percentage', 2) + " || '%'")} AS discount_percentage,
    CASE WHEN k % 17 = 9 THEN NULL WHEN k % 17 = 11 THEN 'Get'
         WHEN k % 17 = 13 THEN {fmt('rating', 1)} || ' out of 5'
         WHEN k % 17 = 15 THEN '1' || {fmt('rating', 1)} ELSE {fmt('rating', 1)} END AS rating,
    {_gap(2, fmt('rating_count', 0))} AS rating_count,
    {_gap(4, "'[''' || replace(about_product, '.', '|') || ''']'")} AS about_product,
    {_gap(6, 'img_link')} AS img_link,
    product_link, k AS ingest_order
  FROM keyed),
raw AS (
  SELECT * FROM raw_once
  UNION ALL SELECT * REPLACE (ingest_order + 1000000000000 AS ingest_order) FROM raw_once WHERE ingest_order % 17 = 1
  UNION ALL SELECT * REPLACE (product_name || ' again' AS product_name, ingest_order + 1000000000000 AS ingest_order)
            FROM raw_once WHERE ingest_order % 17 = 8)"""


def price(expr: str) -> str:
    return num(f"regexp_replace({expr}, '[₹$€£¥,\\s]', '', 'g')")


def percent(expr: str) -> str:
    return num(f"regexp_replace({expr}, '[%\\s]', '', 'g')")


def rating(expr: str) -> str:
    got = f"try_cast(regexp_extract(replace({expr}, ',', '.'), '([0-9]+[.]?[0-9]*)', 1) AS DOUBLE)"
    return f"(CASE WHEN {got} BETWEEN 0 AND 5 THEN {got} END)"


def digits(expr: str) -> str:
    kept = f"regexp_replace(regexp_replace({expr}, '[.]0+$', ''), '[^0-9]', '', 'g')"
    return f"(CASE WHEN {kept} <> '' THEN try_cast({kept} AS DOUBLE) END)"


def checked(expr: str) -> str:
    return num(f"regexp_replace({expr}, '[₹,% ]', '', 'g')")


def squeeze(expr: str) -> str:
    return f"trim(regexp_replace({expr}, '\\s+', ' ', 'g'))"


MARKS = "[\\[\\]''\"{}()]"


def normalise(expr: str) -> str:
    inner = f"regexp_replace(regexp_replace(lower({expr}), '{MARKS}', ' ', 'g'), '[^a-z0-9\\s]', ' ', 'g')"
    return f"(CASE WHEN {expr} IS NULL OR trim({expr}) IN ('', 'nan', 'None') THEN '' ELSE {squeeze(inner)} END)"


def description(expr: str) -> str:
    inner = f"replace(regexp_replace({expr}, '{MARKS}', ' ', 'g'), '|', ' ')"
    return f"(CASE WHEN {expr} IS NULL OR trim({expr}) IN ('', 'nan') THEN '' ELSE {squeeze(inner)} END)"


def drop_stops(expr: str, stops: str = ENGLISH) -> str:
    return (
        f"array_to_string(list_filter(regexp_split_to_array(trim({expr}), '\\s+'), "
        f"lambda w: length(w) > 1 AND w NOT IN {stops}), ' ')"
    )


def level(n: int, expr: str = "category") -> str:
    return f"coalesce(trim(split_part({expr}, '|', {n})), '')"


def brand(expr: str = "product_name") -> str:
    heads = f"regexp_split_to_array(trim({expr}), '\\s+')[1:3]"
    fit = (
        f"list_filter(list_transform({heads}, lambda w: regexp_replace(w, '[^a-zA-Z0-9]', '', 'g')), "
        f"lambda w: length(w) > 1 AND lower(w) NOT IN {BRAND_STOPS})[1]"
    )
    return f"coalesce(upper({fit}[1:1]) || lower({fit}[2:]), 'Unknown')"


def bucket(expr: str = "discounted_price") -> str:
    arms = " ".join(
        f"WHEN {expr} >= {lo} AND {expr} < {hi} THEN '{label}'"
        for lo, hi, label in settings.PRICE_BUCKETS
    )
    last = settings.PRICE_BUCKETS[-1][2]
    return f"(CASE WHEN {expr} IS NULL OR {expr} < 0 THEN 'Unknown' {arms} ELSE '{last}' END)"


POP_RAW = (
    "pow(least(greatest(coalesce(rating, 0), 0), 5), 0.7) * "
    "pow(ln(1 + greatest(coalesce(rating_count, 0), 0)), 0.3)"
)

FEATURES = f"""{CATALOGUE},
scored AS (SELECT *, {POP_RAW} AS pop_raw FROM catalogue),
features AS (
  SELECT * EXCLUDE (pop_raw),
         {level(1)} AS category_l1, {level(2)} AS category_l2, {level(3)} AS category_l3,
         {brand()} AS brand, {bucket()} AS price_bucket,
         CASE WHEN (SELECT max(pop_raw) FROM scored) > 0
              THEN {rnd('pop_raw / (SELECT max(pop_raw) FROM scored)', 6)} ELSE 0 END AS popularity_score
  FROM scored)"""
