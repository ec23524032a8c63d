"""Raw text catalogue -> typed, de-duplicated, gap-free catalogue."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aislerank.functions import numbers, text
from aislerank.operators.quality import row_digest
from aislerank.settings import RAW_COLUMNS

CRITICAL = ("product_id", "product_name", "category")


def trim_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip() for c in df.columns])


def parse_numbers(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "discounted_price": numbers.parse_price(F.col("discounted_price")),
        "actual_price": numbers.parse_price(F.col("actual_price")),
        "discount_percentage": numbers.parse_percent(F.col("discount_percentage")),
        "rating": numbers.parse_rating(F.col("rating")),
        "rating_count": numbers.parse_count(F.col("rating_count")),
    })


def keep_first(df: DataFrame, keys: Sequence[Column], order: str) -> DataFrame:
    """The earliest row of each key.

    An aggregate, not a window: every map task keeps one row per key, so a key that holds a third
    of the table never meets in one task as more than one row per map task.
    """
    names = df.columns
    picked = df.groupBy(*[k.alias(f"_k{i}") for i, k in enumerate(keys)]).agg(
        F.min_by(F.struct(*names), F.col(order)).alias("_row"))
    return picked.select(*[F.col("_row")[n].alias(n) for n in names])


def drop_exact_copies(df: DataFrame, content: Sequence[str] = RAW_COLUMNS,
                      order: str = "ingest_order") -> DataFrame:
    return keep_first(df, [row_digest(content)], order)


def first_per_product(df: DataFrame, order: str = "ingest_order") -> DataFrame:
    return keep_first(df, [F.col("product_id")], order)


def median_of(df: DataFrame, column: str, default: float, approximate: bool = False) -> Column:
    """Scalar subquery.  The exact form holds one counter per distinct value."""
    middle = F.percentile_approx(column, 0.5, 10000) if approximate else F.median(column)
    return df.select(F.coalesce(middle, F.lit(default)).alias("m")).scalar()


def impute_rating(df: DataFrame, default: float = 4.0, approximate: bool = False) -> DataFrame:
    return df.withColumn(
        "rating", F.coalesce(F.col("rating"), median_of(df, "rating", default, approximate)))


def fill_constants(df: DataFrame) -> DataFrame:
    return df.fillna({"about_product": "", "rating_count": 0.0, "discount_percentage": 0.0})


def fill_prices(df: DataFrame) -> DataFrame:
    sale, full = F.col("discounted_price"), F.col("actual_price")
    return df.withColumns({
        "discounted_price": F.coalesce(sale, full), "actual_price": F.coalesce(full, sale)})


def drop_incomplete(df: DataFrame, columns: Sequence[str] = CRITICAL) -> DataFrame:
    return df.dropna(subset=list(columns))


def add_clean_text(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "product_name_clean": text.normalise(F.col("product_name")),
        "category_clean": text.clean_category(F.col("category")),
        "about_product_clean": text.normalised_description(F.col("about_product")),
    })


def deduplicated(raw: DataFrame) -> DataFrame:
    """Typed rows, exact copies gone, first row of each product kept."""
    return first_per_product(drop_exact_copies(parse_numbers(trim_names(raw))))


def without_gaps(df: DataFrame) -> DataFrame:
    return drop_incomplete(fill_prices(fill_constants(impute_rating(df))))


def cleaned(raw: DataFrame) -> DataFrame:
    return add_clean_text(without_gaps(deduplicated(raw)))


def row_accounting(raw: DataFrame) -> DataFrame:
    """One row: rows in, both kinds of copies, values filled, rows dropped, rows out.

    The two duplicate counts come from one pass: identical rows collapse to one row with a count,
    then the products are counted over what is left.
    """
    typed = parse_numbers(trim_names(raw))
    unique = typed.groupBy(row_digest(RAW_COLUMNS).alias("digest")).agg(
        F.count("*").alias("copies"),
        F.min_by(F.struct(*typed.columns), F.col("ingest_order")).alias("row"))
    per_product = unique.groupBy(F.col("row.product_id").alias("product_id")).agg(
        F.sum("copies").alias("rows_in"), F.count("*").alias("distinct_rows"),
        F.min_by("row", F.col("row.ingest_order")).alias("row"))
    missing = lambda c: F.when(F.col(f"row.{c}").isNull(), 1).otherwise(0)
    sale, full = F.col("row.discounted_price"), F.col("row.actual_price")
    # A missing sale price is filled from the full price and the reverse; with both missing the
    # first fill changes nothing, so each missing price counts once.
    filled = (
        missing("about_product") + missing("rating") + missing("rating_count")
        + missing("discount_percentage") + F.when(sale.isNull(), 1).otherwise(0)
        + F.when(full.isNull(), 1).otherwise(0))
    incomplete = F.greatest(*[missing(c) for c in CRITICAL])
    return per_product.agg(
        F.sum("rows_in").alias("rows_in"),
        F.sum(F.col("rows_in") - F.col("distinct_rows")).alias("exact_copies"),
        F.sum(F.col("distinct_rows") - 1).alias("product_copies"),
        F.sum(filled).alias("values_filled"),
        F.sum(incomplete).alias("rows_dropped"),
        F.sum(1 - incomplete).alias("rows_out"),
    )
