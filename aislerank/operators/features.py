"""Feature columns of the catalogue."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aislerank.functions import text
from aislerank.functions.numbers import rounded
from aislerank.settings import PRICE_BUCKETS

TEXT_FIELDS = ("product_name", "category", "about_product")


def combined_text(columns: Sequence[str], fields: Sequence[str] = TEXT_FIELDS) -> Column:
    """The chosen fields joined by spaces, the cleaned variant of a field preferred."""
    names = [f"{f}_clean" if f"{f}_clean" in columns else f for f in fields]
    names = [n for n in names if n in columns] or ["product_name"]
    return F.trim(F.concat_ws(" ", *[F.coalesce(F.col(n), F.lit("")) for n in names]))


def add_text(df: DataFrame, fields: Sequence[str] = TEXT_FIELDS,
             stops: Sequence[str] | None = None) -> DataFrame:
    stops = text.english_stops() if stops is None else stops
    return df.withColumn("combined_text", combined_text(df.columns, fields)).withColumn(
        "combined_text_tfidf", text.drop_stops(F.col("combined_text"), stops))


def vocabulary_estimate(df: DataFrame) -> DataFrame:
    words = df.select(F.explode(F.array_distinct(F.split("combined_text_tfidf", " "))).alias("word"))
    return words.filter("word <> ''").agg(F.count_distinct("word").alias("vocabulary"))


def price_bucket(price: Column, buckets=PRICE_BUCKETS) -> Column:
    label = F.when(price.isNull() | (price < 0), "Unknown")
    for low, high, name in buckets:
        label = label.when((price >= low) & (price < high), name)
    return label.otherwise(buckets[-1][2])


def discount_tier(percent: Column) -> Column:
    return (
        F.when(percent.isNull() | (percent <= 0), "No Discount")
        .when(percent < 20, "Low")
        .when(percent < 40, "Medium")
        .otherwise("High")
    )


def raw_popularity(rating_weight: float = 0.7, count_weight: float = 0.3) -> Column:
    rating = F.least(F.greatest(F.coalesce("rating", F.lit(0.0)), F.lit(0.0)), F.lit(5.0))
    count = F.greatest(F.coalesce("rating_count", F.lit(0.0)), F.lit(0.0))
    return F.pow(rating, F.lit(rating_weight)) * F.pow(F.log1p(count), F.lit(count_weight))


def _share_of_max(df: DataFrame, value: Column) -> Column:
    """value / max(value) with the maximum as a scalar subquery over two narrow columns."""
    top = df.select(F.max(value).alias("m")).scalar()
    return F.when(top > 0, value / top).otherwise(F.lit(0.0))


def add_popularity(df: DataFrame, rating_weight: float = 0.7, count_weight: float = 0.3) -> DataFrame:
    share = _share_of_max(df, raw_popularity(rating_weight, count_weight))
    return df.withColumn("popularity_score", rounded(share, 6))


def popularity_stats(df: DataFrame, approximate: bool = False) -> DataFrame:
    p = F.col("popularity_score")
    middle = F.percentile_approx(p, 0.5, 10000) if approximate else F.median(p)
    return df.agg(
        rounded(F.min(p), 4).alias("min"), rounded(F.max(p), 4).alias("max"),
        rounded(F.avg(p), 4).alias("mean"), rounded(middle, 4).alias("median"))


def add_price_share(df: DataFrame) -> DataFrame:
    share = _share_of_max(df, F.col("discounted_price"))
    return df.withColumn("price_normalized", F.greatest(F.least(share, F.lit(1.0)), F.lit(0.0)))


def bucket_distribution(df: DataFrame) -> DataFrame:
    return df.groupBy("price_bucket").agg(F.count("*").alias("products"))


def add_trend(df: DataFrame, decay: float = 0.95) -> DataFrame:
    pop = F.least(F.greatest(F.coalesce("popularity_score", F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    count = F.greatest(F.coalesce("rating_count", F.lit(0.0)), F.lit(0.0))
    raw = pop * (1 + F.log1p(count) * decay)
    return df.withColumn("trending_score", rounded(_share_of_max(df, raw), 9))


def add_levels(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {f"category_l{i + 1}": text.category_level(F.col("category"), i) for i in range(3)})


def add_flags(df: DataFrame) -> DataFrame:
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("bigint")
    return df.withColumns({
        "is_highly_rated": flag(F.col("rating") >= 4.0),
        "is_budget": flag(F.col("price_bucket") == "Budget"),
        "has_description": flag(F.length(F.trim("about_product")) > 10),
        "has_image": flag(text.is_web_link(F.col("img_link"))),
    })


def labelled(df: DataFrame) -> DataFrame:
    """Columns every ranking job needs; no text work."""
    return add_popularity(
        add_levels(df)
        .withColumn("brand", text.brand_of(F.col("product_name")))
        .withColumn("price_bucket", price_bucket(F.col("discounted_price"))))


def featured(clean: DataFrame) -> DataFrame:
    """The full feature table."""
    df = add_price_share(labelled(add_text(clean)))
    return add_flags(df.withColumn("discount_tier", discount_tier(F.col("discount_percentage"))))
