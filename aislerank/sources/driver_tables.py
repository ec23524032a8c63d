"""The catalogue, its raw-text form, interactions and logs as views over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aislerank.functions.numbers import rounded
from aislerank.session import cut

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Use all cores on an input of fewer splits than cores; leave a large scan as it is."""
    wanted = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(wanted, key) if df.rdd.getNumPartitions() < wanted else df


def catalogue(spark: SparkSession, sf_dir: str, text: bool = True) -> DataFrame:
    """One row per part.  ``text=False`` leaves the documents table unread.

    What the lines come to is written first: features read the catalogue again for each of their maxima."""
    lines = cut(
        table(spark, sf_dir, "lineitem")
        .groupBy("l_partkey")
        .agg(
            F.count("*").alias("n"),
            F.sum(F.rint(F.col("l_discount") * 100).cast("bigint")).alias("cents"),
            F.sum(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("returned"),
        )
    )
    words = F.split("p_name", " ")
    rows = (
        spread(table(spark, sf_dir, "part"), "p_partkey")
        .join(lines, F.col("p_partkey") == F.col("l_partkey"), "left")
        .withColumn("actual_price", rounded(F.col("p_retailprice") * F.col("p_size") / 3, 2))
    )
    if text:
        docs = table(spark, sf_dir, "documents").select("doc_id", "text")
        rows = rows.join(docs, F.col("doc_id") == F.col("p_partkey"), "left")
    return rows.select(
        F.col("p_partkey").cast("string").alias("product_id"),
        F.concat_ws(" ", "p_brand", "p_name").alias("product_name"),
        F.concat_ws("|", "p_type", words[1], words[0]).alias("category"),
        rounded(
            F.col("actual_price") * (100 * F.col("n") - F.col("cents")) / (100 * F.col("n")), 2
        ).alias("discounted_price"),
        "actual_price",
        rounded(F.col("cents") / F.col("n"), 2).alias("discount_percentage"),
        rounded(5.0 * (F.col("n") - F.col("returned")) / F.col("n"), 1).alias("rating"),
        (F.col("n") * 40).cast("double").alias("rating_count"),
        (F.coalesce(F.col("text"), F.lit("")) if text else F.lit("")).alias("about_product"),
        F.concat(F.lit("https://img.example/"), F.col("p_partkey"), F.lit(".jpg|https://img.example/x.jpg"))
        .alias("img_link"),
        F.concat(F.lit("https://shop.example/"), F.col("p_partkey")).alias("product_link"),
    )


def raw_catalogue(spark: SparkSession, sf_dir: str, text: bool = True) -> DataFrame:
    """The catalogue as untyped text with gaps, odd spellings and duplicates.

    ``ingest_order`` is the position in the file.  Rows whose key is 1 mod 17 come twice unchanged,
    rows whose key is 8 mod 17 come a second time under another name.
    """
    key = F.col("product_id").cast("bigint")

    def gap(rest: int, value):
        return F.when(key % 17 != rest, value)

    base = catalogue(spark, sf_dir, text).select(
        "product_id",
        F.when(
            key % 101 != 0,
            F.when(key % 19 == 0, F.concat(F.lit("The "), F.col("product_name"))).otherwise(
                F.col("product_name")
            ),
        ).alias("product_name"),
        F.when(key % 103 != 0, F.col("category")).alias("category"),
        gap(3, F.concat(F.lit("₹"), F.format_number("discounted_price", 2))).alias("discounted_price"),
        gap(5, F.concat(F.lit("₹"), F.format_number("actual_price", 2))).alias("actual_price"),
        gap(7, F.concat(F.format_number("discount_percentage", 2), F.lit("%"))).alias(
            "discount_percentage"
        ),
        gap(
            9,
            F.when(key % 17 == 11, "Get")
            .when(key % 17 == 13, F.concat(F.format_number("rating", 1), F.lit(" out of 5")))
            .when(key % 17 == 15, F.concat(F.lit("1"), F.format_number("rating", 1)))
            .otherwise(F.format_number("rating", 1)),
        ).alias("rating"),
        gap(2, F.format_number("rating_count", 0)).alias("rating_count"),
        gap(
            4,
            F.concat(
                F.lit("['"), F.regexp_replace("about_product", r"[.]", "|"), F.lit("']")
            ),
        ).alias("about_product"),
        gap(6, F.col("img_link")).alias("img_link"),
        "product_link",
        key.alias("ingest_order"),
    )
    # Copies are made in place, so that the tables are read once.
    order = F.col("ingest_order")
    copies = F.when(order % 17 == 1, F.array(F.lit(""), F.lit(""))).when(
        order % 17 == 8, F.array(F.lit(""), F.lit(" again"))).otherwise(F.array(F.lit("")))
    rows = base.select("*", F.posexplode(copies).alias("_copy", "_suffix"))
    return rows.withColumns({
        "product_name": F.concat("product_name", "_suffix"),
        "ingest_order": F.col("ingest_order") + F.col("_copy") * F.lit(10**12),
    }).drop("_copy", "_suffix")


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw session events; the types still need validation."""
    event = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.col("user_id").cast("string").alias("session_id"),
        F.get_json_object("props", "$.k").alias("product_id"),
        F.when(event == "click", "Cart ")
        .when(event == "signup", "wishlist")
        .otherwise(event)
        .alias("event_type"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.lit(1).alias("quantity"),
    )
