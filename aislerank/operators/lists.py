"""Short ranked lists per group, and giving every query the list of its group.

Rankings inside a group do not depend on the query, so each group is ranked once and only its best
few rows are kept.  A query then reads its lists as array columns and merges them in place: no
query x candidate table, and no window over queries, ever exists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What a candidate carries with it, so that results need no second look-up in the catalogue.
CARRIED = (
    "product_id", "category_l1", "category_l2", "brand", "discounted_price", "price_bucket",
    "rating", "rating_count", "popularity_score",
)


def candidate(*extra: str) -> Column:
    return F.struct(*CARRIED, *extra)


def group_lists(df: DataFrame, key: str, n: int, score: str = "popularity_score",
                extra: tuple[str, ...] = ()) -> DataFrame:
    """(key, items): the n best rows of each group, best first, ties by id.

    The rank filter is applied before the shuffle as well, so a group that holds a third of the
    catalogue sends n rows per map task.
    """
    order = Window.partitionBy(key).orderBy(F.desc(score), F.asc("product_id"))
    best = df.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= n)
    return best.groupBy(key).agg(
        F.sort_array(F.collect_list(F.struct("_n", candidate(*extra).alias("c")))).alias("items")
    ).select(key, F.transform("items", lambda e: e["c"]).alias("items"))


def overall_list(df: DataFrame, n: int, score: str = "popularity_score",
                 extra: tuple[str, ...] = ()) -> Column:
    """The n best rows of the whole table as one array value (a scalar subquery)."""
    best = df.orderBy(F.desc(score), F.asc("product_id")).limit(n)
    return best.agg(
        F.sort_array(F.collect_list(
            F.struct((-F.col(score)).alias("s"), F.col("product_id").alias("i"), candidate(*extra).alias("c"))))
        .alias("items")
    ).select(F.transform("items", lambda e: e["c"]).alias("items")).scalar()


def attach(queries: DataFrame, lists: DataFrame, key: str, alias: str, salts: int = 16, few: bool = False) -> DataFrame:
    """Left join of queries to the lists of their group, as column ``alias``.

    Many queries may share one group, so they are dealt out over ``salts`` tasks and the short
    lists are repeated; a small list table is broadcast by the planner's own size check, and one that
    has but a ``few`` rows (price buckets) always.
    """
    if few:
        return queries.join(F.broadcast(lists.select(key, F.col("items").alias(alias))), key, "left")
    salted = lists.select(
        F.col(key), F.col("items").alias(alias),
        F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"))
    return (
        queries.withColumn("_salt", F.pmod(F.xxhash64("query_id"), F.lit(salts)).cast("int"))
        .join(salted, [key, "_salt"], "left").drop("_salt"))


def tiers(*parts: tuple[Column, float]) -> Column:
    """Concatenate lists, best tier first, marking each item with the score of its tier."""

    def mark(items: Column, score: float) -> Column:
        marked = F.transform(items, lambda e: F.struct(e.alias("c"), F.lit(float(score)).alias("match")))
        return F.coalesce(marked, F.array())

    return F.concat(*[mark(items, score) for items, score in parts])


def unfold(df: DataFrame, items: Column, k: int, keep: tuple[str, ...]) -> DataFrame:
    """One row per list entry with its rank: ``keep`` columns, rank, match, candidate fields c_*."""
    rows = df.select(*keep, F.posexplode_outer(F.slice(items, 1, k)).alias("_p", "_e")).filter("_p IS NOT NULL")
    fields = [F.col(f"_e.c.{name}").alias("product_id" if name == "product_id" else f"c_{name}") for name in CARRIED]
    return rows.select(*keep, (F.col("_p") + 1).alias("rank"), F.col("_e.match").alias("match"), *fields)
