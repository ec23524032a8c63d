"""Joins whose left side may hold very many rows of one key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A key is hot when it holds more than 1/SHARE of the left rows, so there are fewer than SHARE of
# them and their list may always be broadcast.
SHARE = 1000
FLOOR = 10_000


def salted_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner",
                floor: int = FLOOR) -> DataFrame:
    """Equi-join on ``key``.  A hot key is cut into as many pieces of about ``floor`` rows as it has,
    and its right row is repeated for each; all other keys join once.  The left side is read twice,
    so pass one that is cheap or already written."""
    if how not in ("inner", "left"):
        raise ValueError("only inner and left joins keep their meaning when the right side is repeated")
    total = left.agg(F.count("*").alias("n")).scalar()
    hot = left.groupBy(key).agg(F.count("*").alias("_n")).filter(
        (F.col("_n") > floor) & (F.col("_n") > total / SHARE)).select(
            F.col(key), F.ceil(F.col("_n") / floor).cast("int").alias("_hot"))
    # By content, so that a retried task deals its rows out as before.
    pick = F.pmod(F.xxhash64(*left.columns), F.col("_hot").cast("long")).cast("int")
    spread = F.sequence(F.lit(0), F.col("_hot") - 1)
    dealt = left.join(F.broadcast(hot), key, "left").withColumn(
        "_salt", F.when(F.col("_hot").isNotNull(), pick).otherwise(0)).drop("_hot")
    repeated = right.join(F.broadcast(hot), key, "left").withColumn(
        "_salt", F.explode(F.when(F.col("_hot").isNotNull(), spread).otherwise(F.array(F.lit(0))))).drop("_hot")
    return dealt.join(repeated, [key, "_salt"], how).drop("_salt")
