"""Distribution drift and latency summaries."""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException

from aislerank.functions.numbers import rounded
from aislerank.session import cut

# Watched columns, bins and grade limits.
NUMERIC = ("discounted_price", "actual_price", "rating", "rating_count")
BINS = 10
PSI_LIMITS = (0.10, 0.25)
TVD_LIMITS = (0.05, 0.15)
FLOOR = 1e-4


def long_form(df: DataFrame, columns=NUMERIC) -> DataFrame:
    """(feature, value) without missing values."""
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns])
    return df.select(F.inline(cells)).filter(F.col("value").isNotNull() & ~F.isnan("value"))


def order_statistics(rows: DataFrame, key: str, ranks: Column, blocks: int = 64) -> DataFrame:
    """(key, n, rank, value): exact values at 0-based ranks; ``ranks`` is an array built from ``n``.

    Values are counted, cut into blocks by a sketch of their quantiles, and cumulated inside each
    block on top of the sizes of the lower blocks, so even one key with all rows uses many tasks.
    """
    counted = rows.groupBy(key, "value").agg(F.count("*").alias("c"))
    grid = [i / blocks for i in range(1, blocks)]
    # One row per key.  Written, because a sketch that is made twice may cut its blocks in two ways.
    shape = cut(rows.groupBy(key).agg(F.percentile_approx("value", grid, 1000).alias("edges"), F.count("*").alias("n")))
    blocked = counted.join(shape.select(key, "edges"), key).withColumn(
        "block", F.size(F.filter("edges", lambda e: e < F.col("value")))).drop("edges")
    sizes = blocked.groupBy(key, "block").agg(F.sum("c").alias("b"))
    lower = Window.partitionBy(key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(key, "block", F.coalesce(F.sum("b").over(lower), F.lit(0)).alias("o"))
    inner = Window.partitionBy(key, "block").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    placed = blocked.withColumn("s", F.sum("c").over(inner)).join(offsets, [key, "block"]).select(
        key, "value", (F.col("s") + F.col("o") - F.col("c")).alias("first"), (F.col("s") + F.col("o")).alias("after"))
    wanted = shape.select(key, "n", ranks.alias("ranks"))
    return placed.join(wanted, key).select(
        key, "n", "value", F.explode(F.filter(
            "ranks", lambda r: (r >= F.col("first")) & (r < F.col("after")))).alias("rank"))


def quantile_edges(rows: DataFrame, bins: int = BINS) -> DataFrame:
    """(feature, edges): distinct quantiles 0, 1/bins, ... 1 with linear interpolation."""
    steps = F.sequence(F.lit(0), F.lit(bins))
    at = lambda i: i / F.lit(float(bins)) * (F.col("n") - 1)
    ranks = F.array_distinct(F.flatten(F.transform(steps, lambda i: F.array(
        F.floor(at(i)).cast("bigint"), F.ceil(at(i)).cast("bigint")))))
    found = order_statistics(rows, "feature", ranks).groupBy("feature", "n").agg(
        F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("v"))
    low = lambda i: F.col("v")[F.floor(at(i)).cast("bigint")]
    high = lambda i: F.col("v")[F.ceil(at(i)).cast("bigint")]
    edges = F.transform(steps, lambda i: low(i) + (high(i) - low(i)) * (at(i) - F.floor(at(i))))
    return found.select("feature", F.array_sort(F.array_distinct(edges)).alias("edges"))


def bin_counts(rows: DataFrame, edges: DataFrame, open_ended: bool = False) -> DataFrame:
    """(feature, bin, n): left-closed bins, the last one closed; values outside are dropped or, with
    ``open_ended``, counted in the first and last bin.

    ``edges`` has one short array per watched column and is joined by broadcast.
    """
    binned = rows.join(F.broadcast(edges), "feature")
    if not open_ended:
        binned = binned.filter((F.col("value") >= F.col("edges")[0]) & (F.col("value") <= F.element_at("edges", -1)))
    index = F.greatest(F.lit(1), F.least(F.size(F.filter("edges", lambda e: e <= F.col("value"))), F.size("edges") - 1))
    return binned.groupBy("feature", index.alias("bin")).agg(F.count("*").alias("n"))


def baseline_bins(df: DataFrame, columns=NUMERIC, bins: int = BINS) -> DataFrame:
    """(feature, bin, edge_low, edge_high, n), empty bins included; what a baseline stores."""
    rows = long_form(df, columns)
    edges = quantile_edges(rows, bins)
    grid = edges.filter(F.size("edges") >= 3).select(
        "feature", "edges", F.explode(F.sequence(F.lit(1), F.size("edges") - 1)).alias("bin"))
    return grid.join(bin_counts(rows, edges), ["feature", "bin"], "left").select(
        "feature", "bin", F.col("edges")[F.col("bin") - 1].alias("edge_low"), F.col("edges")[F.col("bin")].alias("edge_high"),
        F.coalesce("n", F.lit(0)).alias("n"))


def category_counts(df: DataFrame) -> DataFrame:
    return df.groupBy(F.split("category", r"\|")[0].alias("level")).agg(F.count("*").alias("n"))


def psi(baseline: DataFrame, current: DataFrame, open_ended: bool = False) -> DataFrame:
    """(feature, value) from stored baseline bins and the current rows; ``open_ended`` as in bin_counts."""
    edges = baseline.groupBy("feature").agg(F.array_sort(F.array_distinct(F.concat(
        F.collect_list("edge_low"), F.collect_list("edge_high")))).alias("edges"))
    now = bin_counts(current, edges, open_ended).withColumnRenamed("n", "m")
    both = baseline.join(now, ["feature", "bin"], "left").withColumn("m", F.coalesce("m", F.lit(0)))
    total = Window.partitionBy("feature")
    share = lambda c: F.greatest(F.col(c) / F.greatest(F.sum(c).over(total), F.lit(1)), F.lit(FLOOR))
    shares = both.select("feature", share("n").alias("b"), share("m").alias("c"))
    return shares.groupBy("feature").agg(
        F.sum((F.col("c") - F.col("b")) * F.log(F.col("c") / F.col("b"))).alias("value"))


def total_variation(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """One row: half the summed difference of two category distributions."""
    b = baseline.select("level", (F.col("n") / baseline.agg(F.sum("n")).scalar()).alias("p"))
    c = current.select("level", (F.col("n") / current.agg(F.sum("n")).scalar()).alias("q"))
    gap = F.abs(F.coalesce("p", F.lit(0.0)) - F.coalesce("q", F.lit(0.0)))
    return b.join(c, "level", "full_outer").agg((F.coalesce(F.sum(gap), F.lit(0.0)) / 2).alias("value"))


def grade(value: Column, limits: tuple[float, float]) -> Column:
    return F.when(value < limits[0], "none").when(value < limits[1], "moderate").otherwise("high")


def report(bins: DataFrame, counts: DataFrame, current: DataFrame) -> DataFrame:
    """(feature, metric, value, grade) of the current data against a baseline."""
    numeric = psi(bins, long_form(current)).select(
        "feature", F.lit("psi").alias("metric"), rounded(F.col("value"), 4).alias("value"),
        grade(F.col("value"), PSI_LIMITS).alias("grade"))
    category = total_variation(counts, category_counts(current)).select(
        F.lit("category").alias("feature"), F.lit("total_variation_distance").alias("metric"),
        rounded(F.col("value"), 4).alias("value"), grade(F.col("value"), TVD_LIMITS).alias("grade"))
    return numeric.unionByName(category)


def overall_grade(rows: DataFrame) -> DataFrame:
    order = F.when(F.col("grade") == "high", 2).when(F.col("grade") == "moderate", 1).otherwise(0)
    return rows.agg(F.coalesce(F.max_by("grade", order), F.lit("none")).alias("overall_grade"))


# ---------------------------------------------------------------- stored baseline


class Baseline(NamedTuple):
    """One stored version: bins and category counts as tables, and the rows they were made from."""

    version: str
    bins: DataFrame
    counts: DataFrame
    records: int


def save_baseline(df: DataFrame, path: str) -> str:
    """Add a version and return its name.

    All of a version lies in one file, which a single rename brings into sight, so a reader sees the whole
    version or none of it.  Versions are never overwritten: a check keeps the one it began with.  What
    is gathered in that file is one row per bin and per top-level category.
    """
    none = lambda kind: F.lit(None).cast(kind)
    bins = baseline_bins(df).select(
        F.lit("bin").alias("kind"), "feature", F.col("bin").cast("int"), "edge_low", "edge_high", F.col("n").cast("bigint"))
    levels = category_counts(df).select(
        F.lit("level").alias("kind"), F.col("level").alias("feature"), none("int").alias("bin"),
        none("double").alias("edge_low"), none("double").alias("edge_high"), "n")
    records = df.agg(F.count("*").alias("n")).select(
        F.lit("records").alias("kind"), none("string").alias("feature"), none("int").alias("bin"),
        none("double").alias("edge_low"), none("double").alias("edge_high"), "n")
    newest = load_baseline(df.sparkSession, path)
    number = int(newest.version.split("-")[0]) + 1 if newest else 1
    version = f"{number:012d}-{uuid.uuid4().hex}"
    bins.unionByName(levels).unionByName(records).repartition(1).withColumn("version", F.lit(version)).write.mode(
        "append").parquet(path)
    return version


def load_baseline(spark: SparkSession, path: str) -> Baseline | None:
    """The newest version; versions stored later do not change what was returned."""
    try:
        rows = spark.read.parquet(path)
    except AnalysisException:
        return None
    head = rows.filter("kind = 'records'").orderBy(F.desc("version")).select("version", "n").first()
    if head is None:
        return None
    one = rows.filter(F.col("version") == head["version"])
    return Baseline(
        head["version"], one.filter("kind = 'bin'").select("feature", "bin", "edge_low", "edge_high", "n"),
        one.filter("kind = 'level'").select(F.col("feature").alias("level"), "n"), head["n"])


def check(df: DataFrame, path: str, stored: Baseline | None = None) -> DataFrame:
    """First run: store the baseline and report no drift.  Later runs: compare, baseline untouched."""
    stored = stored or load_baseline(df.sparkSession, path)
    if stored is None:
        save_baseline(df, path)
        return df.sparkSession.range(1).select(
            F.lit("baseline_established").alias("status"), F.lit("dataset").alias("feature"),
            F.lit("none").alias("metric"), F.lit(0.0).alias("value"), F.lit("none").alias("grade"))
    return report(stored.bins, stored.counts, df).select(
        F.lit("compared").alias("status"), "feature", "metric", "value", "grade")


# ---------------------------------------------------------------- latency


def latency_summary(samples: DataFrame, path: str = "path", value: str = "duration_ms",
                    shares: tuple[float, ...] = (0.50, 0.95, 0.99)) -> DataFrame:
    """Per path: count, mean, and the sorted value at index min(n - 1, floor(n p)) for each p."""
    rows = samples.select(F.col(path).alias("path"), F.col(value).cast("double").alias("value")).filter("value IS NOT NULL")
    index = lambda p: F.least(F.col("n") - 1, F.floor(F.col("n") * p).cast("bigint"))
    found = order_statistics(rows, "path", F.array_distinct(F.array(*[index(p) for p in shares])))
    picked = found.groupBy("path").agg(*[
        F.max(F.when(F.col("rank") == index(p), F.col("value"))).alias(f"p{round(p * 100)}_ms") for p in shares])
    mean = rows.groupBy("path").agg(F.count("*").alias("count"), rounded(F.avg("value"), 2).alias("avg_ms"))
    return mean.join(picked, "path")


def latency_sketches(samples: DataFrame, path: str = "path", value: str = "duration_ms", at: str = "ts",
                     k: int = 800) -> DataFrame:
    """(path, day, count, total, sketch): a mergeable quantile sketch per path and day.

    The approximate form of ``latency_summary``, for histories whose days are written once and read
    often.  A larger ``k`` means a smaller rank error; 800 keeps it near half a percent.
    """
    rows = samples.select(F.col(path).alias("path"), F.to_date(at).alias("day"), F.col(value).cast("double").alias("value"))
    return rows.filter("value IS NOT NULL").groupBy("path", "day").agg(
        F.count("*").alias("count"), F.sum("value").alias("total"), F.kll_sketch_agg_double("value", k).alias("sketch"))


def sketched_latency(sketches: DataFrame, shares: tuple[float, ...] = (0.50, 0.95, 0.99), k: int = 800) -> DataFrame:
    """Per path the summary of any set of stored days; no sample is read again.  Counts and means are exact."""
    merged = sketches.groupBy("path").agg(
        F.sum("count").alias("count"), F.sum("total").alias("total"), F.kll_merge_agg_double("sketch", k).alias("sketch"))
    return merged.select(
        "path", "count", rounded(F.col("total") / F.col("count"), 2).alias("avg_ms"),
        *[F.kll_sketch_get_quantile_double("sketch", F.lit(p)).alias(f"p{round(p * 100)}_ms") for p in shares])


def latest_samples(samples: DataFrame, n: int = 500) -> DataFrame:
    return samples.orderBy(F.desc("ts"), F.desc("event_id")).limit(n)
