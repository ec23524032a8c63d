"""Data-quality rules: any list of rules compiles to one aggregate pass plus the duplicate counts."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aislerank.functions.numbers import checked_number, trimmed_text
from aislerank.settings import RAW_COLUMNS


@dataclass(frozen=True)
class Rule:
    name: str
    check: str  # schema | missing | empty | dtype | range | duplicate
    column: str | None
    severity: str
    threshold: float | None = None
    low: float | None = None
    high: float | None = None


# The rule set, in reporting order.
RULES = (
    Rule("required_columns_present", "schema", None, "error"),
    Rule("product_id_not_null", "missing", "product_id", "error", 0.01),
    Rule("product_name_not_null", "missing", "product_name", "error", 0.05),
    Rule("category_not_null", "missing", "category", "error", 0.10),
    Rule("discounted_price_not_null", "missing", "discounted_price", "error", 0.20),
    Rule("actual_price_not_null", "missing", "actual_price", "warning", 0.30),
    Rule("rating_not_null", "missing", "rating", "warning", 0.30),
    Rule("about_product_not_null", "missing", "about_product", "warning", 0.40),
    Rule("product_name_not_empty", "empty", "product_name", "warning", 0.05),
    Rule("category_not_empty", "empty", "category", "warning", 0.10),
    Rule("about_product_not_empty", "empty", "about_product", "warning", 0.40),
    Rule("rating_parseable_numeric", "dtype", "rating", "warning", 0.30),
    Rule("rating_count_parseable_numeric", "dtype", "rating_count", "warning", 0.30),
    Rule("rating_range_valid", "range", "rating", "warning", None, 0.0, 5.0),
    Rule("discount_pct_range_valid", "range", "discount_percentage", "warning", None, 0.0, 100.0),
    Rule("no_duplicate_product_ids", "duplicate", "product_id", "warning", 0.20),
    Rule("no_duplicate_rows", "duplicate", None, "warning", 0.10),
)

# Extra thresholds declared for a load.
LOAD_LIMITS = {"max_missing_ratio": 0.30, "max_duplicate_ratio": 0.10, "min_records": 100,
               "min_price": 0.0, "max_price": 1_000_000.0, "min_rating_count": 0}


def schema_check(df: DataFrame, expected: Sequence[str] = RAW_COLUMNS,
                 ignore: Sequence[str] = ("ingest_order",)) -> DataFrame:
    """One row: missing and extra columns (names trimmed, lower-cased) and the record count."""
    found = {c.strip().lower() for c in df.columns if c not in ignore}
    missing, extra = sorted(set(expected) - found), sorted(found - set(expected))
    return df.agg(F.count("*").alias("records")).select(
        F.lit(",".join(missing)).alias("missing_columns"),
        F.lit(",".join(extra)).alias("extra_columns"),
        F.lit(not missing).alias("passed"),
        "records",
    )


def is_blank(column: Column) -> Column:
    """Whitespace only or the literal nan; a missing value counts, as its text form is nan."""
    return column.isNull() | (trimmed_text(column) == "") | (column == "nan")


def row_digest(columns: Sequence[str]) -> Column:
    """SHA-256 of the whole row, so that a duplicate check shuffles 64 bytes, not the texts."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def duplicates(df: DataFrame, key: Column) -> DataFrame:
    """One row: how many rows repeat an earlier key.  NULL is one key.  Copies merge map-side."""
    return (
        df.groupBy(key.alias("k"))
        .agg(F.count("*").alias("n"))
        .agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))
    )


def _count(flag: Column) -> Column:
    return F.coalesce(F.sum(F.when(flag, 1).otherwise(0)), F.lit(0)).cast("bigint")


def measure(df: DataFrame, rules: Sequence[Rule] = RULES,
            content: Sequence[str] = RAW_COLUMNS) -> DataFrame:
    """One row per rule with ``hits``, the observed extremes and the number of rows judged."""
    present = set(df.columns)
    aggregates, subqueries = [F.count("*").alias("total")], {}
    for i, rule in enumerate(rules):
        col = F.col(rule.column) if rule.column in present else None
        if rule.check == "duplicate":
            key = col if rule.column else row_digest([c for c in content if c in present])
            if key is not None:
                subqueries[i] = duplicates(df, key)
            continue
        if col is None:
            continue
        value = checked_number(col)
        flag = {
            "missing": col.isNull(),
            "empty": is_blank(col),
            "dtype": col.isNotNull() & value.isNull(),
            "range": (value < rule.low) | (value > rule.high) if rule.low is not None else None,
        }[rule.check]
        aggregates.append(_count(flag).alias(f"h{i}"))
        if rule.check == "range":
            aggregates += [F.min(value).alias(f"lo{i}"), F.max(value).alias(f"hi{i}"),
                           F.count(value).alias(f"n{i}")]
    measured = df.agg(*aggregates)
    names = set(measured.columns)
    for i, counted in subqueries.items():
        measured = measured.withColumn(f"h{i}", counted.scalar())
        names.add(f"h{i}")
    missing_columns = len({c for c in content} - {c.strip().lower() for c in present})

    def entry(i: int, rule: Rule) -> Column:
        hits = F.lit(missing_columns) if rule.check == "schema" else (
            F.col(f"h{i}") if f"h{i}" in names else F.lit(0))
        judged = F.col(f"n{i}") if f"n{i}" in names else F.col("total")
        low = F.col(f"lo{i}") if f"lo{i}" in names else F.lit(None)
        high = F.col(f"hi{i}") if f"hi{i}" in names else F.lit(None)
        return F.struct(
            F.lit(rule.name).alias("rule"),
            F.lit(rule.check).alias("issue_type"),
            F.lit(rule.column or "dataset").alias("column_name"),
            F.lit(rule.severity).alias("severity"),
            F.lit(rule.threshold).cast("double").alias("threshold"),
            hits.cast("bigint").alias("hits"),
            judged.cast("bigint").alias("judged"),
            low.cast("double").alias("min_found"),
            high.cast("double").alias("max_found"),
        )

    return measured.select(F.inline(F.array(*[entry(i, r) for i, r in enumerate(rules)])))


def issues(measured: DataFrame) -> DataFrame:
    """Adds the ratio and whether the rule failed."""
    ratio = F.col("hits") / F.greatest(F.col("judged"), F.lit(1))
    failed = F.when(F.col("issue_type").isin("schema", "range"), F.col("hits") > 0).otherwise(
        ratio > F.col("threshold"))
    return measured.withColumn("ratio", F.rint(ratio * 1e6) / 1e6).withColumn("failed", failed)


def verdict(judged: DataFrame) -> DataFrame:
    """One row: the run passes unless an error-severity rule failed."""
    bad = lambda s: F.sum(F.when(F.col("failed") & (F.col("severity") == s), 1).otherwise(0))
    of = lambda kind: F.sum(F.when(F.col("issue_type") == kind, F.col("hits")).otherwise(0))
    return judged.agg(
        bad("error").alias("errors"),
        bad("warning").alias("warnings"),
        of("missing").alias("missing_values"),
        of("duplicate").alias("duplicate_values"),
    ).withColumn("passed", F.col("errors") == 0)


class DataQualityError(ValueError):
    """An error-severity rule failed."""


def enforce(verdict_row: DataFrame) -> None:
    """Raise on a failed verdict (reads that one row)."""
    row = verdict_row.first()
    if not row["passed"]:
        raise DataQualityError(f"{row['errors']} error-severity rule(s) failed")


def column_profile(df: DataFrame, columns: Sequence[str] = RAW_COLUMNS,
                   approximate: bool = False) -> DataFrame:
    """One row per column: nulls, percent null, distinct values, type.

    Distinct values are counted over (column, value) pairs that combine map-side, a long value
    standing in as its SHA-256; ``approximate=True`` keeps one sketch per column instead.
    """
    aggregates = [F.count("*").alias("total")]
    for c in columns:
        aggregates.append(_count(F.col(c).isNull()).alias(f"n_{c}"))
        if approximate:
            aggregates.append(F.approx_count_distinct(F.col(c)).alias(f"d_{c}"))
    types = dict(df.dtypes)
    rows = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.lit(types[c]).alias("dtype"),
            F.col(f"n_{c}").alias("null_count"),
            (F.rint(F.col(f"n_{c}") * 10000 / F.greatest("total", F.lit(1))) / 100).alias("null_pct"),
            (F.col(f"d_{c}") if approximate else F.lit(0).cast("bigint")).alias("unique_count"),
        )
        for c in columns
    ]
    profile = df.agg(*aggregates).select(F.inline(F.array(*rows)))
    if approximate:
        return profile

    def short(c: str) -> Column:
        value = F.col(c).cast("string")
        return F.when(F.length(value) < 64, value).otherwise(F.sha2(value, 256))

    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), short(c).alias("v")) for c in columns])
    distinct = df.select(F.inline_outer(cells)).filter("v IS NOT NULL").distinct().groupBy("column_name").agg(
        F.count("*").alias("found"))
    # One row per column.
    return profile.join(F.broadcast(distinct), "column_name", "left").select(
        "column_name", "dtype", "null_count", "null_pct", F.coalesce("found", F.lit(0)).alias("unique_count"))
