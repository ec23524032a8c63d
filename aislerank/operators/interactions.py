"""Session events: validation, repeat views, histories, wishlists and carts (batch form)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aislerank.functions.numbers import trimmed_text
from aislerank.settings import EVENT_WEIGHTS

EVENT_TYPES = tuple(EVENT_WEIGHTS)


def event_time(value: Column) -> Column:
    """A timestamp from ISO text, epoch seconds or epoch milliseconds given as text."""
    number = value.try_cast("double")
    return F.coalesce(
        F.when(number >= 1e11, F.timestamp_millis(number.cast("bigint"))),
        F.when(number.isNotNull(), F.timestamp_seconds(number)),
        F.try_to_timestamp(value))


def validated(events: DataFrame) -> DataFrame:
    """Known types in lower case, anything else a view; events without a product are rejected."""
    kind = F.lower(trimmed_text(F.col("event_type")))
    return (
        events.withColumn("product_id", trimmed_text(F.col("product_id"))).filter("product_id <> ''")
        .withColumn("event_type", F.when(kind.isin(*EVENT_TYPES), kind).otherwise("view")))


def _micros() -> Column:
    return F.unix_micros("ts")


def collapse_repeat_views(events: DataFrame, gap_seconds: float = 60) -> DataFrame:
    """A view of the product that was the session's newest event, less than the gap later, merges
    into it: the pair becomes one ``repeat_view`` with the later time.

    Only neighbours matter, so the row that ends a chain of merges carries its result: its own time,
    and ``repeat_view`` if it was itself merged.  A neighbour counts only within the gap, so a
    session is cut into time slices with a margin of one gap on either side.  A session that holds
    a third of all events is therefore spread over many tasks.
    """
    gap = int(gap_seconds * 1_000_000)
    slice_width = max(3_600_000_000, 2 * gap)
    own = F.floor(F.col("us") / slice_width).cast("bigint")
    near = lambda shift: F.floor((F.col("us") + shift) / slice_width).cast("bigint")
    sliced = (
        events.withColumn("us", _micros()).withColumn("own", own)
        .withColumn("slice", F.explode(F.array_distinct(F.array(own, near(-gap), near(gap))))))
    w = Window.partitionBy("session_id", "slice").orderBy("us", "event_id")
    merges = (
        (F.col("event_type") == "view")
        & (F.lag("product_id").over(w) == F.col("product_id"))
        & F.lag("event_type").over(w).isin("view", "repeat_view")
        & (F.col("us") - F.lag("us").over(w) < gap))
    flagged = sliced.withColumn("merged", F.coalesce(merges, F.lit(False)))
    ends = flagged.withColumn("absorbed", F.coalesce(F.lead("merged").over(w), F.lit(False)))
    return (
        ends.filter((F.col("slice") == F.col("own")) & ~F.col("absorbed"))
        .withColumn("event_type", F.when(F.col("merged"), "repeat_view").otherwise(F.col("event_type")))
        .select(*events.columns))


def newest(events: DataFrame, n: int = 50) -> DataFrame:
    """The n newest events per session; the limit is applied before the shuffle as well."""
    w = Window.partitionBy("session_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return events.withColumn("position", F.row_number().over(w) - 1).filter(F.col("position") < n)


def recently_viewed(events: DataFrame, kept: int = 15, shown: int = 5) -> DataFrame:
    """Distinct products per session, last viewed first."""
    views = events.filter(F.col("event_type").isin("view", "repeat_view"))
    last = views.groupBy("session_id", "product_id").agg(F.max("ts").alias("ts"))
    w = Window.partitionBy("session_id").orderBy(F.desc("ts"), "product_id")
    return last.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= kept).withColumn(
        "shown", F.col("position") <= shown)


def retract_wishlist(events: DataFrame, removals: DataFrame) -> DataFrame:
    """Drop the wishlist events of a product that were removed at or after their time."""
    last = removals.groupBy("session_id", "product_id").agg(F.max("ts").alias("removed_at"))
    joined = events.join(last, ["session_id", "product_id"], "left")
    gone = (F.col("event_type") == "wishlist") & (F.col("removed_at") >= F.col("ts"))
    return joined.filter(~F.coalesce(gone, F.lit(False))).drop("removed_at")


def wishlist(events: DataFrame) -> DataFrame:
    """Products toggled an odd number of times."""
    return (events.filter("event_type = 'wishlist'").groupBy("session_id", "product_id")
            .agg(F.count("*").alias("toggles")).filter("toggles % 2 = 1").select("session_id", "product_id"))


def cart(events: DataFrame, removals: DataFrame) -> DataFrame:
    """Products whose latest action is an add."""
    adds = events.filter("event_type = 'cart'").select("session_id", "product_id", "ts", F.lit(1).alias("add"))
    drops = removals.select("session_id", "product_id", "ts", F.lit(0).alias("add"))
    return (adds.unionAll(drops).groupBy("session_id", "product_id")
            .agg(F.max_by("add", F.struct("ts", "add")).alias("last")).filter("last = 1")
            .select("session_id", "product_id"))


def positions(events: DataFrame, tie: str = "event_id", slice_seconds: int = 86400) -> DataFrame:
    """Adds ``position``, 0 for the newest event of the session.

    A row number inside each time slice plus the sizes of the later slices, so that a long session
    is numbered by many tasks.
    """
    sliced = events.withColumn("_s", F.floor(F.unix_seconds("ts") / slice_seconds))
    sizes = sliced.groupBy("session_id", "_s").agg(F.count("*").alias("_n"))
    later = Window.partitionBy("session_id").orderBy(F.desc("_s")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("session_id", "_s", F.coalesce(F.sum("_n").over(later), F.lit(0)).alias("_o"))
    inner = Window.partitionBy("session_id", "_s").orderBy(F.desc("ts"), F.desc(tie))
    return sliced.withColumn("_r", F.row_number().over(inner)).join(offsets, ["session_id", "_s"]).withColumn(
        "position", (F.col("_r") - 1 + F.col("_o")).cast("bigint")).drop("_s", "_r", "_o")


def first_occurrences(events: DataFrame) -> DataFrame:
    """The newest event of each product in a session (an ordered dedupe, newest first)."""
    picked = events.groupBy("session_id", "product_id").agg(
        F.max_by(F.struct("event_id", "event_type", "ts"), F.struct("ts", "event_id")).alias("e"))
    return picked.select("session_id", "product_id", "e.event_id", "e.event_type", "e.ts")


def history_from_list(df: DataFrame, column: str = "history") -> DataFrame:
    """(session_id, product_id, position) from a comma list, newest first, blanks dropped."""
    ids = F.filter(F.transform(F.split(column, ","), lambda x: F.trim(x)), lambda x: x != "")
    return df.select("session_id", F.posexplode(ids).alias("position", "product_id"))
