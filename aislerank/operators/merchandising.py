"""Co-purchase, windowed trends, click-through, conversion, deals, arrivals and spelling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aislerank.functions.numbers import rounded
from aislerank.operators.vectors import best_per
from aislerank.session import cut


def co_purchases(lines: DataFrame, k: int = 10, min_together: int = 2, large: int = 500) -> DataFrame:
    """(query_id, product_id, together, rank): products most often in the same basket, exact.

    Baskets of up to ``large`` products are paired directly.  In a larger basket all pairs would be
    too many, so its pairs are never formed: the products that are in the same large baskets are one
    *class*, two products share as many large baskets as their classes, and all products of one class
    tie, so that the first k + 1 of them by id stand for all.  What pairs of products share in small and in
    large baskets is counted apart and added.

    A pair is formed and counted once, smaller id first.  One that too few small baskets hold goes no further
    than its count, unless both products are in large baskets as well.
    """
    lines = cut(lines.select("basket", "product_id").distinct())
    sizes = lines.groupBy("basket").agg(F.count("*").alias("n"))
    small = lines.join(sizes.filter(F.col("n") <= large), "basket", "left_semi")
    big = cut(lines.join(sizes.filter(F.col("n") > large).select("basket"), "basket"))
    if big.isEmpty():
        found = _pairs(small.withColumn("in_big", F.lit(False)), min_together).select(_both_ways("together"))
        return best_per(found, "query_id", "together", "product_id", k)

    # A class is named by two hashes of its baskets, so no product gathers its baskets in one list.
    mark = lambda seed: F.xxhash64(F.lit(seed), "basket")
    signed = cut(big.groupBy("product_id").agg(F.concat_ws(
        "-", F.hex(F.bit_xor(mark(1))), F.sum(mark(2).cast("decimal(38,0)")), F.count("*")).alias("sig")))
    first = cut(signed.withColumn("i", F.row_number().over(Window.partitionBy("sig").orderBy("product_id"))).filter(
        F.col("i") <= k + 1))
    classes = cut(first.filter("i = 1").join(big, "product_id").select("sig", "basket"))

    q = signed.select(F.col("product_id").alias("query_id"), F.col("sig").alias("q_sig"))
    flagged = small.join(signed.select("product_id", F.lit(True).alias("in_big")), "product_id", "left")
    seen = cut(_pairs(flagged.withColumn("in_big", F.coalesce("in_big", F.lit(False))), min_together))
    classed = cut(seen.filter("both_big").join(q, "query_id").join(signed, "product_id"))
    meeting = classes_that_meet(classes, min_together)
    wanted = meeting.union(classed.select("q_sig", "sig")).distinct()
    shared = cut(wanted.join(classes.withColumnRenamed("sig", "q_sig"), "q_sig").join(classes, ["sig", "basket"]).groupBy(
        "q_sig", "sig").agg(F.count("*").alias("in_large")))
    # Pairs seen in small baskets gain what their classes share.
    gained = classed.join(shared, ["q_sig", "sig"], "left").select(
        "query_id", "product_id", (F.col("together") + F.coalesce("in_large", F.lit(0))).alias("together"))
    both = seen.filter("NOT both_big").select("query_id", "product_id", "together").unionByName(gained).select(_both_ways("together"))
    # Per class the best ids over all classes it overlaps; one list serves all its products.
    lists = best_per(shared.filter(F.col("in_large") >= min_together).join(first.select("sig", "product_id"), "sig"),
                     "q_sig", "in_large", "product_id", k + 1)
    unseen = q.join(lists.select("q_sig", "product_id", F.col("in_large").alias("together")), "q_sig").filter(
        "query_id <> product_id").select("query_id", "product_id", "together")
    merged = both.unionByName(unseen).groupBy("query_id", "product_id").agg(F.max("together").alias("together"))
    return best_per(merged.filter(F.col("together") >= min_together), "query_id", "together", "product_id", k)


def _pairs(lines: DataFrame, min_together: int) -> DataFrame:
    """(query_id, product_id, together, both_big), query_id the smaller: pairs with enough baskets (basket, product_id,
    in_big) in common, and pairs of ``in_big`` products."""
    other = lines.select("basket", F.col("product_id").alias("query_id"), F.col("in_big").alias("q_big"))
    return (
        other.join(lines, "basket").filter("query_id < product_id").groupBy("query_id", "product_id")
        .agg(F.count("*").alias("together"), F.first(F.col("q_big") & F.col("in_big")).alias("both_big"))
        .filter((F.col("together") >= min_together) | F.col("both_big")))


def _both_ways(count: str) -> Column:
    """A pair as two rows, one for either product."""
    a, b = F.col("query_id"), F.col("product_id")
    row = lambda x, y: F.struct(x.alias("query_id"), y.alias("product_id"), F.col(count))
    return F.inline(F.array(row(a, b), row(b, a)))


def classes_that_meet(classes: DataFrame, least: int) -> DataFrame:
    """(q_sig, sig): pairs of classes (sig, basket) that may share ``least`` baskets or more.

    Baskets have one order, the narrow ones first.  Of the baskets that two classes share, the first one has
    ``least`` - 1 others after it, so each class is looked up by all its baskets except the last
    ``least`` - 1: the widest basket of all, which every product may be in, brings no pairs together.
    """
    width = classes.groupBy("basket").agg(F.count("*").alias("width"))
    last = Window.partitionBy("sig").orderBy(F.desc("width"), F.desc("basket"))
    left_out = classes.join(width, "basket").withColumn("_r", F.row_number().over(last)).filter(
        F.col("_r") < least).select("sig", "basket")
    kept = classes.join(left_out, ["sig", "basket"], "left_anti")
    return kept.withColumnRenamed("sig", "q_sig").join(kept, "basket").select("q_sig", "sig").distinct()


def windowed_trend(events: DataFrame, k: int = 10, hours: int = 24, decay: float = 0.95, min_count: int = 5) -> DataFrame:
    """Per window the products with the largest sum of decay^(hours before the window's end)."""
    span = F.window("ts", f"{hours} hours")
    aged = events.select("product_id", "ts", span.alias("w"))
    age = (F.unix_micros(F.col("w.end").cast("timestamp")) - F.unix_micros("ts")) / 3.6e9
    scored = aged.groupBy(F.unix_micros(F.col("w.start").cast("timestamp")).alias("window_start"), "product_id").agg(
        F.count("*").alias("events"), rounded(F.sum(F.pow(F.lit(decay), age)), 6).alias("score")).filter(
            F.col("events") >= min_count)
    return best_per(scored, "window_start", "score", "product_id", k)


def click_through(events: DataFrame, by: str = "engine", hours: int = 24, min_impressions: int = 10) -> DataFrame:
    """Per window and engine: impressions, clicks and their ratio, enough impressions only."""
    flag = lambda kind: F.sum(F.when(F.col("event_type") == kind, 1).otherwise(0))
    return (
        events.groupBy(F.window("ts", f"{hours} hours").alias("w"), by)
        .agg(flag("view").alias("impressions"), flag("click").alias("clicks"))
        .filter(F.col("impressions") >= min_impressions)
        .select(F.unix_micros(F.col("w.start").cast("timestamp")).alias("window_start"), by, "impressions", "clicks",
                rounded(F.col("clicks") / F.col("impressions"), 6).alias("ctr")))


def conversions(events: DataFrame, minutes: int = 30) -> DataFrame:
    """Every click with the time of the session's next purchase if it came within the window.

    The next purchase is a running minimum over the rows that follow, so clicks and purchases are
    never paired up.  Sessions are cut into time slices; purchases early in a slice are copied to the
    slice before, which makes the cut exact and keeps a very long session on many tasks.
    """
    span = minutes * 60 * 1_000_000
    width = max(3_600_000_000, span)
    us = F.unix_micros("ts")
    rows = events.filter(F.col("event_type").isin("click", "purchase")).withColumn("us", us).withColumn(
        "own", F.floor(F.col("us") / width))
    back = F.floor((F.col("us") - span) / width)
    slices = F.when(F.col("event_type") == "purchase", F.array_distinct(F.array("own", back))).otherwise(F.array("own"))
    ahead = Window.partitionBy("session_id", "slice").orderBy("us").rangeBetween(0, Window.unboundedFollowing)
    bought = F.min(F.when(F.col("event_type") == "purchase", F.col("us"))).over(ahead)
    return (
        rows.withColumn("slice", F.explode(slices)).withColumn("next", bought)
        .filter("event_type = 'click'")
        .select("event_id", "session_id", F.col("us").alias("clicked_at"),
                F.when(F.col("next") - F.col("us") <= span, F.col("next")).alias("purchased_at")))


def deals(catalogue: DataFrame, k: int = 10, min_discount: float = 20.0) -> DataFrame:
    return catalogue.filter(F.col("discount_percentage") >= min_discount).orderBy(
        F.desc("discount_percentage"), "product_id").limit(k)


def new_arrivals(products: DataFrame, k: int = 10, days: int = 30) -> DataFrame:
    """``products`` carries ``arrived`` (date); the newest date is today."""
    today = products.agg(F.max("arrived").alias("d")).scalar()
    return products.withColumn("today", today).filter(F.col("arrived") >= F.date_sub("today", days)).orderBy(
        F.desc("arrived"), "product_id").limit(k)


def top_rated(catalogue: DataFrame, k: int = 10) -> DataFrame:
    return catalogue.orderBy(F.desc("rating"), F.desc("rating_count"), "product_id").limit(k)


def best_sellers(catalogue: DataFrame, k: int = 10) -> DataFrame:
    return catalogue.orderBy(F.desc("popularity_score"), "product_id").limit(k)


def likeness(a: Column, b: Column) -> Column:
    """100 (1 - edits / longer length)."""
    return 100 * (1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b)))


def correction_candidates(typed: DataFrame, vocabulary: DataFrame, min_score: float = 75.0) -> DataFrame:
    """(typed, word): every pair that can reach the score, found by equality of pieces at their places.

    A score of s allows a word of n letters at most e = n (100 - s) / s edits, so it is cut into
    e + 1 pieces.  With d edits between two given lengths, some untouched piece i <= d has exactly i
    edits before it and at most d - i after it, so it stands in the typed text at most i places off,
    and at most d - i off when counted from the end.  Words are filed by (length, piece number,
    piece); a typed text asks only for the lengths, numbers and places this allows.
    """
    share = (100 - min_score) / 100
    budget = lambda n: F.floor(n * (share / (1 - share)) + 1e-9).cast("int")
    begin = lambda i, n: F.floor(i * n / (budget(n) + 1)).cast("int")
    n = F.length("word")
    pieces = F.transform(F.sequence(F.lit(0), budget(n)), lambda i: F.struct(
        i.alias("number"), F.substring(F.col("word"), begin(i, n) + 1, begin(i + 1, n) - begin(i, n)).alias("piece")))
    filed = vocabulary.select("word").filter("length(word) > 0").distinct().select(
        "word", n.alias("length"), F.inline(pieces))

    own, length, number = F.length("typed"), F.col("length"), F.col("number")
    least, most = F.floor(own * (1 - share) - 1e-9).cast("int"), F.ceil(own / (1 - share) + 1e-9).cast("int")
    edits = F.floor(F.greatest(own, length) * share + 1e-9).cast("int")
    asked = (
        typed.select("typed").filter("length(typed) > 0").distinct()
        .select("typed", F.explode(F.sequence(F.greatest(least, F.lit(1)), most)).alias("length"))
        .withColumn("edits", edits).filter(F.abs(own - length) <= F.col("edits"))
        .withColumn("number", F.explode(F.sequence(F.lit(0), F.least("edits", budget(length)))))
        .withColumn("low", F.greatest(-number, own - length - F.col("edits") + number))
        .withColumn("high", F.least(number, own - length + F.col("edits") - number))
        .filter("low <= high")
        .withColumn("shift", F.explode(F.sequence("low", "high")))
        .withColumn("at", begin(number, length) + F.col("shift"))
        .withColumn("size", begin(number + 1, length) - begin(number, length))
        .filter((F.col("at") >= 0) & (F.col("at") + F.col("size") <= own))
        .select("typed", "length", "number", F.substring(F.col("typed"), F.col("at") + 1, F.col("size")).alias("piece"))
        .distinct())
    return asked.join(filed, ["length", "number", "piece"]).select("typed", "word").distinct()


def corrections(typed: DataFrame, vocabulary: DataFrame, min_score: float = 75.0, k: int = 3) -> DataFrame:
    """(typed, word, score, rank): the closest vocabulary words, exact, without comparing all pairs."""
    scored = correction_candidates(typed, vocabulary, min_score).withColumn(
        "score", rounded(likeness(F.col("typed"), F.col("word")), 6)).filter(F.col("score") >= min_score)
    return best_per(scored, "typed", "score", "word", k)
