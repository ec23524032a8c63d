"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Sources get targets in words: shares of the whole by weight, stopped at `PASSES` times the source's own size. Documents
of a source are dealt by hash to blocks, and blocks are put in a permuted order. The mix takes a source in passes: whole
passes first, then the leading blocks of one more pass, the block at the end only in part.

All block draws of all passes are split among output shards by a tree: a node that stands for some shards divides its
draws of every source between its halves by a multivariate-hypergeometric draw, exact in the quotas of both (see `drawn`
for what replaces the library's draw beyond 10^9). At the
leaves a shard owns a range of each source's permuted draws, disjoint from the others'. Inside a shard documents follow
each other in a hashed order. Every draw is seeded by the node, so that reruns agree.

A null text has size 0, a null source is a source of its own and comes last. Repeated rows are documents of their own:
rows of one doc_id, text and source are numbered, so that they are dealt to different blocks, and hashes are of what a row
holds and that number, never of its place, so that reruns over other files agree. A table without words has targets 0 and takes nothing. Other columns pass through `mix` untouched.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from aislerank.llm.common import ready, row_keyed, store, table, unit_hash, word_count

WEIGHTS = (1, 2, 3)
PASSES = 3
BLOCK_WORDS = 1 << 16
BLOCK_ROWS = 1 << 10
#: A source has at most so many blocks; beyond that blocks grow, so that what is ordered per source stays bounded.
MOST_BLOCKS = 1 << 16
SHARD_WORDS = 1 << 20
#: Levels of the tree that one task splits at once.
LEVELS = 6
SEED = 3
#: Sides of a draw: numpy's bound, and what is drawn one by one beyond it.
LARGE, FEW = 10**9, 10_000

_SOURCES = ("source IS NULL", "source")


def source_targets(sized: DataFrame) -> DataFrame:
    """source, source_size, n_docs, target: one row for each source.

    With caps c and weights w, target = min(c, level * w). Sources reach their caps in order of c / w, so the level is
    what is left behind the capped ones over the weight that is left. Windows run over one row for each source.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    place = F.row_number().over(Window.orderBy(*map(F.expr, _SOURCES))) - 1
    weighed = sums.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (place % len(WEIGHTS) + 1).cast("int")))
    cap = (F.lit(PASSES) * F.col("source_size")).cast("double")
    order = Window.orderBy(F.col("cap") / F.col("weight"), *map(F.expr, _SOURCES))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    levels = (weighed.withColumn("cap", cap)
              .withColumn("left", F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
              .withColumn("weight_left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
              .withColumn("level", F.col("left") / F.col("weight_left"))
              .withColumn("open", F.col("cap") > F.col("level") * F.col("weight")))
    ordered = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first_open = F.first(F.when(F.col("open"), F.col("level")), ignorenulls=True).over(ordered)
    return levels.select(
        "source", "source_size", "n_docs",
        F.when(first_open.isNull(), F.col("cap")).otherwise(F.least("cap", first_open * F.col("weight"))).alias("target"))


def _blocks(source_size: Column, n_docs: Column) -> Column:
    wanted = F.greatest(F.ceil(source_size / BLOCK_WORDS), F.ceil(n_docs / BLOCK_ROWS), F.lit(1))
    return F.least(wanted, F.lit(MOST_BLOCKS)).cast("long")


def block_plan(dealt: DataFrame, targets: DataFrame) -> DataFrame:
    """source, block, rank (place in the source's permuted order), draws (whole passes) and part.

    part: words of one more pass that the block may give; its whole size, 0, or what is left in the block at the end.
    """
    blocks = dealt.groupBy("source", "block").agg(F.sum("size").alias("words"))
    joined = blocks.join(targets.withColumnRenamed("source", "s"), blocks["source"].eqNullSafe(F.col("s")))
    order = Window.partitionBy("source").orderBy(unit_hash(SEED, F.col("source"), F.col("block")), "block")
    ahead = F.coalesce(F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    return (joined.withColumn("rank", F.row_number().over(order) - 1).withColumn("ahead", ahead)
            .withColumn("passes", F.least(passes, F.lit(PASSES)).cast("long"))
            .withColumn("rest", F.round(F.col("target") - F.col("passes") * F.col("source_size")).cast("long"))
            .select("source", "block", "rank", "words", "passes",
                    F.greatest(F.lit(0), F.least("words", F.col("rest") - F.col("ahead"))).alias("part")))


def cut_block(frame: pd.DataFrame) -> pd.DataFrame:
    """The documents of a source's last block that fit what it may give: in hashed order, skipping what is too long;
    one more is taken if that ends nearer to the goal."""
    frame = frame.sort_values(["order", "doc_id", "size"], ignore_index=True)
    left = int(frame["part"].iloc[0])
    taken = np.zeros(len(frame), bool)
    sizes = frame["size"].tolist()
    for i, size in enumerate(sizes):
        if 0 < size <= left:
            taken[i], left = True, left - size
    over = [(size - left, i) for i, size in enumerate(sizes) if not taken[i] and size > 0]
    if over and min(over)[0] < left:
        taken[min(over)[1]] = True
    frame["extra"] = taken.astype(np.int64)
    return frame[["file", "at", "extra"]]


# ---------------------------------------------------------------- the tree


def drawn(rng: np.random.Generator, n: int, rest: int, need: int) -> int:
    """How many of `need` draws from n + rest fall on the n (hypergeometric).

    numpy draws exactly while both sides are below 10^9. Beyond that a side of at most FEW is drawn one by one, which is
    exact; larger ones by the normal limit, whose error is below one in its standard deviation. Quotas add up in any case.
    """
    total = n + rest
    if not rest or need >= total:
        return min(need, n)
    if max(n, rest) < LARGE:
        return int(rng.hypergeometric(n, rest, need))
    few = min(n, rest)
    if few <= FEW:
        hits, left = 0, need
        for at in range(few):
            hit = rng.integers(total - at) < left
            hits, left = hits + int(hit), left - int(hit)
        return hits if few == n else need - hits
    mean = need * (n / total)
    spread = math.sqrt(mean * (rest / total) * ((total - need) / (total - 1)))
    return int(min(n, need, max(0, need - rest, round(mean + spread * rng.standard_normal()))))


def split(counts: np.ndarray, shards: int, first: int, levels: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Leaves of a subtree as (first shard, number of shards, draws of each source, draws ahead of them).

    Draws are seeded by the node, which (first, shards) names.
    """
    stack = [(first, shards, counts, np.zeros_like(counts), levels)]
    while stack:
        first, shards, counts, ahead, levels = stack.pop()
        if shards == 1 or levels == 0:
            yield first, shards, counts, ahead
            continue
        half = shards // 2
        total = int(counts.sum())
        left_total = total * half // shards
        rng = np.random.default_rng([SEED, first, shards])
        left = np.zeros_like(counts)
        need, rest = left_total, total
        for i, n in enumerate(counts.tolist()):  # one source after the other, each given the draws before it
            rest -= n
            if need and n:
                left[i] = drawn(rng, n, rest, need)
                need -= int(left[i])
        stack.append((first + half, shards - half, counts - left, ahead + left, levels - 1))
        stack.append((first, half, left, ahead, levels - 1))


def shard_quotas(totals: DataFrame, shards: int) -> DataFrame:
    """number (of a source), shard, ahead, count: the draws [ahead, ahead + count) of a source that a shard owns.

    totals: number, draws. A group holds one row for each source; each step splits LEVELS levels of the tree.
    """

    def grow(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("number", ignore_index=True)
        out = []
        for first, n, counts, ahead in split(
                frame["count"].to_numpy(np.int64), int(frame["shards"].iloc[0]), int(frame["shard"].iloc[0]), LEVELS):
            some = counts > 0
            out.append(pd.DataFrame({"number": frame["number"][some], "shard": first, "shards": n,
                                     "ahead": frame["ahead"][some] + ahead[some], "count": counts[some]}))
        return pd.concat(out)[["number", "shard", "shards", "ahead", "count"]]

    node = totals.select("number", F.lit(0).cast("long").alias("shard"), F.lit(shards).cast("long").alias("shards"),
                         F.lit(0).cast("long").alias("ahead"), F.col("draws").alias("count"))
    while shards > 1:
        node = node.groupBy("shard").applyInPandas(grow, "number long, shard long, shards long, ahead long, count long")
        shards = -(-shards // (1 << LEVELS))
    return node.select("number", "shard", "ahead", "count")


# ---------------------------------------------------------------- the mix


def hashed_rows(docs: DataFrame, key: str) -> DataFrame:
    """row (its key), doc_id, source, size and order (a hash of doc_id, text, source and the number among equal rows).

    Equal rows are numbered file by file, so that no task holds more than a file's.
    """
    content = F.xxhash64(F.col("doc_id").isNull(), F.coalesce("text", F.lit("")), F.col("text").isNull(), "source")
    rows = store(docs.select(
        F.col(key).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "source",
        word_count(F.col("text")).alias("size"), content.alias("content")), "sizes")
    equal = [F.coalesce("doc_id", F.lit(-1)).alias("id"), F.col("content")]
    many = rows.groupBy(*equal).agg(F.count("*").alias("n")).where("n > 1").select("id", "content")
    again = rows.select(*equal, "row").join(many, ["id", "content"])
    in_file = Window.partitionBy("id", "content", "row.file").orderBy("row.row")
    before = Window.partitionBy("id", "content").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = again.groupBy("id", "content", F.col("row.file").alias("file")).agg(F.count("*").alias("n"))
    ahead = files.select("id", "content", "file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    numbers = (again.withColumn("at", F.row_number().over(in_file) - 1).withColumn("file", F.col("row.file"))
               .join(ahead, ["id", "content", "file"]).select("row", (F.col("at") + F.col("ahead")).alias("number")))
    plain = unit_hash(SEED, F.coalesce("doc_id", F.lit(-1)), F.col("content"))
    repeat = unit_hash(SEED, F.coalesce("doc_id", F.lit(-1)), F.col("content"), F.col("number"))
    order = F.when(F.coalesce("number", F.lit(0)) == 0, plain).otherwise(repeat)
    return store(rows.join(numbers, "row", "left").select("row", "doc_id", "source", "size", order.alias("order")), "ordered")


def mix(docs: DataFrame, key: str, shard_words: int = SHARD_WORDS) -> tuple[DataFrame, DataFrame]:
    """The mix and the account of it; `key` is the column of docs that names its rows (see row_keyed).

    Mix: every taken copy as (row, copy, shard, place), place a hash that orders the shard. Account: row, doc_id, size,
    source, source_size, target, copies for every row of docs.
    """
    spark = docs.sparkSession
    ready(spark)
    sized = hashed_rows(docs, key)
    numbered = source_targets(sized).withColumn(
        "number", F.row_number().over(Window.orderBy(*map(F.expr, _SOURCES))).cast("long"))
    targets = store(numbered, "targets").withColumn("blocks", _blocks(F.col("source_size"), F.col("n_docs")))

    right = targets.withColumnRenamed("source", "s")
    joined = sized.join(right, sized["source"].eqNullSafe(right["s"])).drop("s")
    dealt = joined.withColumn("block", F.pmod("order", "blocks"))
    plan = store(block_plan(dealt, targets).join(
        targets.select(F.col("source").alias("s"), "number"), F.col("source").eqNullSafe(F.col("s"))).drop("s"), "blocks")

    # the block at the end of a source's last pass, one at most: its documents are chosen one by one
    ends = plan.where("part > 0 and part < words").select("number", "block", "part")
    chosen = (dealt.join(ends, ["number", "block"]).select(
        F.col("row.file").alias("file"), F.col("row.row").alias("at"), "doc_id", "size", "order", "part", "number")
              .groupBy("number").applyInPandas(cut_block, "file long, at long, extra long")
              .select(F.struct(F.col("file"), F.col("at").alias("row")).alias("row"), "extra"))

    # draws of a source in permuted order: every pass in turn, and a last one with the blocks that are taken in part
    counts = plan.select("number", "block", "rank", "passes", (F.col("part") > 0).cast("long").alias("more"))
    sums = counts.groupBy("number").agg(F.count("*").alias("n_blocks"), F.sum(F.col("passes") + F.col("more")).alias("draws"))
    total = F.coalesce(F.sum("words_taken"), F.lit(0))
    words = plan.select((F.col("passes") * F.col("words") + F.col("part")).alias("words_taken")).agg(total).first()[0]
    quotas = shard_quotas(sums.where("draws > 0").select("number", "draws"), max(1, -(-int(words) // shard_words)))
    draws = (counts.join(sums.select("number", "n_blocks"), "number")
             .withColumn("copy", F.explode(F.when(F.col("passes") + F.col("more") > 0, F.sequence(
                 F.lit(1), F.col("passes") + F.col("more"))).otherwise(F.array().cast("array<bigint>"))))
             .select("number", "block", "copy", ((F.col("copy") - 1) * F.col("n_blocks") + F.col("rank")).alias("draw")))
    owned = quotas.select("number", "shard", F.explode(F.sequence("ahead", F.col("ahead") + F.col("count") - 1)).alias("draw"))
    homes = store(draws.join(owned, ["number", "draw"]).groupBy("number", "block").agg(
        F.collect_list(F.struct("copy", "shard")).alias("homes")), "draws")

    whole = dealt.join(plan.select("number", "block", "passes", "part", "words"), ["number", "block"])
    extra = F.when(F.col("part") == F.col("words"), (F.col("part") > 0).cast("long")).otherwise(F.coalesce("extra", F.lit(0)))
    account = store(whole.join(store(chosen, "ends"), "row", "left").select(
        "row", "doc_id", "size", "source", "source_size", "target", "number", "block", "order",
        F.when(F.col("size") > 0, F.col("passes") + extra).otherwise(F.lit(0)).alias("copies")), "account")
    copies = account.where("copies > 0").join(homes, ["number", "block"]).select(
        "row", "order", "copies", F.explode("homes").alias("home")).where("home.copy <= copies")
    taken = copies.select("row", F.col("home.copy").alias("copy"), F.col("home.shard").alias("shard"),
                          unit_hash(SEED + 1, F.col("home.shard"), F.col("home.copy"), F.col("order")).alias("place"))
    return taken, account


def op3_hypergeometric_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken, account = mix(*row_keyed(table(spark, sf_dir, "documents")))
    times = taken.groupBy("row").agg(F.count("*").alias("times"), F.sort_array(F.collect_list("shard")).alias("shards"))
    return account.join(times, "row", "left").select(
        "doc_id", "size", "source_size", "target",
        (F.col("size") * F.coalesce("times", F.lit(0))).cast("long").alias("taken"),
        F.coalesce("shards", F.array().cast("array<bigint>")).alias("shards"))
