"""Term weights, cosine similarity and nearest neighbours, all as relational jobs."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aislerank.functions import text
from aislerank.functions.numbers import rounded
from aislerank.operators import nearest as index
from aislerank.operators.skew import salted_join
from aislerank.session import cut, passing, ship_package, stored
from aislerank.settings import TextModel

SCORE_DIGITS = index.SCORE_DIGITS
# Vectors per block: two dense blocks and their product stay around 200 MB at 5000 terms.
BLOCK = 2048
# A block that travels holds so many of them at most, and is worked through in parts of that size.
BLOCKS = 8
# Bands of random hyperplanes in one shuffle.
BANDS = 3
# Documents whose words a Python worker holds at once.
ROWS = 256


def terms(df: DataFrame, id_column: str = "product_id", text_column: str = "combined_text_tfidf",
          model: TextModel = TextModel(), stops: Sequence[str] | None = None) -> DataFrame:
    """(id, terms): words of two or more characters and, after stop words, adjacent pairs."""
    stops = text.english_stops() if stops is None else stops
    words = df.select(F.col(id_column).alias("id"), text.words(F.col(text_column)).alias("terms"))
    words = words.withColumn("terms", text.without(F.col("terms"), stops))
    return words.withColumn("terms", text.with_bigrams(F.col("terms"))) if model.bigrams else words


def vocabulary(docs: DataFrame, model: TextModel = TextModel()) -> DataFrame:
    """(t, term, df, tf, idf), at most ``max_features`` rows, so it may always be broadcast.

    Document and corpus frequency come from one pass and one shuffle: every document emits its
    distinct terms with df 1 and all its terms with tf 1, and both sums combine map-side.
    """
    one, zero = F.lit(1), F.lit(0)
    marked = F.concat(
        F.transform(F.array_distinct("terms"), lambda w: F.struct(w.alias("term"), one.alias("d"), zero.alias("c"))),
        F.transform("terms", lambda w: F.struct(w.alias("term"), zero.alias("d"), one.alias("c"))))
    n = docs.agg(F.count("*").alias("n")).scalar()
    kept = (
        docs.select(F.inline_outer(marked)).filter("term IS NOT NULL").groupBy("term")
        .agg(F.sum("d").alias("df"), F.sum("c").alias("tf"))
        .withColumn("n", n)
        .filter((F.col("df") >= model.min_df) & (F.col("df") <= F.col("n") * model.max_df))
        .orderBy(F.desc("tf"), "term").limit(model.max_features)
    )
    # The window sees max_features rows at most.
    return kept.select(
        F.row_number().over(Window.orderBy(F.desc("tf"), "term")).alias("t"), "term", "df", "tf",
        (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))


def vectors(docs: DataFrame, vocab: DataFrame) -> DataFrame:
    """(id, vec): unit vectors as arrays of (t, w) sorted by t; documents without a term drop out.

    A document is one row, so its terms are counted and looked up there, in the broadcast vocabulary
    (``max_features`` rows at most), and nothing is shuffled.
    """
    spark = docs.sparkSession
    known = {r["term"]: (r["t"], r["idf"]) for r in vocab.select("t", "term", "idf").collect()}
    shared = spark.sparkContext.broadcast(known)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            ids, ts, ws = [], [], []
            for at, words in enumerate(batch.column("terms").to_pylist()):
                found = sorted((*known[w], n) for w, n in Counter(words or ()).items() if w in known)
                if found:
                    t, idf, n = (np.array(c) for c in zip(*found))
                    w = (1 + np.log(n)) * idf
                    ids.append(at)
                    ts.append(t)
                    ws.append(np.round(w / np.sqrt((w * w).sum()), 12))
            entries = pa.StructArray.from_arrays(
                [pa.array(np.concatenate([*ts, np.zeros(0)]).astype(np.int32)), pa.array(np.concatenate([*ws, np.zeros(0)]))], names=["t", "w"])
            ends = np.cumsum([0, *map(len, ts)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(ids, pa.int64())), pa.ListArray.from_arrays(pa.array(ends), entries)], names=["id", "vec"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", "terms").mapInArrow(weigh, f"id {kind}, vec array<struct<t:int,w:double>>")


def weights(vecs: DataFrame) -> DataFrame:
    """The long form (id, t, w)."""
    return vecs.select("id", F.explode("vec").alias("e")).select("id", "e.t", "e.w")


def fit(df: DataFrame, id_column: str = "product_id", text_column: str = "combined_text_tfidf",
        model: TextModel = TextModel(), stops: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(vocabulary, vectors), both written once to the checkpoint folder.  The words that both read are written as well,
    without the pairs, until the vectors are there."""
    with passing(terms(df, id_column, text_column, replace(model, bigrams=False), stops)) as words:
        docs = words.withColumn("terms", text.with_bigrams(F.col("terms"))) if model.bigrams else words
        vocab = cut(vocabulary(docs, model))
        return vocab, stored(vectors(docs, vocab))


def collapse(vecs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(distinct, members): one row per distinct vector, and which id has which.

    A text that a third of the catalogue shares is one vector here; its ids come back at the end.
    """
    # Two 64-bit hashes under different seeds, together 128 bits.
    keyed = vecs.withColumn("digest", F.concat_ws("-", F.hex(F.xxhash64(F.lit(1), "vec")), F.hex(F.xxhash64(F.lit(2), "vec"))))
    distinct = keyed.groupBy("digest").agg(F.min("id").alias("rep"), F.first("vec").alias("vec"))
    members = salted_join(keyed.select("digest", "id"), distinct.select("digest", "rep"), "digest").select("rep", "id")
    return distinct.select(F.col("rep").alias("id"), "vec"), members


def _dominant(vec: str) -> Column:
    return F.sort_array(F.transform(vec, lambda e: F.struct((-e["w"]).alias("w"), e["t"].alias("t"))))[0]["t"]


def in_blocks(vecs: DataFrame, size: int = BLOCK) -> DataFrame:
    """Adds ``block``: about ``size`` vectors each, vectors of one dominant term side by side.

    The terms' shares of the number line come from one row per term of the bounded vocabulary.
    """
    led = vecs.withColumn("lead", _dominant("vec"))
    shares = led.groupBy("lead").agg(F.count("*").alias("n"))
    before = Window.orderBy("lead").rowsBetween(Window.unboundedPreceding, -1)
    shares = shares.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
    place = F.col("start") + F.pmod(F.xxhash64("id"), F.col("n"))
    return led.join(F.broadcast(shares), "lead").withColumn(
        "block", F.floor(place / size).cast("int")).select("id", "vec", "block")


def block_bounds(left: DataFrame, right: DataFrame) -> DataFrame:
    """(a, b, bound): the pairs of blocks that share a term, and the most any two of their vectors can
    score: the sum over the terms of the product of both blocks' largest weights."""
    def peaks(blocks: DataFrame, name: str, weight: str) -> DataFrame:
        return blocks.select(F.col("block").alias(name), F.explode("vec").alias("e")).groupBy(
            name, F.col("e.t").alias("t")).agg(F.max("e.w").alias(weight))

    met = salted_join(cut(peaks(left, "a", "p")), peaks(right, "b", "q"), "t")
    return met.groupBy("a", "b").agg(F.sum(F.col("p") * F.col("q")).alias("bound"))


def matrix(pdf: pd.DataFrame, columns: np.ndarray) -> np.ndarray:
    """Dense rows over the sorted term numbers ``columns``; other terms are left out."""
    rows = np.repeat(np.arange(len(pdf)), pdf["t"].map(len))
    terms, values = np.concatenate(pdf["t"].to_list()), np.concatenate(pdf["w"].to_list())
    at = np.minimum(np.searchsorted(columns, terms), len(columns) - 1)
    known = columns[at] == terms
    dense = np.zeros((len(pdf), len(columns)))
    dense[rows[known], at[known]] = values[known]
    return dense


def _products(left: pd.DataFrame, right: pd.DataFrame) -> np.ndarray:
    """Scores of two blocks of sparse vectors, over the terms of the right block."""
    columns = np.unique(np.concatenate(right["t"].to_list()))
    return np.round(matrix(left, columns) @ matrix(right, columns).T, SCORE_DIGITS)


def _visit(pairs: DataFrame, sources: DataFrame, blocks: DataFrame, kernel, schema: str,
           carried: Sequence[str] = ()) -> DataFrame:
    """Run ``kernel`` on every pair (a, b) of a block of sources and a block of candidates."""
    ship_package(sources.sparkSession)
    flat = lambda: (F.col("vec.t").alias("t"), F.col("vec.w").alias("w"))
    pairs = pairs.select("a", "b")
    left = pairs.join(sources.withColumnRenamed("block", "a"), "a").select("a", "b", F.col("id").alias("src"), *flat())
    right = pairs.join(blocks.withColumnRenamed("block", "b"), "b").select(
        F.col("a").alias("at"), F.col("b").alias("part"), "id", *carried, *flat())

    def task(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({c.split()[0]: [] for c in schema.split(", ")})
        return kernel(a, b)

    return left.groupBy("a", "b").cogroup(right.groupBy("at", "part")).applyInPandas(task, schema)


def nearest(sources: DataFrame, candidates: DataFrame, k: int | Column, size: int = BLOCK) -> DataFrame:
    """(src, dst, score, rank): the k best positive cosines per source, exact, ties by id.

    ``k`` may be a column of the sources, so that each has its own reach.  Both sides are read several times.
    """
    if isinstance(k, Column):
        asked = sources.select("id", "vec", k.alias("k"))
        found = index.scored(asked, candidates, size).join(asked.select(F.col("id").alias("src"), "k"), "src")
        order = Window.partitionBy("src").orderBy(F.desc("score"), F.asc("dst"))
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= F.col("k")).drop("k")
    return best_per(index.scored(sources.withColumn("k", F.lit(k)), candidates, size), "src", "score", "dst", k)


def best_per(df: DataFrame, key: str, score: str, tie: str, k: int) -> DataFrame:
    """The k best rows per key.  ``rank <= k`` becomes a group limit ahead of the shuffle."""
    order = Window.partitionBy(key).orderBy(F.desc(score), F.asc(tie))
    return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def neighbours(vecs: DataFrame, k: int, min_score: float = 0.0, size: int = BLOCK) -> DataFrame:
    """(src, dst, score, rank): the k nearest other documents of every document, score > 0, exact.

    Works on distinct vectors.  Of the ids that share a vector only the first k + 1 can enter any
    list, because they tie and ties go by id; so every vector carries that short list, and each
    document reads the list of its own vector.
    """
    distinct, members = (stored(df) for df in collapse(vecs))
    # k + 1 distinct vectors hold at least k other documents.
    return _of_members(nearest(distinct, distinct, k + 1, size).filter(F.col("score") >= min_score), members, k)


def _of_members(near: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """From (src, dst, score) of distinct vectors, each one's own included, to the k nearest of every document."""
    first_ids = (
        members.withColumn("n", F.row_number().over(Window.partitionBy("rep").orderBy("id")))
        .filter(F.col("n") <= k + 1)
        .groupBy("rep").agg(F.sort_array(F.collect_list("id")).alias("ids")))
    wide = near.join(first_ids, near.dst == first_ids.rep).select(
        F.col("src").alias("rep"), F.explode("ids").alias("dst"), "score")
    lists = best_per(wide, "rep", "score", "dst", k + 1).groupBy("rep").agg(
        F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("dst").alias("id")))).alias("list"))
    own = F.slice(F.filter("list", lambda e: e["id"] != F.col("id")), 1, k)
    return (
        salted_join(members, lists, "rep")
        .select(F.col("id").alias("src"), F.posexplode(own).alias("p", "e"))
        .select("src", F.col("e.id").alias("dst"), (-F.col("e.s")).alias("score"), (F.col("p") + 1).alias("rank")))


def plane_keys(vecs: DataFrame, bits: int, bands: int, seed: int) -> DataFrame:
    """(id, t, w, keys): for each band, on which sides of its ``bits`` random hyperplanes a vector lies.

    The planes follow from the seed and the largest term, so every task makes the same ones; they are as
    large as the vocabulary times ``bits * bands``.
    """
    if not 0 < bits <= 62:
        raise ValueError("a key holds 1 to 62 bits")
    top = vecs.agg(F.coalesce(F.max(F.try_element_at("vec", F.lit(-1))["t"]), F.lit(0))).first()[0]

    def sides(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = np.random.default_rng(seed).standard_normal((top + 1, bits * bands), np.float32)
        power = 1 << np.arange(bits, dtype=np.int64)
        for batch in batches:
            keys = [
                ((w.values.to_numpy(zero_copy_only=False) @ planes[t.values.to_numpy(zero_copy_only=False)] > 0)
                 .reshape(bands, bits) @ power) for t, w in zip(batch.column("t"), batch.column("w"))]
            flat = np.concatenate([*keys, np.zeros(0, np.int64)]).astype(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * bands), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=["id", "t", "w", "keys"])

    flat = vecs.where(F.size("vec") > 0).select(
        F.col("id").cast("string").alias("id"), F.col("vec.t").cast("array<int>").alias("t"), F.col("vec.w").alias("w"))
    return flat.mapInArrow(sides, "id string, t array<int>, w array<double>, keys array<long>")


def approximate_neighbours(vecs: DataFrame, k: int, bits: int = 8, bands: int = 16, seed: int = 7,
                           size: int = BLOCK) -> DataFrame:
    """(src, dst, score, rank): ``neighbours`` among the vectors that share a band of random hyperplanes.

    Scores are exact, partners may be missing: two vectors at an angle a share a band of b bits with probability
    (1 - a / pi)^b.  With the given bits and bands nine of ten partners at a cosine of 0.8 are found,
    and nearly all above 0.9.  Never chosen by itself; for lists of far neighbours use ``neighbours``.
    Each vector travels once for each band, a few bands at a time, and the shuffle files of one time are gone
    before the next.  A key that very many vectors share is cut into parts of about ``size`` times BLOCKS, every two of
    which meet.
    """
    ship_package(vecs.sparkSession)
    distinct, members = (stored(df) for df in collapse(vecs))
    keyed = stored(plane_keys(distinct, bits, bands, seed))
    itself = distinct.where(F.size("vec") > 0).select(
        F.col("id").cast("string").alias("src"), F.col("id").cast("string").alias("dst"), F.lit(1.0).alias("score"))
    near = itself
    for first in range(0, bands, BANDS):
        met = _in_bands(keyed, range(first, min(first + BANDS, bands)), k, size * BLOCKS)
        both = near.unionByName(met).groupBy("src", "dst").agg(F.max("score").alias("score"))
        near = stored(best_per(both, "src", "score", "dst", k + 1).drop("rank"))
    return _of_members(near, members, k)


def _in_bands(keyed: DataFrame, bands: range, k: int, size: int) -> DataFrame:
    """(src, dst, score): the k + 1 best of every vector among those that share its key in one of these bands."""
    numbers = F.array(*[F.struct(F.lit(b).alias("band"), F.col("keys")[b].alias("key")) for b in bands])
    by_band = F.inline(numbers).alias("band", "key")
    parts = keyed.select(by_band).groupBy("band", "key").agg(F.count("*").alias("n")).filter("n > 1").select(
        "band", "key", F.ceil(F.col("n") / size).alias("parts"))
    own, other = F.pmod(F.xxhash64("id"), "parts"), F.col("other")
    dealt = (
        keyed.select("id", "t", "w", by_band).join(parts, ["band", "key"])
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        .select("band", "key", F.least(own, other).alias("p"), F.greatest(own, other).alias("q"), "id", "t", "w",
                F.lit(0.0).alias("low"), F.lit(k + 1).cast("long").alias("k")))

    def meet(rows: pa.Table) -> pa.Table:
        return index.best_of_piece(rows, rows)

    return dealt.groupBy("band", "key", "p", "q").applyInArrow(meet, index.SCORED).filter("src <> dst")


def top_terms(vecs: DataFrame, vocab: DataFrame, documents: DataFrame, limit: int = 30) -> DataFrame:
    """Terms by mean weight over all documents, the empty ones included."""
    n = documents.agg(F.count("*").alias("n")).scalar()
    return (
        weights(vecs).groupBy("t").agg(F.sum("w").alias("total"))
        .join(F.broadcast(vocab), "t")
        .select("term", rounded(F.col("total") / n, 6).alias("importance"), rounded(F.col("idf"), 4).alias("idf"))
        .orderBy(F.desc("importance"), "term").limit(limit))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda s, e: s + e)


def _tally(bins: int, floor: float, size: int = BLOCK):
    """Per source: pairs, sum, best and histogram of the positive scores, counted with copies.  A block is worked
    through in parts of ``size``."""

    def kernel(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return pd.concat([part(left[a : a + size], right[b : b + size])
                          for a in range(0, len(left), size) for b in range(0, len(right), size)])

    def part(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        scores = _products(left, right)
        own = left["src"].to_numpy()[:, None] == right["id"].to_numpy()[None, :]
        # A vector meets its own copies with score 1, itself excepted.
        copies = right["copies"].to_numpy()[None, :] - own
        scores = np.where(own, 1.0, scores)
        weight = np.where(scores > 0, copies, 0)
        bin_of = np.minimum((scores * bins).astype(int), bins - 1)
        shown = np.where(scores > floor, weight, 0)
        best = np.where(weight > 0, scores, 0.0).max(axis=1)
        counts = [(shown * (bin_of == i)).sum(axis=1) for i in range(bins)]
        return pd.DataFrame({
            "src": left["src"], "partners": weight.sum(axis=1), "total": (weight * scores).sum(axis=1),
            "best": best, "bins": list(np.stack(counts, axis=1))})

    return kernel


def similarity_profile(vecs: DataFrame, bins: int = 10, floor: float = 0.01, size: int = BLOCK) -> DataFrame:
    """(rep, copies, partners, total, best, bins) per distinct vector: how many other documents it
    has a positive cosine with, their sum, the best and a histogram.  Nothing is sampled."""
    distinct, members = collapse(vecs)
    copies = members.groupBy("rep").agg(F.count("*").alias("copies"))
    distinct = stored(distinct)
    # A vector travels once for each block it meets: large blocks, while there is a pair of them for every core.
    most = distinct.count() / (4 * vecs.sparkSession.sparkContext.defaultParallelism) ** 0.5
    blocks = stored(in_blocks(distinct, int(min(max(most, size), BLOCKS * size))).join(copies.withColumnRenamed("rep", "id"), "id"))
    pairs = block_bounds(blocks, blocks)
    schema = "src string, partners long, total double, best double, bins array<long>"
    seen = _visit(pairs, blocks, blocks, _tally(bins, floor, size), schema, ("copies",))
    tallied = seen.groupBy("src").agg(
        F.sum("partners").alias("partners"), F.sum("total").alias("total"), F.max("best").alias("best"),
        F.array(*[F.sum(F.col("bins")[i]) for i in range(bins)]).alias("bins"))
    return tallied.withColumnRenamed("src", "rep").join(copies, "rep")


def similarity_per_document(vecs: DataFrame) -> DataFrame:
    """(src, partners, total, best) for every document with a partner."""
    _, members = collapse(vecs)
    return members.join(similarity_profile(vecs), "rep").filter("partners > 0").select(
        F.col("id").alias("src"), "partners", "total", "best")


def average_similarity(vecs: DataFrame) -> DataFrame:
    """One row: ordered pairs with positive similarity and their mean."""
    return similarity_profile(vecs).agg(
        F.sum(F.col("partners") * F.col("copies")).alias("positive_pairs"),
        rounded(F.sum(F.col("total") * F.col("copies")) / F.sum(F.col("partners") * F.col("copies")), 6)
        .alias("avg_similarity"))


def similarity_histogram(vecs: DataFrame, bins: int = 10, floor: float = 0.01) -> DataFrame:
    """(bin, pairs) over all ordered pairs above the floor."""
    profile = similarity_profile(vecs, bins, floor)
    return profile.select("copies", F.posexplode("bins").alias("bin", "n")).groupBy(
        F.col("bin").cast("bigint").alias("bin")).agg(F.sum(F.col("n") * F.col("copies")).alias("pairs")).filter("pairs > 0")


def dense_ranking(users: DataFrame, items: DataFrame, user: str, item: str, k: int, size: int = BLOCK) -> DataFrame:
    """The k best items per user by cosine of dense vectors.

    Both sides lie in blocks of about ``size`` rows.  A task multiplies a block of users with a block
    of items and puts out k rows per user, so no table of pairs exists, however many users there are.
    """
    unit = lambda v: F.transform(v, lambda x: x / F.sqrt(dot(v, v)))
    parts, counts = [], []
    for df, key in ((users, user), (items, item)):
        rows = cut(df.select(F.col(key).alias("id"), unit(F.col("vector")).alias("x")))
        counts.append(max(1, -(-rows.count() // size)))
        parts.append(rows.withColumn("at", F.pmod(F.xxhash64("id"), F.lit(counts[-1]))))
    numbers = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))
    left = parts[0].withColumnRenamed("at", "p").withColumn("q", numbers(counts[1]))
    right = parts[1].withColumnRenamed("at", "q").withColumn("p", numbers(counts[0]))
    kinds = [dict(df.dtypes)[key] for df, key in ((users, user), (items, item))]

    def task(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({user: [], item: [], "score": []})
        b = b.sort_values("id").reset_index(drop=True)
        scores = np.round(np.stack(a["x"]) @ np.stack(b["x"]).T, SCORE_DIGITS)
        best = np.argsort(-scores, axis=1, kind="stable")[:, :k]
        return pd.DataFrame({
            user: np.repeat(a["id"].to_numpy(), best.shape[1]), item: b["id"].to_numpy()[best].ravel(),
            "score": np.take_along_axis(scores, best, axis=1).ravel()})

    scored = left.groupBy("p", "q").cogroup(right.groupBy("p", "q")).applyInPandas(
        task, f"{user} {kinds[0]}, {item} {kinds[1]}, score double")
    return best_per(scored, user, "score", item, k)
