"""Toxicity scores: logistic regression by FTRL-proximal over hashed word n-grams and skip-grams.

A document is the set of its hashed words, word pairs and pairs with one word skipped. FTRL-proximal gives every
coordinate its own rate and an L1 pull that leaves most weights at zero, so the model is a short list of weights: at
most 2^BITS of them, which bounds the broadcast.

Labels are learned from at most `SAMPLE` documents, those with the lowest hash of their id, in that order. Texts are read
whole. A null or empty text has no features and gets the score of the intercept. If there are no labels the model is the
intercept 0 alone and every score is 0.5. Null labels and labels other than 0 and 1 are left out. An empty table gives no
rows, repeated rows one each; other columns are not read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aislerank.llm.common import ready, remainder, store, table, unit_hash

BITS = 20
SAMPLE = 16_000
THRESHOLD = 0.7
_WORD = re.compile(r"[^\W_]+")
_KEEP = 150_000


@dataclass(frozen=True)
class Settings:
    alpha: float = 4.0
    beta: float = 1.0
    l1: float = 5.0
    l2: float = 0.1
    passes: int = 6


class Hasher(dict):
    """Word to hash; at most _KEEP words are kept, others are hashed each time."""

    def __missing__(self, word: str) -> int:
        value = zlib.crc32(word.encode("utf-8", "surrogatepass"))
        if len(self) < _KEEP:
            self[word] = value
        return value


_HASHER = Hasher()


def gram_hashes(text: str | None) -> np.ndarray:
    """Hashes of every word, word pair and pair over one word, repeats included."""
    words = _WORD.findall((text or "").lower())
    h = np.fromiter(map(_HASHER.__getitem__, words), np.uint64, len(words))
    shift = np.uint64(64 - BITS)
    odd, prime = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
    one = (h + np.uint64(1)) * odd >> shift
    pairs = (h[:-1] * odd ^ (h[1:] + np.uint64(0x165667B1))) * prime >> shift
    skips = (h[:-2] * odd ^ (h[2:] + np.uint64(0x27D4EB2F))) * prime >> shift
    return np.concatenate([one, pairs, skips]).astype(np.int64)


def train(rows: list[np.ndarray], labels: np.ndarray, settings: Settings = Settings()) -> tuple[np.ndarray, np.ndarray, float]:
    """Indices and values of the weights that are not zero, and the intercept (which has no L1 pull)."""
    size = 1 << BITS
    z, n = np.zeros(size), np.zeros(size)
    z0 = n0 = 0.0
    s = settings

    def weights(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        pull = np.maximum(np.abs(zi) - s.l1, 0.0)
        return -np.sign(zi) * pull / ((s.beta + np.sqrt(ni)) / s.alpha + s.l2)

    for _ in range(s.passes if len(rows) else 0):
        for at, y in zip(rows, labels):
            zi, ni = z[at], n[at]
            w = weights(zi, ni)
            w0 = -z0 / ((s.beta + math.sqrt(n0)) / s.alpha)
            g = 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, float(w.sum()) + w0)))) - y
            z[at] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / s.alpha * w
            n[at] = ni + g * g
            z0 += g - (math.sqrt(n0 + g * g) - math.sqrt(n0)) / s.alpha * w0
            n0 += g * g
    w = weights(z, n)
    index = np.flatnonzero(w)
    return index, w[index], -z0 / ((s.beta + math.sqrt(n0)) / s.alpha) if n0 else 0.0


def sample(docs: DataFrame, labels: DataFrame, learn, most: int = SAMPLE) -> DataFrame:
    """doc_id, text and toxic of at most `most` labelled documents; `learn` says which may be used.

    An id that several rows bear gives one of them, so that `most` bounds rows.
    """
    known = (labels.where(F.col("toxic").isin(0, 1)).where(learn).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
             .orderBy(unit_hash(8, F.col("doc_id")), "doc_id").limit(most))
    texts = docs.select("doc_id", F.struct(F.xxhash64("text").alias("by"), "text").alias("row"))
    one = texts.join(F.broadcast(known), "doc_id").groupBy("doc_id", "toxic").agg(F.min("row").alias("row"))
    return one.select("doc_id", "row.text", "toxic")


def fit(training: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Weights as rows (index, weight), index -1 for the intercept. `training`: a bounded sample of doc_id, text, toxic."""
    ready(training.sparkSession)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(gram_hashes(t.as_py())).astype(np.int32) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sets, pa.list_(pa.int32())), batch.column(2)], names=["rank", "grams", "toxic"])

    def learn(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["rank"], kind="stable")
        index, values, intercept = train(list(frame["grams"]), frame["toxic"].to_numpy(float), settings)
        return pd.DataFrame({"index": np.append(index, -1), "weight": np.append(values, intercept)})

    rows = training.select(unit_hash(8, F.col("doc_id")).alias("rank"), "text", F.col("toxic").cast("int")).mapInArrow(
        features, "rank long, grams array<int>, toxic int")
    return rows.groupBy().applyInPandas(learn, "index long, weight double")


def scores(docs: DataFrame, weights: DataFrame, keep: list[str], name: str = "score") -> DataFrame:
    """The columns `keep` and the score of every row of docs. The model's rows (2^BITS at most) are broadcast."""
    spark = docs.sparkSession
    ready(spark)
    model = weights.where("index >= 0").limit(1 << BITS).toPandas()
    start = weights.where("index = -1").agg(F.coalesce(F.max("weight"), F.lit(0.0))).first()[0]
    shared = spark.sparkContext.broadcast((model["index"].to_numpy(np.int64), model["weight"].to_numpy(float), start))
    columns = [*keep, "text"] if "text" not in keep else keep
    place = columns.index("text")
    schema = docs.select(*keep).schema.add(name, "double")

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, values, intercept = shared.value
        dense = np.zeros(1 << BITS)
        dense[index] = values
        for batch in batches:
            out = np.empty(batch.num_rows)
            for i, text in enumerate(batch.column(place)):
                grams = gram_hashes(text.as_py())
                hit = np.unique(grams[dense[grams] != 0])
                out[i] = intercept + dense[hit].sum()
            done = 1.0 / (1.0 + np.exp(-np.clip(out, -500, 500)))
            arrays = [batch.column(columns.index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(done)], names=[*keep, name])

    return docs.select(*columns).mapInArrow(rate, schema)


def model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weights learned from the labelled documents of a data set that are not held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return store(fit(sample(docs, labels, remainder(F.col("doc_id"), 3) != 1)), "toxicity-weights")


def op8_ftrl_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents"), model(spark, sf_dir), ["doc_id"]).select(
        "doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
