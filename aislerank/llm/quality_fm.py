"""Quality scores: a factorisation machine over hashed words, structure statistics and metadata.

A document's features are its distinct words, hashed, with the length 1 as a vector; for every structure statistic of the
text the step it falls on; and the step of its stored length n_chars with whether that is missing. Beside a weight each
feature has RANK factors, and the product of two features' factors is the weight of their pair. All pairs of a document
are summed in time linear in its features, as half of (sum of v x)^2 - sum of (v x)^2 over the factors.

Labels are learned by AdaGrad from at most `SAMPLE` documents, those with the lowest hash of their id, one row for each id.
The model has 2^BITS features at most, which bounds the broadcast. Texts are read whole. A null text counts as an empty
one, which has no words and the lowest step of every statistic. Without labels the model is empty and every score is 0.5.
Null labels and labels other than 0 and 1 are left out. An empty table gives no rows, repeated rows one each; columns
beside doc_id, text and n_chars are not read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aislerank.llm.common import ready, remainder, store, table, unit_hash

BITS = 16
RANK = 8
STEPS = 16
SAMPLE = 16_000
THRESHOLD = 0.5
_WORD = re.compile(r"[^\W_]+")
_KEEP = 150_000

#: Characters that text marks up or lists with, and those that end a sentence.
_SYMBOLS = re.compile(r"[#*$%&|<>{}\[\]=~^\\@+]")
_ENDS = (".", "!", "?", ":", ";", "\"", "…")


@dataclass(frozen=True)
class Settings:
    rate: float = 0.1
    l2: float = 1e-4
    spread: float = 0.05  # of the factors at the start
    passes: int = 6
    seed: int = 12


class Hasher(dict):
    """Word to feature; at most _KEEP words are kept, others are hashed each time."""

    def __missing__(self, word: str) -> int:
        value = zlib.crc32(word.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1)
        if len(self) < _KEEP:
            self[word] = value
        return value


_HASHER = Hasher()


def _step(share: float) -> int:
    """Step of a share: finer near 0, where most shares lie."""
    return min(STEPS - 1, int(STEPS * math.sqrt(max(0.0, min(1.0, share)))))


def _log_step(size: float) -> int:
    return min(STEPS - 1, int(math.log2(size + 1)))


def statistics(text: str, words: list[str], count: Counter, n_chars: int | None) -> list[int]:
    """Step of every structure statistic and of the metadata, in a fixed order."""
    n, size = len(words), max(1, len(text))
    lines = [line.strip() for line in text.split("\n")]
    lines = [line for line in lines if line]
    many = max(1, len(lines))
    letters = sum(map(len, words))
    pairs = Counter(zip(words, words[1:]))
    return [
        _log_step(n),
        _log_step(len(lines)),
        min(STEPS - 1, int(2 * letters / max(1, n))),  # mean length of a word
        _log_step(n / many),  # words of a line
        _step(len(_SYMBOLS.findall(text)) / size),
        _step(sum(map(text.count, "0123456789")) / size),
        _step(sum(map(str.isupper, text)) / size),
        _step(text.count("|") / size),
        _step(1 - len(set(lines)) / many if lines else 0.0),  # repeated lines
        _step(sum(line.endswith(_ENDS) for line in lines) / many),
        _step(len(count) / max(1, n)),  # distinct words
        _step(max(count.values(), default=0) / max(1, n)),
        _step(sum(c for p, c in pairs.items() if c > 1) / max(1, n - 1)),  # repeated word pairs
        _step(sum(c for w, c in count.items() if len(w) <= 3) / max(1, n)),
        STEPS - 1 if n_chars is None else _log_step(max(0, n_chars)),
    ]


STATISTICS = len(statistics("", [], Counter(), 0))
FEATURES = (1 << BITS) + STATISTICS * STEPS


def features(text: str | None, n_chars: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Features of a document and their values."""
    text = text or ""
    words = _WORD.findall(text.lower())
    count = Counter(words)
    hashed = np.unique(np.fromiter(map(_HASHER.__getitem__, count), np.int64, len(count)))
    steps = np.array(statistics(text, words, count, n_chars), np.int64) + (1 << BITS) + STEPS * np.arange(STATISTICS)
    value = np.concatenate([np.full(len(hashed), 1 / math.sqrt(len(hashed) or 1)), np.ones(STATISTICS)])
    return np.concatenate([hashed, steps]), value


# ---------------------------------------------------------------- model


@dataclass
class Machine:
    weights: np.ndarray  # of every feature
    factors: np.ndarray  # features x RANK
    start: float = 0.0

    def raw(self, index: np.ndarray, value: np.ndarray) -> tuple[float, np.ndarray]:
        """Score before the logistic curve, and the sum of v x by factor."""
        each = self.factors[index] * value[:, None]
        total = each.sum(axis=0)
        return self.start + float(self.weights[index] @ value) + 0.5 * float(total @ total - (each * each).sum()), total


def logistic(raw: float) -> float:
    return 1.0 / (1.0 + math.exp(-max(-500.0, min(500.0, raw))))


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, settings: Settings = Settings()) -> Machine:
    """One document after the other, `passes` times in a seeded order; AdaGrad gives every number its own rate."""
    s, rng = settings, np.random.default_rng(settings.seed)
    machine = Machine(np.zeros(FEATURES), rng.normal(0.0, s.spread, (FEATURES, RANK)))
    seen_w, seen_v, seen_0 = np.full(FEATURES, 1e-2), np.full((FEATURES, RANK), 1e-2), 1e-2
    for _ in range(s.passes if len(rows) else 0):
        for at in rng.permutation(len(rows)):
            index, x = rows[at]
            raw, total = machine.raw(index, x)
            error = logistic(raw) - labels[at]
            if abs(error) < 1e-4:
                continue
            v = machine.factors[index]
            by_weight = error * x + s.l2 * machine.weights[index]
            by_factor = error * x[:, None] * (total - v * x[:, None]) + s.l2 * v
            seen_w[index] += by_weight**2
            seen_v[index] += by_factor**2
            seen_0 += error**2
            machine.weights[index] -= s.rate * by_weight / np.sqrt(seen_w[index])
            machine.factors[index] = v - s.rate * by_factor / np.sqrt(seen_v[index])
            machine.start -= s.rate * error / math.sqrt(seen_0)
    return machine


def sample(docs: DataFrame, labels: DataFrame, learn, most: int = SAMPLE) -> DataFrame:
    """rank, text, n_chars and quality of at most `most` labelled documents; `learn` says which may be used.

    An id that several rows bear gives one of them, so that `most` bounds rows.
    """
    known = (labels.where(F.col("quality").isin(0, 1)).where(learn).groupBy("doc_id").agg(F.max("quality").alias("quality"))
             .withColumn("rank", unit_hash(12, F.col("doc_id"))).orderBy("rank", "doc_id").limit(most))
    texts = docs.select("doc_id", F.struct(F.xxhash64("text").alias("by"), "text", F.col("n_chars").cast("long").alias("n_chars")).alias("row"))
    one = texts.join(F.broadcast(known), "doc_id").groupBy("doc_id", "rank", "quality").agg(F.min("row").alias("row"))
    return one.select("rank", "row.text", "row.n_chars", F.col("quality").cast("int").alias("quality"))


def fit(training: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The machine as rows (index, weight, factors) of the features that were seen; index -1 is the start value.

    `training` is a bounded sample as `sample` gives it; its features are made where its texts are, and fitted in one task.
    """
    ready(training.sparkSession)

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [features(t.as_py(), n) for t, n in zip(batch.column(1), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(3), pa.array([i.astype(np.int32) for i, _ in made], pa.list_(pa.int32()))],
                names=["rank", "quality", "found"])

    def learn(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("rank", kind="stable")
        rows = []
        for found in frame["found"]:
            words = len(found) - STATISTICS
            rows.append((found.astype(np.int64), np.concatenate([np.full(words, 1 / math.sqrt(words or 1)), np.ones(STATISTICS)])))
        machine = train(rows, frame["quality"].to_numpy(float), settings)
        seen = np.unique(np.concatenate([i for i, _ in rows])) if rows else np.zeros(0, np.int64)
        return pd.DataFrame({
            "index": np.append(seen, -1), "weight": np.append(machine.weights[seen], machine.start),
            "factors": [*machine.factors[seen].tolist(), []]})

    rows = training.select("rank", "text", "n_chars", "quality").mapInArrow(
        prepare, "rank long, quality int, found array<int>")
    return rows.groupBy().applyInPandas(learn, "index long, weight double, factors array<double>")


def scores(docs: DataFrame, model: DataFrame, name: str = "score") -> DataFrame:
    """doc_id and the score of every row of docs. The model (FEATURES rows at most) is broadcast."""
    spark = docs.sparkSession
    ready(spark)
    frame = model.limit(FEATURES + 1).toPandas()
    some = frame["index"].to_numpy(np.int64) >= 0
    start = float(frame["weight"][~some].sum())
    index = frame["index"].to_numpy(np.int64)[some]
    shared = spark.sparkContext.broadcast((
        index, frame["weight"].to_numpy(float)[some],
        np.array(frame["factors"][some].tolist(), np.float32).reshape(-1, RANK), start))

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, weights, factors, start = shared.value
        machine = Machine(np.zeros(FEATURES), np.zeros((FEATURES, RANK), np.float32), start)  # unseen features weigh nothing
        machine.weights[index], machine.factors[index] = weights, factors
        for batch in batches:
            done = [logistic(machine.raw(*features(t.as_py(), n))[0])
                    for t, n in zip(batch.column(1), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(done, pa.float64())], names=["doc_id", name])

    return docs.select(F.col("doc_id").cast("long"), "text", F.col("n_chars").cast("long")).mapInArrow(
        rate, f"doc_id long, `{name}` double")


def model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The machine learned from the labelled documents of a data set that are not held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return store(fit(sample(docs, labels, remainder(F.col("doc_id"), 3) != 1)), "quality-machine")


def op12_factor_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents"), model(spark, sf_dir)).select(
        "doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
