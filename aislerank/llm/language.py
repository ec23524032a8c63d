"""Language identification in two steps: the family first, then one-versus-one linear SVMs inside it.

A text is the L2-normed vector of damped counts of its hashed character n-grams (1 to 4, word edges marked), over the
whole text. A linear one-versus-rest SVM names the language family. Inside a family every pair of languages has a linear
SVM of its own, and the language with most votes wins, ties by the sum of margins. Families are a parameter; a language
that is in none is a family of its own.

Models are fitted on at most PER_LANGUAGE documents of a language and SAMPLE in all, those with the lowest hash of their
id, one row for each id and language; every language gets a document before any gets the next. Pairs are trained apart, one
task each, families in FAMILY_TASKS tasks at most, each of which holds the sample. All languages of the sample are learned;
their number, and with it the broadcast of 2^BITS floats for each family and pair, is bounded by SAMPLE.

A null text, or one without a letter, is `und` with score 0. With no labelled document every text is. Repeated rows are
reported once each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from aislerank.llm.common import ready, remainder, store, table, unit_hash

BITS = 12
NGRAMS = (1, 2, 3, 4)
PER_LANGUAGE = 1000
SAMPLE = 8_000
FAMILY_TASKS = 64
UNKNOWN = "und"

#: Language families by ISO 639-1 code.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "yi", "fy", "lb"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc", "la"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "mk", "sr", "hr", "bs", "sl"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz", "tk", "ky"),
    "indic": ("hi", "bn", "mr", "ne", "gu", "pa", "ur"),
    "semitic": ("ar", "he", "am", "mt"),
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes}

_GAPS = re.compile(r"[\W\d_]+")
_PIECE = 1 << 20


def family_of(language: str) -> str:
    return _FAMILY.get(language, language)


def features(text: str) -> np.ndarray:
    """The normed vector of a text; characters that are not letters only part words."""
    counts = np.zeros(1 << BITS)
    letters = " " + _GAPS.sub(" ", text.lower()) + " "
    points = np.frombuffer(letters.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    longest = max(NGRAMS)
    for at in range(0, len(points), _PIECE):  # pieces overlap by what the longest n-gram reaches over
        part = points[at : at + _PIECE + longest - 1]
        key = np.zeros(len(part), np.uint64)
        for n in range(1, longest + 1):
            key = key[: len(part) - n + 1] * np.uint64(0x100000001B3) + part[n - 1 :] + np.uint64(n)
            here = key[:_PIECE]
            if n in NGRAMS:
                counts += np.bincount((here * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BITS)).astype(np.int64),
                                      minlength=1 << BITS)
    vector = np.sqrt(counts)
    size = np.linalg.norm(vector)
    return (vector / size if size else vector).astype(np.float32)


def linear_svm(x: np.ndarray, y: np.ndarray, strength: float = 1e-4, passes: int = 12) -> tuple[np.ndarray, float]:
    """Weights and intercept of a hinge-loss SVM by stochastic subgradients with averaging; y is -1 or 1.

    Both classes weigh alike, whatever their sizes.
    """
    order = np.random.default_rng(2)
    balance = np.where(y > 0, len(y) / (2 * max(1, (y > 0).sum())), len(y) / (2 * max(1, (y < 0).sum())))
    w, b = np.zeros(x.shape[1]), 0.0
    mean_w, mean_b, kept, step = np.zeros_like(w), 0.0, 0, 0
    batch = 16
    for turn in range(passes):
        mixed = order.permutation(len(y))
        for at in range(0, len(y), batch):
            some = mixed[at : at + batch]
            step += 1
            rate = 1.0 / (strength * (step + 1 / (strength * 4)))
            active = y[some] * (x[some] @ w + b) < 1
            push = (y[some] * balance[some] * active) / len(some)
            w = (1 - rate * strength) * w + rate * (push @ x[some])
            b += 0.1 * rate * push.sum()
            if turn >= passes // 2:
                kept += 1
                mean_w += (w - mean_w) / kept
                mean_b += (b - mean_b) / kept
    return (mean_w, mean_b) if kept else (w, b)


def sample(docs: DataFrame, learn: Column) -> DataFrame:
    """Bounded sample: doc_id, text, lang of labelled documents with a letter.

    Of a language with many ids only those with a hash low enough for twice PER_LANGUAGE are ranked.
    """
    usable = docs.where(learn & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & has_letter(F.col("text")))
    keys = usable.select("doc_id", "lang", unit_hash(2, F.col("doc_id")).alias("hash"))
    # stored, so that the planner knows its size and joins it without dealing the documents by language
    sizes = store(keys.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("ids")), "language-sizes")
    low = F.col("hash") < F.lit(float(1 << 62)) * 2 * PER_LANGUAGE / F.col("ids")
    order = Window.partitionBy("lang").orderBy("hash", "doc_id")
    chosen = (keys.join(sizes, "lang").where(low).select("doc_id", "lang", "hash").distinct()
              .withColumn("n", F.row_number().over(order)).where(F.col("n") <= PER_LANGUAGE)
              .orderBy("n", "hash", "lang").limit(SAMPLE).select("doc_id", "lang"))
    texts = usable.select("doc_id", "lang", F.struct(F.xxhash64("text").alias("by"), "text").alias("row"))
    one = texts.join(F.broadcast(chosen), ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min("row").alias("row"))
    return one.select("doc_id", "row.text", "lang")  # SAMPLE rows at most


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def fit(training: DataFrame) -> DataFrame:
    """One row for each SVM: step (family, pair), first, second (null for the rest), weights, intercept."""
    ready(training.sparkSession)
    languages = sorted(r[0] for r in training.select("lang").distinct().collect())  # SAMPLE at most
    families = sorted({family_of(x) for x in languages})
    family_tasks = min(FAMILY_TASKS, len(families))
    members = {f: [x for x in languages if family_of(x) == f] for f in families}
    pairs = [pair for f in families for pair in combinations(members[f], 2)]
    #: tasks that need the documents of a language: all of families, those of its own pairs
    roles = {x: [*range(family_tasks)] for x in languages}
    for n, pair in enumerate(pairs):
        for x in pair:
            roles[x].append(family_tasks + n)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, text, lang in zip(*(batch.column(i).to_pylist() for i in range(3))):
                x = features(text).astype(np.float16).tobytes()  # 2^BITS halves: 8 KB a document
                tasks = roles[lang]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([doc_id] * len(tasks), pa.int64()), pa.array(tasks, pa.int32()),
                     pa.array([lang] * len(tasks), pa.string()), pa.array([x] * len(tasks), pa.binary())],
                    names=["doc_id", "task", "lang", "x"])

    def learn(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["doc_id", "lang"], kind="stable")
        x = np.empty((len(frame), 1 << BITS), np.float32)
        for n, row in enumerate(frame["x"]):
            x[n] = np.frombuffer(row, np.float16)
        task = int(key[0])
        if task < family_tasks:
            own = frame["lang"].map(family_of)
            jobs = [("family", f, None, own == f) for f in families[task::family_tasks]]
        else:
            first, second = pairs[task - family_tasks]
            jobs = [("pair", first, second, frame["lang"] == first)]
        fitted = [linear_svm(x, np.where(plus, 1.0, -1.0)) for _, _, _, plus in jobs]
        return pd.DataFrame({"step": [j[0] for j in jobs], "first": [j[1] for j in jobs], "second": [j[2] for j in jobs],
                             "weights": [w.astype(np.float32).tobytes() for w, _ in fitted], "intercept": [float(b) for _, b in fitted]})

    rows = training.select("doc_id", "text", "lang").mapInArrow(vectors, "doc_id long, task int, lang string, x binary")
    return rows.groupBy("task").applyInPandas(
        learn, "step string, first string, second string, weights binary, intercept double")


class Model:
    """The fitted SVMs as matrices; `languages` are those that were learned."""

    def __init__(self, rows: list, languages: list[str]):
        self.languages = languages
        self.families = sorted({family_of(x) for x in languages})
        steps = {(r["step"], r["first"], r["second"]): (np.frombuffer(r["weights"], np.float32), r["intercept"]) for r in rows}
        width = 1 << BITS
        zero = (np.zeros(width, np.float32), 0.0)
        tops = [steps.get(("family", f, None), zero) for f in self.families]
        self.pairs = sorted((a, b) for s, a, b in steps if s == "pair")
        below = [steps["pair", a, b] for a, b in self.pairs]
        self.weights = np.stack([w for w, _ in tops + below]) if tops else np.zeros((0, width), np.float32)
        self.intercepts = np.array([b for _, b in tops + below])

    def predict(self, text: str) -> tuple[str, float]:
        margins = self.weights @ features(text) + self.intercepts
        tops = margins[: len(self.families)]
        best = int(np.argmax(tops))
        family = self.families[best]
        inside = [x for x in self.languages if family_of(x) == family]
        rest = np.delete(tops, best)
        score = _squash(tops[best] - rest.max()) if len(rest) else 1.0
        if len(inside) == 1:
            return inside[0], score
        votes = dict.fromkeys(inside, 0)
        sums = dict.fromkeys(inside, 0.0)
        closest: dict[str, float] = {}
        for (a, b), m in zip(self.pairs, margins[len(self.families) :]):
            if a in votes:
                votes[a if m >= 0 else b] += 1
                sums[a], sums[b] = sums[a] + m, sums[b] - m
                closest[a], closest[b] = min(closest.get(a, np.inf), m), min(closest.get(b, np.inf), -m)
        winner = max(inside, key=lambda x: (votes[x], sums[x], x))
        return winner, score * _squash(2 * closest[winner])


def _squash(margin: float) -> float:
    return float(1.0 / (1.0 + np.exp(-np.clip(2 * margin, -50, 50))))


def predictions(docs: DataFrame, models: DataFrame) -> DataFrame:
    """doc_id, lang_pred and score of every row of docs."""
    spark = docs.sparkSession
    ready(spark)
    rows = [r.asDict() for r in models.collect()]
    learned = sorted({x for r in rows if r["step"] == "pair" for x in (r["first"], r["second"])}
                     | {x for r in rows if r["step"] == "alone" for x in [r["first"]]})
    shared = spark.sparkContext.broadcast((rows, learned))

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model([r for r in shared.value[0] if r["step"] != "alone"], shared.value[1])
        for batch in batches:
            named = [model.predict(t.as_py()) if known.as_py() and model.languages else (UNKNOWN, 0.0)
                     for t, known in zip(batch.column(1), batch.column(2))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([n for n, _ in named], pa.string()), pa.array([s for _, s in named], pa.float64())],
                names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text", has_letter(F.col("text")).alias("known")).mapInArrow(
        name, "doc_id long, lang_pred string, score double")


def model(docs: DataFrame, learn: Column) -> DataFrame:
    """Fit on the documents that may be learned from, and store the SVMs; `alone` rows list every language."""
    training = store(sample(docs, learn), "language-sample")
    spark = docs.sparkSession
    names = training.select(F.lit("alone").alias("step"), F.col("lang").alias("first"), F.lit(None).cast("string").alias("second"),
                            F.lit(b"").alias("weights"), F.lit(0.0).alias("intercept")).distinct()
    if training.isEmpty():
        return spark.createDataFrame([], "step string, first string, second string, weights binary, intercept double")
    return store(fit(training).unionByName(names), "language-model")


def op2_family_then_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = remainder(F.col("doc_id"), 4) == 2
    found = predictions(docs, model(docs, ~held_out))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
