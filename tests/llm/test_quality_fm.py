"""The factorisation machine: the linear-time sum against all pairs, held-out accuracy, odd rows."""

import random
import zlib
from itertools import combinations

import numpy as np
from conftest_llm import ODD
from pyspark.sql import functions as F

from aislerank.llm import quality_fm


def test_sum_of_squares_is_the_sum_over_pairs():
    rng = np.random.default_rng(1)
    machine = quality_fm.Machine(rng.normal(size=50), rng.normal(size=(50, quality_fm.RANK)), 0.3)
    index, value = np.array([3, 7, 8, 20, 49]), rng.normal(size=5)
    pairs = sum(float(machine.factors[a] @ machine.factors[b]) * x * y
                for (a, x), (b, y) in combinations(zip(index, value), 2))
    assert np.isclose(machine.raw(index, value)[0], 0.3 + machine.weights[index] @ value + pairs)


def test_pairs_are_learned():
    """Exclusive or of two words: no weight of a single feature tells it."""
    first, second = 11, 22
    rows, labels = [], []
    rng = random.Random(3)
    for i in range(400):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        rows.append((np.array([first + a, second + b]), np.ones(2)))
        labels.append(float(a != b))
    machine = quality_fm.train(rows, np.array(labels), quality_fm.Settings(passes=20))
    right = [(quality_fm.logistic(machine.raw(*r)[0]) >= 0.5) == bool(y) for r, y in zip(rows, labels)]
    assert np.mean(right) >= 0.99


def words(rng, n):
    return [rng.choice("lorem ipsum dolor sit amet in on of the consetetur sadipscing".split()) for _ in range(n)]


def test_held_out_documents_and_odd_rows(docs_of, spark):
    rng = random.Random(7)
    rows, labels = [], []
    for i in range(600):
        text = words(rng, rng.randint(5, 200))
        bad = i % 4 == 0
        if bad:
            text = [w + rng.choice(["###", "%%%"]) for w in text] if i % 8 else [w + " |" for w in text]
        rows.append((i, ". ".join([" ".join(text[:10]), " ".join(text[10:])]), "en", "s"))
        labels.append((i, None if i == 5 else 2 if i == 6 else int(not bad)))
    rows += [(9000 + n, *row[1:]) for n, row in enumerate(ODD)] + [(1, "an id again", "en", "s")] * 50
    docs = docs_of(rows).selectExpr("*", "1 AS quality", "'x' AS rank", "2 AS score")
    known = spark.createDataFrame([*labels, (None, 1), (12345, 1)], "doc_id long, quality int")
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    training = quality_fm.sample(docs, known, ~held)
    assert training.count() == sum(zlib.crc32(str(i).encode()) % 3 != 1 and q in (0, 1) for i, q in labels)
    assert quality_fm.sample(docs, known, ~held, most=20).count() == 20
    model = quality_fm.fit(training).cache()
    got = {}
    for r in quality_fm.scores(docs, model).collect():
        got.setdefault(r.doc_id, []).append(r.score)
    assert sum(map(len, got.values())) == len(rows) and all(0 <= s <= 1 for c in got.values() for s in c)
    unseen = [i for i in range(600) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([(got[i][0] >= 0.5) == bool(i % 4) for i in unseen]) >= 0.97
    assert quality_fm.scores(docs_of([]), model).count() == 0
    nothing = quality_fm.fit(quality_fm.sample(docs, known.where("doc_id < 0"), F.lit(True)))
    assert {r.score for r in quality_fm.scores(docs, nothing).collect()} == {0.5}


def test_query_on_given_labels(spark, sf):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r.quality is not None}
    got = quality_fm.op12_factor_quality(spark, sf).collect()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    unseen = [(labels[r.doc_id], r.predicted) for r in got if r.held_out and r.doc_id in labels]
    assert np.mean([a == b for a, b in unseen]) >= 0.9
