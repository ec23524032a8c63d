"""Quality rules by robust multivariate outliers: minimum covariance determinant per language and source.

Four statistics of a text are transformed (logarithm of the mean word length; square roots of the shares of symbols,
repeated lines and repeated words) and put on an integer grid. Texts that pass the base rules form the population of their
language and source. Equal grid points are one row with a count, so sums are exact whatever the order of the data.

From two starts for every group (medians with fixed spreads; mean and covariance) concentration steps follow: distances
are binned on a logarithmic scale, one aggregate gives counts and moments for each bin, and the bins up to half of the
group make the next mean and covariance. The start with the smaller determinant wins and is reweighted. The covariance
has a floor and a prior of PRIOR_ROWS texts, so that constant statistics and small groups do not reject ordinary texts.
A text is rejected when its squared Mahalanobis distance is above CUTOFF, the chi-square quantile of 1 - 1e-4.

Everything is DataFrame functions. A null text has no words and fails the base rules, as an empty one does. Null languages
and sources are groups of their own. Repeated rows count and are reported once each; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from aislerank.llm.common import SPACES, store, table

SYMBOLS = "#*$%&|<>"
LEAST_WORDS = 50
MOST_REPEATED = 50  # per cent of the words

#: Smallest standard deviation of each transformed statistic; the grid has FINE points for it.
FLOORS = (0.06, 0.04, 0.15, 0.18)
FINE = 8
PRIOR_ROWS = 25
PRIOR = 2.0  # standard deviations of the prior, in floors
STEPS = 5
BINS = 16  # bins for each doubling of 1 + squared distance
#: Fixed values for 4 degrees of freedom: consistency factors of half the data and of the reweighted part, the 0.975
#: quantile that reweights, and the quantile of 1 - 1e-4.
HALF_FACTOR, REWEIGHT_FACTOR, REWEIGHT, CUTOFF = 2.1, 1.064, 11.143, 23.513

P = len(FLOORS)
_Q = [f"q{i}" for i in range(P)]
_PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]
_GROUP = ["lang", "source"]


# ---------------------------------------------------------------- statistics


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def _repeated_words(words: Column) -> Column:
    """Words that lie in a window of three words which occurs twice or more in the text."""

    def windows(w: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(w) - 3)
        return F.array_sort(F.transform(places, lambda i: F.struct(
            F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("s"), i.alias("p"))))

    def twice(s: Column) -> Column:
        def same(x: Column, j: Column) -> Column:
            return F.coalesce(F.get(s, j)["s"] == x["s"], F.lit(False))

        return F.array_sort(F.transform(F.filter(s, lambda x, j: same(x, j - 1) | same(x, j + 1)), lambda x: x["p"]))

    def covered(places: Column) -> Column:  # union of [p, p + 2] over ascending p
        return F.aggregate(
            places, F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
            lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"), p.alias("last")), lambda a: a["n"])

    return _let(words, lambda w: F.when(F.size(w) < 3, F.lit(0)).otherwise(
        _let(windows(w), lambda s: covered(twice(s)))))


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the base counts of every row."""
    text = F.coalesce("text", F.lit(""))
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    size = F.length(text)
    counted = docs.select(
        "doc_id", "lang", "source", F.size(words).cast("long").alias("n_words"),
        F.length(F.translate(text, SPACES, "")).cast("long").alias("word_chars"),
        (size - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.struct((F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"),
                                       F.size(x).cast("long").alias("all"))).alias("lines"),
        _repeated_words(words).cast("long").alias("n_repeat_words"))
    return counted.select(
        "doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", F.col("lines.dup").alias("n_dup_lines"),
        "n_repeat_words", F.col("lines.all").alias("n_lines"),
        ((F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))).alias("base_failed"))


def grid(counted: DataFrame) -> DataFrame:
    """Adds the transformed statistics as grid points q0..q3."""
    def share(part: str, whole: str) -> Column:
        return F.sqrt(F.col(part) / F.greatest(F.col(whole), F.lit(1)))

    vector = (F.log(F.greatest(F.col("word_chars"), F.lit(1)) / F.greatest(F.col("n_words"), F.lit(1))),
              share("n_symbols", "word_chars"), share("n_dup_lines", "n_lines"), share("n_repeat_words", "n_words"))
    return counted.withColumns({q: F.round(x * (FINE / floor)).cast("long") for q, x, floor in zip(_Q, vector, FLOORS)})


# ---------------------------------------------------------------- estimates


def _moments() -> list[Column]:
    n = F.col("n")
    return ([F.sum("n").alias("n")] + [F.sum(n * F.col(q)).alias(f"s{i}") for i, q in enumerate(_Q)]
            + [F.sum(n * F.col(_Q[i]) * F.col(_Q[j])).alias(f"s{i}{j}") for i, j in _PAIRS])


def _with_estimate(sums: DataFrame, factor: float) -> DataFrame:
    """From n and moments: means m, the inverse Cholesky factor w of the covariance, and the logarithm of its determinant."""
    n = F.col("n").cast("double")
    prior = F.lit(float(FINE**2)) * (1 + PRIOR**2 * PRIOR_ROWS / (n + PRIOR_ROWS))
    out = sums.withColumns({f"m{i}": F.col(f"s{i}") / n for i in range(P)})
    out = out.withColumns({
        f"c{i}{j}": factor * (F.col(f"s{i}{j}") / n - F.col(f"m{i}") * F.col(f"m{j}")) + (prior if i == j else 0.0)
        for i, j in _PAIRS})
    for j in range(P):  # Cholesky, column by column
        left = sum((F.col(f"l{j}{k}") ** 2 for k in range(j)), F.lit(0.0))
        out = out.withColumn(f"l{j}{j}", F.sqrt(F.col(f"c{j}{j}") - left))
        for i in range(j + 1, P):
            dot = sum((F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))
            out = out.withColumn(f"l{i}{j}", (F.col(f"c{i}{j}") - dot) / F.col(f"l{j}{j}"))
    for i in range(P):  # inverse of the factor, row by row
        for j in range(i + 1):
            dot = sum((F.col(f"l{i}{k}") * F.col(f"w{k}{j}") for k in range(j, i)), F.lit(0.0))
            out = out.withColumn(f"w{i}{j}", (F.lit(1.0 if i == j else 0.0) - dot) / F.col(f"l{i}{i}"))
    return out.withColumn("det", sum((F.log(f"l{i}{i}") for i in range(P)), F.lit(0.0)))


def _parameters() -> list[str]:
    return [f"m{i}" for i in range(P)] + [f"w{i}{j}" for i, j in _PAIRS] + ["det"]


def _distance() -> Column:
    """Squared Mahalanobis distance of the grid point q from the parameters m and w of the same row."""
    total = F.lit(0.0)
    for i in range(P):
        z = sum((F.col(f"w{i}{j}") * (F.col(_Q[j]) - F.col(f"m{j}")) for j in range(i + 1)), F.lit(0.0))
        total = total + z * z
    return total


def _bin(distance: Column) -> Column:
    return F.floor(BINS * F.log2(1 + distance)).cast("int")


def _beside(left: DataFrame, right: DataFrame) -> DataFrame:
    """Join on language and source, nulls equal."""
    renamed = right.withColumnsRenamed({"lang": "r_lang", "source": "r_source"})
    return left.join(renamed, left["lang"].eqNullSafe(renamed["r_lang"]) & left["source"].eqNullSafe(renamed["r_source"]),
                     "left").drop("r_lang", "r_source")


def _binned(cells: DataFrame, estimates: DataFrame) -> DataFrame:
    """Counts and moments of every bin of distances, for each group and start."""
    return (_beside(cells, estimates).withColumn("bin", _bin(_distance()))
            .groupBy(*_GROUP, "start", "bin").agg(*_moments()))


def _summed(bins: DataFrame) -> DataFrame:
    return bins.groupBy(*_GROUP, "start").agg(*[F.sum(c).alias(c) for c in bins.columns if c not in (*_GROUP, "start", "bin")])


def estimates(points: DataFrame) -> DataFrame:
    """Reweighted MCD of each language and source over the rows of points: lang, source, m, w and det."""
    cells = store(points.groupBy(*_GROUP, *_Q).agg(F.count("*").alias("n")), "outlier-cells")
    classic = cells.groupBy(*_GROUP).agg(*_moments()).withColumn("start", F.lit(1))
    middle = cells.groupBy(*_GROUP).agg(F.sum("n").alias("n"), *[
        F.percentile(q, F.lit(0.5), F.col("n")).alias(f"s{i}") for i, q in enumerate(_Q)])
    medians = middle.select(  # medians as means, and no covariance beyond floor and prior
        *_GROUP, "n", *[(F.col(f"s{i}") * F.col("n")).alias(f"s{i}") for i in range(P)],
        *[(F.col(f"s{i}") * F.col(f"s{j}") * F.col("n")).alias(f"s{i}{j}") for i, j in _PAIRS], F.lit(0).alias("start"))
    current = store(_with_estimate(classic, 1.0).select(*_GROUP, "start", *_parameters()).unionByName(
        _with_estimate(medians, 1.0).select(*_GROUP, "start", *_parameters())), "outlier-start")
    upto = Window.partitionBy(*_GROUP, "start").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*_GROUP, "start")
    for step in range(STEPS):
        bins = _binned(cells, current).withColumn("ahead", F.coalesce(F.sum("n").over(upto), F.lit(0)))
        half = F.floor((F.sum("n").over(whole) + P + 1) / 2)
        near = bins.withColumn("half", half).where(F.col("ahead") < F.col("half")).drop("ahead", "half")
        current = store(_with_estimate(_summed(near), HALF_FACTOR).select(*_GROUP, "start", *_parameters()), f"outlier-step-{step}")
    best = store(current.groupBy(*_GROUP).agg(F.min_by(F.struct("start", *_parameters()), F.struct("det", "start")).alias("best"))
                 .select(*_GROUP, "best.*"), "outlier-best")
    close = _binned(cells, best).where(F.col("bin") <= _bin(F.lit(REWEIGHT)))
    again = _with_estimate(_summed(close), REWEIGHT_FACTOR).select(*_GROUP, *_parameters())
    return store(again, "outlier-estimates")


def judged(docs: DataFrame) -> DataFrame:
    """The base counts of every row with distance (squared; null where the base failed) and kept."""
    counted = store(grid(statistics(docs)), "outlier-statistics")
    found = _beside(counted, estimates(counted.where(~F.col("base_failed"))))
    far = F.when(~F.col("base_failed"), _distance())
    return found.withColumn("distance", far).select(
        *[c for c in counted.columns if c not in _Q], "distance",
        F.coalesce(~F.col("base_failed") & (F.col("distance") <= CUTOFF), F.lit(False)).alias("kept"))


def op1_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.round("distance", 6).alias("distance"))
