"""Ranking-quality metrics.  Recommendations are (query_id, product_id, rank, score); lists are short."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aislerank.operators.skew import salted_join


def sample_queries(catalogue: DataFrame, n: int = 100) -> DataFrame:
    """The same n queries for every metric and every run, by hash order."""
    return catalogue.select(F.col("product_id").alias("query_id")).orderBy(F.md5("query_id"), "query_id").limit(n)


def _levels(catalogue: DataFrame) -> DataFrame:
    return catalogue.select("product_id", F.col("category_l1").alias("l1"))


def category_hits(recs: DataFrame, catalogue: DataFrame, k: int) -> DataFrame:
    """(query_id, hits, relevant): relevant are the other products of the query's top level.

    Queries without relevant products or without recommendations are absent.
    """
    levels = _levels(catalogue)
    sizes = levels.groupBy("l1").agg((F.count("*") - 1).alias("relevant")).filter("relevant > 0")
    q = levels.select(F.col("product_id").alias("query_id"), "l1").join(sizes, "l1")
    c = levels.select("product_id", F.col("l1").alias("c_l1"))
    shown = recs.filter(F.col("rank") <= k).select("query_id", "product_id")
    return shown.join(c, "product_id").join(q, "query_id").groupBy("query_id", "relevant").agg(
        F.sum((F.col("c_l1") == F.col("l1")).cast("int")).alias("hits"))


def category_precision_recall(recs: DataFrame, catalogue: DataFrame, k: int = 10) -> DataFrame:
    hits = category_hits(recs, catalogue, k)
    return hits.agg(
        F.count("*").alias("queries"),
        (F.sum("hits") / (F.count("*") * k)).alias("precision"),
        F.avg(F.col("hits") / F.least("relevant", F.lit(k))).alias("recall"))


def coverage(recs: DataFrame, catalogue: DataFrame) -> DataFrame:
    size = catalogue.agg(F.count("*").alias("n")).scalar()
    return recs.agg(F.count_distinct("product_id").alias("recommended")).select(
        "recommended", (F.col("recommended") / size).alias("coverage"))


def list_similarity(recs: DataFrame, vecs: DataFrame, key: str = "query_id") -> DataFrame:
    """(key, items, mean_similarity) for lists of two or more.

    Unit vectors need no pairs: the pairwise dot products of a list add up to half of
    |sum of vectors|^2 - sum of |vector|^2.
    """
    items = recs.groupBy(key).agg(F.count("*").alias("items")).filter("items > 1")
    terms = salted_join(recs.select(key, "product_id"), vecs.withColumnRenamed("id", "product_id"), "product_id").select(
        key, F.explode("vec").alias("e")).groupBy(key, F.col("e.t").alias("t")).agg(
            F.sum("e.w").alias("s"), F.sum(F.col("e.w") * F.col("e.w")).alias("q"))
    sums = terms.groupBy(key).agg((F.sum(F.col("s") * F.col("s")) - F.sum("q")).alias("twice"))
    return items.join(sums, key, "left").select(
        key, "items",
        (F.coalesce("twice", F.lit(0.0)) / (F.col("items") * (F.col("items") - 1))).alias("mean_similarity"))


def diversity(recs: DataFrame, vecs: DataFrame) -> DataFrame:
    return list_similarity(recs, vecs).agg(
        F.avg(1 - F.col("mean_similarity")).alias("diversity"),
        F.avg("mean_similarity").alias("intra_list_similarity"))


def novelty(recs: DataFrame, catalogue: DataFrame) -> DataFrame:
    pop = catalogue.select("product_id", F.coalesce("popularity_score", F.lit(0.0)).alias("pop"))
    per_query = recs.join(pop, "product_id").groupBy("query_id").agg((1 - F.avg("pop")).alias("novelty"))
    return per_query.agg(F.avg("novelty").alias("novelty"))


def average_similarity(recs: DataFrame) -> DataFrame:
    return recs.filter("score > 0").groupBy("query_id").agg(F.avg("score").alias("s")).agg(
        F.avg("s").alias("avg_similarity"))


def threshold_verdict(precision: DataFrame, threshold: float = 0.50) -> DataFrame:
    return precision.withColumn("threshold", F.lit(threshold)).withColumn(
        "accepted", F.col("precision") >= threshold)


# ---------------------------------------------------------------- explicit relevance


def _ideal(n: Column) -> Column:
    return F.aggregate(F.sequence(F.lit(1), n.cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))


def relevance_metrics(recs: DataFrame, relevant: DataFrame, keys: tuple[str, ...] = ("session_id",)) -> DataFrame:
    """Per list: precision, recall, ndcg, hit.  ``relevant`` is (session_id, product_id), distinct.

    Only recommended rows are joined, so a session with very many relevant products costs a count.
    """
    sizes = relevant.groupBy("session_id").agg(F.count("*").alias("relevant"))
    flagged = recs.join(relevant.withColumn("hit", F.lit(1)), ["session_id", "product_id"], "left")
    lists = flagged.groupBy(*keys).agg(
        F.count("*").alias("k"), F.coalesce(F.sum("hit"), F.lit(0)).alias("hits"),
        F.coalesce(F.sum(F.when(F.col("hit") == 1, 1 / F.log2(F.col("rank") + 1.0))), F.lit(0.0)).alias("dcg"))
    return lists.join(sizes, "session_id", "left").select(
        *keys, "k", F.coalesce("relevant", F.lit(0)).alias("relevant"), "hits",
        (F.col("hits") / F.col("k")).alias("precision"),
        F.coalesce(F.col("hits") / F.col("relevant"), F.lit(0.0)).alias("recall"),
        F.coalesce(F.col("dcg") / _ideal(F.least("relevant", "k")), F.lit(0.0)).alias("ndcg"),
        (F.col("hits") > 0).cast("double").alias("hit_rate"))


def session_checks(recs: DataFrame, history: DataFrame, catalogue: DataFrame, vecs: DataFrame | None,
                   keys: tuple[str, ...] = ("session_id",)) -> DataFrame:
    """Per list: share of the catalogue, diversity (1 for fewer than two items), history leakage."""
    size = catalogue.agg(F.count("*").alias("n")).scalar()
    leaked = recs.join(history.select("session_id", "product_id").distinct(), ["session_id", "product_id"], "left_semi")
    leakage = leaked.groupBy(*keys).agg(F.count("*").alias("history_leakage"))
    out = recs.groupBy(*keys).agg(F.count_distinct("product_id").alias("n")).withColumn("size", size).join(
        leakage, list(keys), "left").select(
            *keys, (F.col("n") / F.col("size")).alias("coverage_session"),
            F.coalesce("history_leakage", F.lit(0)).alias("history_leakage"))
    if vecs is None:
        return out
    # Many sessions may be shown the same list: diversity is computed once per distinct list.
    listed = recs.groupBy(*keys).agg(F.sort_array(F.collect_list("product_id")).alias("ids")).withColumn(
        "list_id", F.sha2(F.to_json(F.struct("ids")), 256))
    distinct = listed.groupBy("list_id").agg(F.first("ids").alias("ids")).select("list_id", F.explode("ids").alias("product_id"))
    spread = list_similarity(distinct, vecs, "list_id").select(
        "list_id", (1 - F.col("mean_similarity")).alias("diversity_intra_list"))
    scored = listed.select(*keys, "list_id").join(spread, "list_id", "left").drop("list_id")
    return out.join(scored, list(keys)).withColumn(
        "diversity_intra_list", F.coalesce("diversity_intra_list", F.lit(1.0)))


def compare_scenarios(recs: DataFrame, relevant: DataFrame, history: DataFrame, catalogue: DataFrame) -> DataFrame:
    """One row of mean metrics per scenario; ``recs`` carries a ``scenario`` column."""
    keys = ("scenario", "session_id")
    quality = relevance_metrics(recs, relevant, keys)
    checks = session_checks(recs, history, catalogue, None, keys)
    return quality.join(checks, list(keys)).groupBy("scenario").agg(
        F.count("*").alias("sessions"), F.avg("precision").alias("precision"), F.avg("recall").alias("recall"),
        F.avg("ndcg").alias("ndcg"), F.avg("hit_rate").alias("hit_rate"),
        F.sum("history_leakage").alias("history_leakage"))


def scenario_overlap(recs: DataFrame) -> DataFrame:
    """(session_id, left, right, shared): products two scenarios have in common for a session.

    Scenario names per (session, product) are few; pairs of names are formed inside that short list.
    """
    named = recs.groupBy("session_id", "product_id").agg(F.sort_array(F.collect_set("scenario")).alias("s"))
    pairs = F.flatten(F.transform("s", lambda a: F.transform(
        F.filter("s", lambda b: b > a), lambda b: F.struct(a.alias("left"), b.alias("right")))))
    return named.select("session_id", F.inline(pairs)).groupBy("session_id", "left", "right").agg(
        F.count("*").alias("shared"))


# ---------------------------------------------------------------- training history


def latest_runs(runs: DataFrame, n: int = 20) -> DataFrame:
    return runs.orderBy(F.desc("training_date"), "run_id").limit(n)


def promotions(runs: DataFrame, margin: float = 0.02) -> DataFrame:
    """A run is promoted when its precision beats the model's previous run by the margin."""
    w = Window.partitionBy("model").orderBy("training_date", "run_id")
    before = F.lag("precision_at_5").over(w)
    return runs.withColumn("previous", before).withColumn(
        "promoted", F.coalesce(F.col("precision_at_5") - before >= margin, F.lit(True)))
