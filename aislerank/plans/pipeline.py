"""The batch pipeline: raw rows -> checks -> clean rows -> features -> vectors -> lists -> metrics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aislerank.functions.numbers import rounded
from aislerank.operators import cleaning, features, hybrid, metrics, quality, reports, strategies, vectors
from aislerank.session import cut
from aislerank.settings import HYBRID_WEIGHTS, TextModel
from aislerank.sources.tables import append_training_run, write_json_report, write_stage


@dataclass(frozen=True)
class Trained:
    """The tables a run leaves behind."""

    features: DataFrame
    vocabulary: DataFrame
    vectors: DataFrame
    edges: DataFrame
    metrics: DataFrame


def run(raw: DataFrame, folder: str, k: int = 10, model: TextModel = TextModel(), strict: bool = True) -> Trained:
    """Validate (an error-severity rule stops the run, unless not ``strict``), clean, derive, fit and evaluate.

    Stages are Parquet tables below ``folder``; each later step starts from the files.  The JSON
    documents of the run lie in ``folder``/reports.
    """
    if strict:
        quality.enforce(quality.verdict(quality.issues(quality.measure(raw))))
    clean = write_stage(cleaning.cleaned(raw), f"{folder}/cleaned")
    full = write_stage(features.add_trend(features.featured(clean)), f"{folder}/features")
    docs = vectors.terms(full, model=model)
    vocab = write_stage(vectors.vocabulary(docs, model), f"{folder}/vocabulary")
    vecs = write_stage(vectors.vectors(docs, vocab), f"{folder}/vectors")
    edges = write_stage(vectors.neighbours(vecs, 3 * k), f"{folder}/edges")
    summary = evaluated(full, vocab, vecs, edges, k)
    append_training_run(summary, f"{folder}/training_history")
    judged = write_stage(reports.evaluation(shown(edges, k), full, vocab, vecs, (5,) if k == 5 else (5, k)), f"{folder}/evaluation")
    write_json_report(reports.document(judged), f"{folder}/reports/evaluation")
    write_json_report(reports.document(reports.pipeline_summary(raw, full, vocab, judged, folder)), f"{folder}/reports/summary")
    return Trained(full, vocab, vecs, edges, summary)


def shown(edges: DataFrame, k: int) -> DataFrame:
    """The k nearest as recommendations."""
    return edges.filter(F.col("rank") <= k).select(
        F.col("src").alias("query_id"), F.col("dst").alias("product_id"), "rank", "score")


def evaluated(full: DataFrame, vocab: DataFrame, vecs: DataFrame, edges: DataFrame, k: int = 10) -> DataFrame:
    """One row of run metrics over all queries."""
    recs = shown(edges, k)
    one = lambda df, c: df.select(rounded(F.col(c), 6)).scalar().alias(c)
    at5 = metrics.category_precision_recall(recs, full, 5)
    at10 = metrics.category_precision_recall(recs, full, k)
    return full.agg(F.count("*").alias("dataset_rows")).select(
        F.current_timestamp().alias("training_date"), "dataset_rows",
        vocab.agg(F.count("*").alias("n")).scalar().alias("vocab_size"),
        at5.select(rounded(F.col("precision"), 6)).scalar().alias("precision_at_5"),
        at10.select(rounded(F.col("recall"), 6)).scalar().alias("recall_at_10"),
        one(metrics.coverage(recs, full), "coverage"),
        one(metrics.diversity(recs, vecs), "diversity"),
        one(metrics.novelty(recs, full), "novelty"))


def training_run(texted: DataFrame, k: int = 10) -> DataFrame:
    """The run summary for a catalogue that already carries its texts."""
    full = cut(features.labelled(texted))
    vocab, vecs = vectors.fit(full)
    return evaluated(full, vocab, vecs, cut(vectors.neighbours(vecs, k)), k)


# Strategy names users may ask for; an unknown name means the blend.
ALIASES = {"frequently_bought": "frequently_bought_together"}


def recommend(trained: Trained, ids: DataFrame, strategy: str = "hybrid", k: int = 10,
              weights: dict = HYBRID_WEIGHTS) -> DataFrame:
    """Recommendations of one strategy for the ``query_id`` values in ``ids``."""
    catalogue = trained.features
    queries = strategies.pick_queries(catalogue, ids)
    by_name = {
        "category_similarity": strategies.category_similarity,
        "brand_similarity": strategies.brand_similarity,
        "price_similarity": strategies.price_similarity,
        "popularity": strategies.popularity,
        "trending": strategies.trending,
        "frequently_bought_together": strategies.bought_together,
        "content_based": lambda c, q, n: strategies.content_based(c, q, trained.edges, n),
    }
    job = by_name.get(ALIASES.get(strategy, strategy))
    if job is None:
        return hybrid.with_unknown(catalogue, ids, trained.edges, k, weights)
    return job(catalogue, queries, k)
