"""Keyword search and dense numbering against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from aislerank.operators import search
from aislerank.operators.lists import group_lists
from test_strategies import frame, random_catalogue

WORDS = ["steel", "steam", "ste", "copper", "cop", "brass", "bolt", "bolts", "tin"]


def shop(seed, n=60):
    rng = random.Random(seed)
    rows = random_catalogue(seed, n)
    for r in rows:
        r["product_name"] = " ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 4)))
    return rows


def by_hand(rows, phrase, k):
    tokens = [t for t in phrase.lower().split() if len(t) >= 2]
    scored = []
    for r in rows:
        words = [w for w in r["product_name"].lower().split() if len(w) >= 3]
        score = sum(2.0 if w == t else 0.5 if w.startswith(t) else 0.0 for t in tokens for w in words)
        if score > 0:
            scored.append((-score, -r["popularity_score"], r["product_id"]))
    return [(p, -s) for s, _, p in sorted(scored)[:k]]


@pytest.mark.parametrize("seed,common", [(1, 0), (1, 3), (2, 8), (2, 1000)])
def test_search_is_the_same_wherever_common_begins(spark, seed, common):
    rng = random.Random(seed)
    rows = shop(seed)
    phrases = sorted({" ".join(rng.choice(WORDS + ["st", "Cop", "t", "none"]) for _ in range(rng.randint(1, 4))) for _ in range(40)} | {"", "zz"})
    found = search.search(frame(spark, rows), spark.createDataFrame([(p,) for p in phrases], "query string"), 5, common=common)
    got = {}
    for r in found.orderBy("query", "rank").collect():
        got.setdefault(r["query"], []).append((r["product_id"], r["score"]))
    assert got == {p: want for p in phrases if (want := by_hand(rows, p, 5))}


def test_phrases_that_share_a_common_word_stay_linear(spark):
    rows = random_catalogue(3, 400)
    for i, r in enumerate(rows):
        r["product_name"] = f"steel part{i:03d}"
    items = group_lists(frame(spark, rows).withColumn("name_key", F.lower("product_name")), "name_key", 5)
    phrases = spark.range(10_000).select(F.format_string("steel part%03d", F.col("id") % 400).alias("query")).union(
        spark.range(10_000).select(F.format_string("steel absent%d", F.col("id")).alias("query")))
    scored = search.name_scores(phrases, items, 5, common=50)
    # 5 names for the word that all names hold, and one for the word that one name holds; not 400.
    per_phrase = scored.groupBy("query").count().agg(F.max("count"), F.count("*")).first()
    assert per_phrase[0] <= 6 and per_phrase[1] == 10_400


def test_numbers_are_dense_whatever_the_keys_begin_with(spark):
    keys = [f"Brand#{i:05d}" for i in range(3000)]
    random.Random(1).shuffle(keys)
    rows = spark.createDataFrame([(k,) for k in keys], "name string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = search.number_rows(rows, "name")
        assert [(r["name"], r["id"]) for r in got.orderBy("id").collect()] == [(k, i + 1) for i, k in enumerate(sorted(keys))]
        spread = rows.repartitionByRange(F.col("name")).select(F.spark_partition_id().alias("p")).distinct().count()
        assert spread > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert search.number_rows(rows.limit(0), "name").count() == 0
