"""The automaton scan against scores computed term by term, and against SQL."""

import math
import random
import re

import duckdb
import numpy as np
import pytest
from conftest_llm import ODD

from aislerank.llm import lexical

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_force(docs, items, k=10):
    held = [(doc_id, terms(text)) for doc_id, text in docs]
    held = [(doc_id, found) for doc_id, found in held if found]
    n, length = len(held), sum(len(found) for _, found in held)
    out = []
    for item_id, text in items:
        wanted = terms(text)
        weight = {}
        for t in set(wanted):
            df = sum(t in found for _, found in held)
            weight[t] = math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))
        rows = []
        for doc_id, found in held:
            m = 100 - 75 + (75 * len(found) * n) // length
            tf = {t: found.count(t) for t in set(wanted)}
            score = sum(weight[t] * ((10**9 * tf[t]) // (1000 * tf[t] + 8 * m)) for t in wanted)
            if score > 0:
                rows.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item_id, n + 1, row[3], -row[0]) for n, row in enumerate(sorted(rows)[:k])]
    return sorted(map(str, out))


def result(found):
    return sorted(str((r.item_id, r["rank"], r.doc_id, r.score)) for r in found.collect())


def test_scanner_finds_whole_terms_only():
    scanner = lexical.Scanner([t.encode() for t in ("the", "he", "é", "a1", "naïve", "ı")])
    n, tf = scanner.counts("The the,he THE-there a1_A1 é É naïve".encode())
    assert n == 10 and dict(tf) == {0: 3, 1: 1, 2: 1, 3: 2, 4: 1}
    assert scanner.counts(b"") == (0, {}) and scanner.counts("\x00 \x7f".encode()) == (0, {})


@pytest.mark.parametrize("block_bytes", [1 << 21, 300, 1])
def test_search_against_brute_force(spark, docs_of, block_bytes, monkeypatch):
    monkeypatch.setattr(lexical, "CELLS", 7)
    rng = random.Random(5)
    words = ["the", "of", "Ünder", "B2", "c_d", "e'f", "x", "日本", "naïve"] + [f"w{i}" for i in range(30)]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 40)))) for i in range(60)]
    docs += [(70 + i, docs[3][1]) for i in range(15)]  # ties
    docs += [(i, text) for i, text, _, _ in ODD]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 12)))) for i in range(9)]
    items += [(20, None), (21, " .. "), (None, "the the of"), (3, "the x"), (22, "nowhere"), (23, "lange wörter X")]
    table = docs_of([(i, t, None, None) for i, t in docs]).selectExpr("*", "1 AS item", "2 AS score", "3 AS item_id", "4 AS rank")
    asked = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "5 AS doc_id", "6 AS block", "7 AS term")
    assert result(lexical.search(table, asked, block_bytes=block_bytes)) == brute_force(docs, items)


def test_nothing_to_search(spark, docs_of):
    items = spark.createDataFrame([(1, "one two")], "item_id long, text string")
    assert result(lexical.search(docs_of([]), items)) == []
    assert result(lexical.search(docs_of([(1, None, None, None), (2, " .", None, None)]), items)) == []
    assert result(lexical.search(docs_of(ODD), items.where("item_id > 5"))) == []


def test_blocks_are_bounded(spark):
    items = spark.createDataFrame([(i, "word " * (i % 7)) for i in range(300)] + [(999, "long" * 500)], "item_id long, text string")
    dealt = lexical.blocks_of(lexical.item_terms(items), 3000).collect()
    cost = {}
    for r in dealt:
        cost[r.block] = cost.get(r.block, 0) + 64 + sum(len(t) for t in r.found)
    assert max(cost.values()) <= 3000 and len(dealt) == sum(i % 7 > 0 for i in range(300)) + 1


def test_best_keeps_ties_by_id():
    best = lexical.Best(2, 2)
    best.offer(np.array([[5, 0], [5, 1], [4, 1]]), np.array([0, 1, 0]), np.array([9, 0, 1]))
    best.offer(np.array([[5, 1], [6, 0]]), np.array([0, 0]), np.array([2, 7]))
    item, score, null, doc = (c.tolist() for c in best.held)
    assert list(zip(item, score, null, doc)) == [(0, 6, 0, 7), (0, 5, 0, 2), (1, 1, 0, 1), (1, 1, 0, 2)]


def test_sql_on_given_tables(spark, sf):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    want = con.execute(lexical.OP11_SQL).fetchall()
    assert result(lexical.op11_term_automaton(spark, sf)) == sorted(map(str, ((a, b, c, d) for a, b, c, d in want)))
