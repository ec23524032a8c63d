"""Base counts and robust outliers against plain Python and numpy."""

import re
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from aislerank.llm import outliers
from conftest_llm import ODD


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    places = defaultdict(list)
    for i in range(len(words) - 2):
        places[tuple(words[i : i + 3])].append(i)
    covered = {i + d for found in places.values() if len(found) > 1 for i in found for d in range(3)}
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)),
            len(covered), failed)


def prose(rng, n):
    return " ".join("".join(rng.choice(list("abcdefghij"), size=rng.integers(3, 8))) for _ in range(n))


def test_base_counts_and_odd_rows(docs_of):
    texts = ["a b c a b c", "a a a a", "x\nx\n\n x\nx", "é<>|ü %%", "a b"]
    rows = ODD + [(100 + i, t, "en", "s") for i, t in enumerate(texts)]
    found = outliers.judged(docs_of(rows).withColumn("n", F.lit(1)))
    assert not re.search("Python|Arrow|Pandas", found._jdf.queryExecution().executedPlan().toString())
    found = found.collect()
    assert len(found) == len(rows) and not any(r.kept for r in found)
    got = {r.doc_id: r for r in found}
    for i, t, _, _ in rows:
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(t), t


def test_rejects_planted_junk_and_keeps_prose(docs_of):
    rng = np.random.default_rng(5)
    rows = [(i, prose(rng, 120), "en", "s" if i % 3 else None) for i in range(300)]
    junk = [(1000 + i, " ".join(w + "###" for w in prose(rng, 120).split()), "en", "s") for i in range(20)]
    got = {r.doc_id: r for r in outliers.judged(docs_of(rows + junk)).collect()}
    assert all(got[i].kept for i, *_ in rows)
    assert not any(got[i].kept for i, *_ in junk)


def test_estimate_is_the_mcd_of_the_grid(docs_of, spark):
    """The distance that the operator reports equals one computed in numpy from its own estimate's definition."""
    rng = np.random.default_rng(6)
    rows = [(i, prose(rng, int(rng.integers(60, 300))), "en", "s") for i in range(200)]
    points = outliers.grid(outliers.statistics(docs_of(rows))).where("not base_failed")
    found = outliers.estimates(points).first()
    q = np.array(points.select("q0", "q1", "q2", "q3").collect(), float)
    p = outliers.P
    mean = np.array([found[f"m{i}"] for i in range(p)])
    w = np.array([[found[f"w{i}{j}"] if j <= i else 0.0 for j in range(p)] for i in range(p)])
    cov = np.linalg.inv(w.T @ w)
    assert abs(np.linalg.slogdet(cov)[1] - 2 * found["det"]) < 1e-9
    d = ((q - mean) @ np.linalg.inv(cov) * (q - mean)).sum(axis=1)
    near = q[d <= outliers.REWEIGHT]  # a fixed point up to one bin of distances
    assert np.abs(near.mean(axis=0) - mean).max() < 1.5
    assert len(near) > 0.9 * len(q)


def test_empty_table(docs_of):
    assert outliers.judged(docs_of([])).count() == 0
