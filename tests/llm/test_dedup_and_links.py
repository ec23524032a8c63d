"""SimHash components, the rows that stay of each, and connected components against brute force."""

import random

import xxhash
from pyspark.sql import functions as F

from aislerank.llm import simhash
from aislerank.llm.components import components
from conftest_llm import ODD


def shingles(text, k):
    words = (text or "").encode().lower().split()
    if len(words) < k:
        return [b" ".join(words)] if words else []
    return [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)]


def fingerprint(text):
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles(text, 3)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(keys, linked):
    parent = {k: k for k in keys}

    def find(k):
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    keys = sorted(keys)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if linked(a, b):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {k: find(k) for k in keys}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_grid_links_connect_as_all_pairs_do(spark):
    rng = random.Random(4)
    fps = {0, (1 << 64) - 1, 1 << 63}
    for _ in range(12):
        x = rng.getrandbits(64)
        for _ in range(40):
            for _ in range(rng.randint(1, 3)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    want = classes(fps, lambda a, b: (a ^ b).bit_count() <= 2)
    links = simhash.links(spark.createDataFrame([(signed(x),) for x in fps], "fp long"))
    got = {r.node: r.root for r in components(links).collect()}
    for a in fps:
        for b in fps:
            same = got.get(signed(a), signed(a)) == got.get(signed(b), signed(b))
            assert same == (want[a] == want[b])


def test_components_of_a_long_chain_and_a_star(spark):
    chain = spark.range(600).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    star = spark.range(2000, 2500).select(F.lit(1999).cast("long").alias("a"), F.col("id").alias("b"))
    found = components(chain.unionByName(star)).groupBy("root").count().collect()
    assert sorted(r["count"] for r in found) == [501, 601]
    assert components(chain.where("a < 0")).count() == 0


def test_documents_against_brute_force(docs_of, spark):
    rows = [(i, t, "en", "s") for i, (_, t, _, _) in enumerate(ODD)]
    rows += [(100 + i, f"Some words THAT differ little number {i // 3} é", None, None) for i in range(9)]
    fps = {i: fingerprint(t) for i, t, _, _ in rows}
    root = classes(set(fps.values()), lambda a, b: (a ^ b).bit_count() <= 2)
    low = {}
    for i, f in fps.items():
        low[root[f]] = min(i, low.get(root[f], i))
    got = {r.doc_id: r for r in simhash.near_duplicates(docs_of(rows)).collect()}
    assert {i: (r.fp % (1 << 64), r.component_id) for i, r in got.items()} == {i: (f, low[root[f]]) for i, f in fps.items()}


def test_one_row_of_each_component_stays(docs_of, spark):
    """Against all pairs: chains of fingerprints, copies, repeated rows, null ids and clashing names."""
    rng = random.Random(9)
    words = [f"w{i}" for i in range(3000)]
    rows = [(1000 + n, *row[1:]) for n, row in enumerate(ODD)]
    for n in (30, 300, 2000):
        for _ in range(6):
            text = [rng.choice(words) for _ in range(n)]
            for _ in range(6):
                rows.append((len(rows), " ".join(text), rng.choice(["en", None]), "s"))
                text[rng.randrange(n)] = rng.choice(words)
    rows += [(5, "a row again", "en", "s")] * 40 + [(None, "a row again", "en", "s")] * 3 + [(None, "no id", "en", "s")] * 2
    fps = [fingerprint(t) for _, t, _, _ in rows]
    root = classes(set(fps), lambda a, b: (a ^ b).bit_count() <= 2)
    lowest = {}
    for (i, *_), fp in zip(rows, fps):
        lowest.setdefault(root[fp], []).append(i)
    want = sorted(str(min((i for i in ids if i is not None), default=None)) for ids in lowest.values())
    extra = ("_a", "_A", "_b", "_n", "key", "fp", "row_key", "first", "none", "root")
    docs = docs_of(rows).toDF("doc_id", "text", "lang", "source", "n_chars").select(
        "*", *[F.lit(f"own {n}").alias(c if c != "_A" else "_A2") for n, c in enumerate(extra)])
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == want
    assert {tuple(r)[5:] for r in kept.collect()} == {tuple(f"own {n}" for n in range(len(extra)))}
    assert len(want) < len(rows) / 2


def test_odd_and_empty_tables(docs_of):
    docs = docs_of(ODD)
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["1", "3", "None", "6", "7", "8"])
    assert simhash.one_of_each(docs_of([])).count() == 0
    assert simhash.near_duplicates(docs_of([])).count() == 0
