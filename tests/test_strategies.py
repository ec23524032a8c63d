"""Strategies against brute force on small random catalogues, where every tier is short."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from aislerank import settings
from aislerank.operators import features, hybrid, nearest, strategies, vectors


def random_catalogue(seed, n=40):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        l1 = rng.choice(["Books", "Gaming", "Electronics", ""])
        rows.append({
            "product_id": f"p{i:02d}", "product_name": f"{rng.choice(['acme', 'bolt', 'for', 'x'])} thing {i}",
            "category_l1": l1, "category_l2": rng.choice(["a", "b", "c", "d", ""]) if l1 else "",
            "brand": rng.choice(["Acme", "Bolt", "Zed", "Unknown"]),
            "discounted_price": rng.choice([0.0, 90.0, 100.0, 119.99, 120.0, 450.0, 510.0, 1999.0, 2400.0, 12000.0]),
            "rating": rng.choice([None, 3.0, 4.0, 4.5, 5.0]), "rating_count": float(rng.choice([0, 3, 10, 600, 2000])),
            "popularity_score": rng.choice([0.0, 0.1, 0.2, 0.3, 0.9]),
        })
    for r in rows:
        price = r["discounted_price"]
        r["price_bucket"] = next((b for lo, hi, b in settings.PRICE_BUCKETS if lo <= price < hi), "Luxury")
    return rows


SCHEMA = ("product_id string, product_name string, category_l1 string, category_l2 string, brand string, "
          "discounted_price double, rating double, rating_count double, popularity_score double, price_bucket string")


def frame(spark, rows):
    return spark.createDataFrame([tuple(r[c.split()[0]] for c in SCHEMA.split(", ")) for r in rows], SCHEMA)


def lists(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["product_id"], round(r["score"], 6)))
    return out


def brute(rows, match, order, score, k):
    out = {}
    for q in rows:
        found = [(c, match(q, c)) for c in rows if c["product_id"] != q["product_id"]]
        found = sorted((x for x in found if x[1] > 0), key=lambda x: (*order(*x), x[0]["product_id"]))[:k]
        if found:
            out[q["product_id"]] = [(c["product_id"], round(score(c, m), 6)) for c, m in found]
    return out


def category_match(q, c):
    if q["category_l2"] and q["category_l2"] == c["category_l2"]:
        return 1.0
    return 0.6 if q["category_l1"] and q["category_l1"] == c["category_l1"] else 0.0


def price_match(q, c):
    p, x = q["discounted_price"], c["discounted_price"]
    if q["price_bucket"] == c["price_bucket"] and p > 0 and x > 0:
        return 1.0 if abs(x - p) / p <= 0.2 else 0.7
    return 0.4 if settings.ADJACENT_BUCKET.get(q["price_bucket"]) == c["price_bucket"] else 0.0


def bought_match(q, c):
    if q["category_l1"] and q["category_l1"] == c["category_l1"] and q["category_l2"] != c["category_l2"]:
        return 0.85
    return 0.65 if c["category_l1"] in settings.COMPLEMENTS.get(q["category_l1"], []) else 0.0


def best_first(c, m):
    return (-m, -c["popularity_score"])


@pytest.mark.parametrize("seed,k", [(1, 3), (2, 8), (3, 15)])
def test_tiers_match_brute_force(spark, seed, k):
    rows = random_catalogue(seed)
    df = frame(spark, rows)
    q = strategies.as_queries(df)
    blend = lambda a, b: lambda c, m: m * a + c["popularity_score"] * b
    assert lists(strategies.category_similarity(df, q, k)) == brute(rows, category_match, best_first, blend(0.7, 0.3), k)
    assert lists(strategies.price_similarity(df, q, k)) == brute(rows, price_match, best_first, blend(0.65, 0.35), k)
    fbt = blend(0.6, 0.4)
    assert lists(strategies.bought_together(df, q, k)) == brute(
        rows, bought_match, lambda c, m: (-round(fbt(c, m), 9),), fbt, k)


@pytest.mark.parametrize("seed,k", [(4, 3), (5, 12)])
def test_brand_and_popularity_match_brute_force(spark, seed, k):
    rows = random_catalogue(seed)
    df = frame(spark, rows)
    q = strategies.as_queries(df)

    def brand_match(q, c):
        if q["brand"] != "Unknown":
            return float(q["brand"] == c["brand"])
        return float(bool(q["category_l1"]) and q["category_l1"] == c["category_l1"])

    assert lists(strategies.brand_similarity(df, q, k)) == brute(
        rows, brand_match, best_first, lambda c, m: c["popularity_score"] or 0.5, k)
    size = {}
    for r in rows:
        size[r["category_l1"]] = size.get(r["category_l1"], 0) + 1
    shelved = lambda q: q["category_l1"] and size[q["category_l1"]] >= max(3, k)
    popular_match = lambda q, c: float(not shelved(q) or q["category_l1"] == c["category_l1"])
    assert lists(strategies.popularity(df, q, k)) == brute(
        rows, popular_match, best_first, lambda c, m: c["popularity_score"], k)


@pytest.mark.parametrize("seed,k", [(6, 2), (7, 5), (8, 9)])
def test_blend_matches_full_sum(spark, seed, k):
    """The rating signal over the whole catalogue, with lists too short to fill the result."""
    rows = random_catalogue(seed, 30)
    df = frame(spark, rows)
    q = strategies.as_queries(df)
    weights = {"content_based": 0.3, "category_similarity": 0.05, "brand_similarity": 0.02,
               "price_similarity": 0.02, "popularity": 0.01, "rating": 0.6}
    listed = hybrid.normalised(hybrid.run_strategies(df, q, None, k, weights)).collect()
    total = {}
    for r in listed:
        key = (r["query_id"], r["product_id"])
        total[key] = total.get(key, 0.0) + weights[r["strategy"]] * r["norm_score"]
    want = {}
    for a in rows:
        scored = [(-round(total.get((a["product_id"], c["product_id"]), 0.0) + 0.6 * (c["rating"] or 0) / 5, 9), c["product_id"])
                  for c in rows if c["product_id"] != a["product_id"]]
        want[a["product_id"]] = [(i, round(-s, 6)) for s, i in sorted(scored)[:k]]
    assert lists(hybrid.blend(df, q, None, k, weights)) == want


def test_unknown_id_falls_back_to_best_sellers(spark):
    df = frame(spark, random_catalogue(9))
    ids = spark.createDataFrame([("p01",), ("nobody",)], "query_id string")
    got = hybrid.with_unknown(df, ids, None, 4)
    assert {r["query_id"]: r["strategy"] for r in got.collect()} == {"p01": "hybrid", "nobody": "popularity"}


@pytest.mark.parametrize("size", [3, 7, 64])
def test_nearest_in_small_blocks_is_exact(spark, size):
    rng = random.Random(size)
    vecs, rows = {}, []
    for i in range(40):
        terms = sorted(rng.sample(range(30), rng.randint(1, 5))) if i % 4 else [1, 2]
        raw = {t: (rng.choice([1.0, 2.0, 3.0]) if i % 4 else 1.0) for t in terms}
        norm = sum(x * x for x in raw.values()) ** 0.5
        vecs[f"d{i:02d}"] = {t: x / norm for t, x in raw.items()}
        rows.append((f"d{i:02d}", [(t, round(x / norm, 12)) for t, x in raw.items()]))
    df = spark.createDataFrame(rows, "id string, vec array<struct<t:int,w:double>>")
    cos = lambda a, b: round(sum(x * vecs[b].get(t, 0.0) for t, x in vecs[a].items()), 9)
    want = {}
    for a in vecs:
        ranked = sorted((-cos(a, b), b) for b in vecs if b != a and cos(a, b) > 0)[:6]
        if ranked:
            want[a] = [(b, round(-s, 6)) for s, b in ranked]
    got = {}
    distinct, _ = vectors.collapse(df)
    near = vectors.neighbours(df, 6, size=size)
    for r in near.orderBy("src", "rank").collect():
        got.setdefault(r["src"], []).append((r["dst"], round(r["score"], 6)))
    assert got == want
    assert distinct.count() < 40


def test_no_cartesian_products(spark, sf):
    """Rankings are joins on keys; nothing compares every query with every candidate."""
    from aislerank.plans.ranking import COMPLEMENTS, shelf

    df = shelf(spark, sf)
    q = strategies.as_queries(df)
    plans = [
        strategies.category_similarity(df, q, 5), strategies.brand_similarity(df, q, 5),
        strategies.price_similarity(df, q, 5), strategies.popularity(df, q, 5), strategies.trending(df, q, 5),
        strategies.bought_together(df, q, 5, COMPLEMENTS)]
    for plan in plans:
        text = plan._sc._jvm.PythonSQLUtils.explainString(plan._jdf.queryExecution(), "simple")
        assert "CartesianProduct" not in text and "NestedLoop" not in text
        assert "WindowGroupLimit" in text or "TakeOrdered" in text


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_join_equals_plain_join(spark, how):
    from aislerank.operators.skew import salted_join

    left = spark.range(600).select(F.when(F.col("id") < 400, 1).otherwise(F.col("id") % 50).alias("k"), F.col("id").alias("a"))
    right = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 2).alias("b"))
    rows = lambda df: sorted(map(tuple, df.select("k", "a", "b").collect()), key=str)
    assert rows(salted_join(left, right, "k", how, floor=5)) == rows(left.join(right, "k", how))


def test_prices_below_a_cent_and_beyond_a_long(spark):
    rows = random_catalogue(5, 30)
    rng = random.Random(5)
    for r in rows:
        r["discounted_price"] = rng.choice([100.004, 120.0049, 120.0051, 119.996, 1e12, 1.1e12, 3e17])
        r["price_bucket"] = "Luxury"
    df = frame(spark, rows)
    got = lists(strategies.price_similarity(df, strategies.as_queries(df), 6))
    assert len(got) == 30 and all(len({i for i, _ in found}) == 6 for found in got.values())
    shares = {i: r["discounted_price"] for i, r in ((r["product_id"], r) for r in rows)}
    for q, found in got.items():  # the rule is one of whole cents
        near = [i for i, p in shares.items() if i != q and abs(round(p * 100) - round(shares[q] * 100)) <= 0.2 * round(shares[q] * 100)]
        assert len(set(near) & {i for i, _ in found}) == min(6, len(near))


def test_dense_ranking_in_blocks(spark):
    rng = random.Random(6)
    items = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(50)]
    users = [(f"u{i}", [rng.gauss(0, 1) for _ in range(4)]) for i in range(13)]
    norm = lambda v: sum(x * x for x in v) ** 0.5
    got = vectors.dense_ranking(spark.createDataFrame(users, "u string, vector array<double>"),
                                spark.createDataFrame(items, "i long, vector array<double>"), "u", "i", 5, size=6)
    found = {}
    for r in got.collect():
        found.setdefault(r["u"], []).append((r["rank"], r["i"]))
    for u, v in users:
        best = sorted(items, key=lambda e: (-round(sum(a * b for a, b in zip(v, e[1])) / norm(v) / norm(e[1]), 9), e[0]))[:5]
        assert sorted(found[u]) == [(n + 1, i) for n, (i, _) in enumerate(best)]


def nearest_by_hand(rows, k):
    """{id: [(rank, id, score)]} over all pairs, oneself included."""
    found = {}
    for a, v in rows:
        v = dict(v)
        scored = sorted((-round(sum(v.get(t, 0.0) * w for t, w in u), 9), b) for b, u in rows)
        found[a] = [(n + 1, b, -s) for n, (s, b) in enumerate(x for x in scored if x[0] < 0)][: k if isinstance(k, int) else k[a]]
    return found


def sparse_rows(rng, n, terms):
    rows = []
    for i in range(n):
        own = {min(terms - 1, int(rng.expovariate(0.15))): rng.uniform(0.5, 3) for _ in range(rng.randint(1, 9))}
        norm = sum(x * x for x in own.values()) ** 0.5
        rows.append((f"d{i:03d}", [(t, round(x / norm, 12)) for t, x in sorted(own.items())]))
    return rows


@pytest.mark.parametrize("size", [7, 1000])
def test_nearest_by_prefix_index(spark, size):
    """All widths of bands give the lists of all pairs; every source may have a reach of its own."""
    rng = random.Random(size)
    rows = sparse_rows(rng, 150, 30) + [("e1", [(40, 1.0)]), ("e2", [])]
    rows += [(f"copy{i}", rows[0][1]) for i in range(12)]
    df = spark.createDataFrame(rows, "id string, vec array<struct<t:int,w:double>>")
    want = nearest_by_hand([r for r in rows if r[1]], 5)
    for widths in (1, 2, 6):
        scored = nearest.scored(df.withColumn("k", F.lit(5)), df, size, widths)
        got = {}
        for r in vectors.best_per(scored, "src", "score", "dst", 5).collect():
            got.setdefault(r["src"], []).append((r["rank"], r["dst"], r["score"]))
        assert {a: sorted(v) for a, v in got.items()} == want, widths
    own = {a: 1 + i % 7 for i, (a, _) in enumerate(rows)}
    reach = spark.createDataFrame([(a, own[a], v) for a, v in rows], "id string, reach int, vec array<struct<t:int,w:double>>")
    got = {}
    for r in vectors.nearest(reach, df, F.col("reach"), size).collect():
        got.setdefault(r["src"], []).append((r["rank"], r["dst"], r["score"]))
    assert {a: sorted(v) for a, v in got.items()} == nearest_by_hand([r for r in rows if r[1]], own)
    assert vectors.nearest(df.where("id = 'e2'"), df, 3).count() == 0 == vectors.nearest(df, df.where("id = 'e2'"), 3).count()


def test_chunks_and_dense_columns_do_not_change_a_visit(monkeypatch):
    rng = random.Random(3)
    rows = sparse_rows(rng, 60, 12)
    flat = {"id": [a for a, _ in rows], "t": [[t for t, _ in v] for _, v in rows], "w": [[w for _, w in v] for _, v in rows]}
    right = pa.table(flat)
    left = pa.table(flat | {"low": [0.0 if i % 2 else 0.4 for i in range(60)], "k": [1 + i % 9 for i in range(60)]})
    want = [(a, b, s) for i, (a, _) in enumerate(rows) for _, b, s in nearest_by_hand(rows, {x: 1 + n % 9 for n, (x, _) in enumerate(rows)})[a]
            if i % 2 or s >= 0.4]
    for cells, dense in ((1 << 22, 2.0), (100, 0.0), (1, 0.02)):
        monkeypatch.setattr(nearest, "CELLS", cells)
        monkeypatch.setattr(nearest, "DENSE", dense)
        got = nearest.best_of_piece(left, right).to_pydict()
        assert sorted(zip(got["src"], got["dst"], got["score"])) == sorted(want)


def test_pieces_that_cannot_gain_are_not_visited():
    """Clusters with rare terms of their own and a weak common term: with their scores to beat, sources stay in bands of
    their own cluster, and the common term is not indexed at all."""
    bands = nearest.Bands({0: 40, **{t: 10 for t in range(1, 17)}}, 20, 20)
    assert bands.number > 4 and bands.of(np.array([0, 99])).tolist() == [bands.number - 1, -1]
    for cluster in range(4):
        terms = np.array([0, *range(1 + 4 * cluster, 5 + 4 * cluster)])
        weights = np.array([0.05, 0.5, 0.5, 0.5, 0.497])
        met = [b for b, _, _ in bands.prefixes(terms, weights, 0.6)]
        assert met and set(met) <= set(bands.of(terms[1:]).tolist()) and bands.number - 1 not in met
        assert bands.number - 1 in [b for b, _, _ in bands.prefixes(terms, weights, 0.0)]


def test_blocks_share_terms(spark):
    """Four clusters with terms of their own and one weak common term."""
    rng = random.Random(7)
    rows = []
    for i in range(120):
        own = {10 * (i % 4) + t: rng.choice([1.0, 2.0]) for t in rng.sample(range(5), 4)} | {99: 0.05}
        norm = sum(x * x for x in own.values()) ** 0.5
        rows.append((f"d{i:03d}", [(t, x / norm) for t, x in sorted(own.items())]))
    df = spark.createDataFrame(rows, "id string, vec array<struct<t:int,w:double>>")
    own = vectors.in_blocks(df, 15).cache()
    bounds = vectors.block_bounds(own, own).cache()
    cluster = {r["block"]: {int(d[1:]) % 4 for d in r["ids"]} for r in own.groupBy("block").agg(F.collect_list("id").alias("ids")).collect()}
    apart = bounds.where("bound > 0.01").collect()
    assert apart and all(cluster[r["a"]] & cluster[r["b"]] for r in apart) and bounds.count() > len(apart)


@pytest.mark.parametrize("size", [8, 1000])
def test_approximate_neighbours_recall(spark, size):
    """Variants of some texts: at least 0.9 of the pairs at 0.8 or above, with exact scores, the same in each run."""
    rng = random.Random(11)
    rows = []
    for group in range(25):
        base = {rng.randrange(400): rng.uniform(0.5, 3) for _ in range(20)}
        for i in range(8):
            own = {t: w for t, w in base.items() if rng.random() > 0.12} | {rng.randrange(400): rng.uniform(0.5, 2) for _ in range(2)}
            norm = sum(x * x for x in own.values()) ** 0.5
            rows.append((f"g{group:02d}v{i}", [(t, x / norm) for t, x in sorted(own.items())]))
    rows += [("copy", rows[0][1]), ("empty", [])]
    vecs = spark.createDataFrame(rows, "id string, vec array<struct<t: int, w: double>>")
    got = {(r["src"], r["dst"]): r["score"] for r in vectors.approximate_neighbours(vecs, 10, size=size).collect()}
    exact = {(r["src"], r["dst"]): r["score"] for r in vectors.neighbours(vecs, 10).collect()}
    near = {p for p, s in exact.items() if s >= 0.8}
    assert len(near) > 300 and len(near & got.keys()) >= 0.9 * len(near)
    assert got["g00v0", "copy"] == 1.0 and all(abs(got[p] - exact[p]) < 1e-9 for p in got.keys() & exact.keys())
    again = {(r["src"], r["dst"]): r["score"] for r in vectors.approximate_neighbours(vecs, 10, size=size).collect()}
    assert again == got
    assert vectors.approximate_neighbours(vecs.limit(0), 10).count() == 0


class _Map:
    """Stands for a DataFrame and hands out the function that would run on its batches."""

    def mapInArrow(self, function, schema):
        return function


def test_batches_of_placed_rows_are_bounded(monkeypatch):
    """A row goes to every piece of its band, but never are more than about SENT entries held for it at once."""
    from types import SimpleNamespace

    monkeypatch.setattr(nearest, "SENT", 500)
    rows, width = 120, 10
    bands = nearest.Bands({t: rows for t in range(width)}, rows * width, 3, 4)
    bands.cut({(0, 7): (rows, 1.0)}, {0: rows})
    lists = lambda kind, x: pa.array([x] * rows, pa.list_(kind))
    batch = pa.RecordBatch.from_arrays(
        [pa.array([f"d{i:03d}" for i in range(rows)]), lists(pa.int32(), list(range(width))), lists(pa.float64(), [0.316] * width),
         pa.array([0.0] * rows), pa.array([5] * rows, pa.int64())], names=["id", "t", "w", "low", "k"])
    bands.first = {(0, level): bands.first[0, 7] for level in range(nearest.LEVELS)}
    shared = SimpleNamespace(value=bands)
    for rows_of, times in ((nearest.source_rows(_Map(), shared, None), rows // 3), (nearest.candidate_rows(_Map(), shared, 0.0, None), rows // 4)):
        placed = list(rows_of(iter([batch])))
        assert max(len(b.column("t").flatten()) for b in placed) <= 500
        assert sum(b.num_rows for b in placed) == rows * times
        every = pa.Table.from_batches(placed)
        assert len({(r["id"], r["piece"], r["part"]) for r in every.to_pylist()}) == rows * times
        assert all(r["t"] == list(range(width)) for r in every.to_pylist())


def test_tiles_of_a_piece_give_the_lists_of_the_whole(monkeypatch):
    rng = random.Random(4)
    rows = sparse_rows(rng, 60, 12) + [("zz", [(99, 1.0)])]
    flat = {"id": [a for a, _ in rows], "t": [[t for t, _ in v] for _, v in rows], "w": [[w for _, w in v] for _, v in rows]}
    left = pa.table(flat | {"low": [0.0] * 61, "k": [4] * 61})
    monkeypatch.setattr(nearest, "TILE", 7)
    got = nearest.best_of_piece(left, pa.table(flat)).to_pydict()
    want = nearest_by_hand(rows, 4)
    assert sorted(zip(got["src"], got["dst"], got["score"])) == sorted((a, b, s) for a in want for _, b, s in want[a])


def test_blocks_in_parts_are_counted_as_a_whole():
    import pandas as pd

    rng = random.Random(9)
    rows = sparse_rows(rng, 40, 12)
    side = pd.DataFrame({"id": [a for a, _ in rows], "t": [np.array([t for t, _ in v]) for _, v in rows],
                         "w": [np.array([w for _, w in v]) for _, v in rows], "copies": [1 + i % 3 for i in range(40)]})
    left = side.rename(columns={"id": "src"})[["src", "t", "w"]]

    def tally(size):
        found = vectors._tally(5, 0.01, size)(left, side)
        bins = found.groupby("src")["bins"].apply(lambda x: np.stack(x.to_list()).sum(axis=0).tolist())
        sums = found.groupby("src").agg({"partners": "sum", "total": "sum", "best": "max"}).round(9)
        return len(found), sums.to_dict(), bins.to_dict()

    (whole, *want), (parts, *got) = tally(40), tally(7)
    assert whole == 40 and parts == 6 * 40 and got == want


def test_stored_and_cut_leave_no_shuffle_files(spark):
    import glob
    import time

    from aislerank import session

    folders = list(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())
    held = lambda: {f for d in folders for f in glob.glob(f"{d}/**/shuffle_*.data", recursive=True)}
    rows = spark.range(1000).withColumn("k", F.xxhash64("id")).repartition(3, "k")
    for keep in (session.stored, session.cut):
        before, kept = held(), keep(rows)
        for _ in range(50):  # files are removed in the background
            if not held() - before:
                break
            time.sleep(0.2)
        assert not held() - before, keep
        assert kept.count() == 1000 and kept.schema.simpleString() == rows.schema.simpleString()
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_sources_of_a_piece_pass_by_in_bounded_tables(monkeypatch):
    rng = np.random.default_rng(3)

    def rows(piece, side, n):
        out = []
        for i in sorted(f"{j:04d}" for j in range(n)):
            t = sorted(rng.choice(12, 4, replace=False).tolist())
            out.append({"piece": piece, "part": 0, "id": i, "t": t, "w": rng.random(4).tolist(), "low": 0.3, "k": 3, "side": side})
        return out

    schema = pa.schema([("piece", pa.int64()), ("part", pa.int64()), ("id", pa.string()), ("t", pa.list_(pa.int32())),
                        ("w", pa.list_(pa.float64())), ("low", pa.float64()), ("k", pa.int64()), ("side", pa.int64())])
    kinds = [rows(0, 0, 30), rows(0, 1, 200), rows(1, 1, 5), rows(2, 0, 9), rows(3, 0, 50), rows(3, 1, 90)]
    whole = pa.Table.from_pylist([r for kind in kinds for r in kind], schema)
    monkeypatch.setattr(nearest, "TILE", 16)
    met, best = [], nearest._best_of_sorted
    monkeypatch.setattr(nearest, "_best_of_sorted", lambda left, right: (met.append(left.num_rows), best(left, right))[1])
    got = sorted((r["src"], r["dst"], r["score"]) for b in nearest.visits(iter(whole.to_batches(7))) for r in b.to_pylist())
    assert max(met) < 2 * nearest.TILE + 7 and sum(met) == 290
    want = []
    for sources, candidates in ((kinds[1], kinds[0]), (kinds[5], kinds[4])):
        found = best(pa.Table.from_pylist(sources, schema), pa.Table.from_pylist(candidates, schema))
        want += [(r["src"], r["dst"], r["score"]) for r in found.to_pylist()]
    assert got == sorted(want)


def test_price_lists_are_not_repeated_for_every_query(spark, sf, monkeypatch):
    """A price band serves about one query: it is not dealt out over 16 tasks as the list of a large group is."""
    from aislerank.plans.ranking import shelf

    keys, attach = [], strategies.L.attach

    def noted(queries, lists, key, alias, *rest, few=False):
        keys.append((key, few))
        return attach(queries, lists, key, alias, *rest, few=few)

    monkeypatch.setattr(strategies.L, "attach", noted)
    df = shelf(spark, sf)
    assert strategies.price_similarity(df, strategies.as_queries(df), 5).count() > 0
    assert sorted(keys) == [("beside", True), ("bucket", True)]


def test_the_described_catalogue_is_read_by_column_and_its_lines_once(spark, sf):
    """Strategies read a few columns many times: the texts on the way are not kept, the last one is a column of its own."""
    from aislerank.plans.similarity import described
    from aislerank.sources.driver_tables import catalogue

    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "l_returnflag" not in plan(catalogue(spark, sf, text=False))
    df = described(spark, sf)
    assert "combined_text_tfidf" in df.columns and not {"about_product", "combined_text", "about_product_clean"} & set(df.columns)
    assert df.inputFiles()
    narrow = df.select("product_id", "rating")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<product_id:string,rating:double>" in narrow


def test_a_visit_is_exact_with_equal_scores_and_any_sign(monkeypatch):
    """Scores in single precision only choose what is scored again, however many are equal or cancel."""
    rng = random.Random(6)
    rows = sparse_rows(rng, 50, 9) + [(f"same{i:02d}", [(1, 0.6), (2, 0.8)]) for i in range(40)]
    rows += [(f"near{i:02d}", [(1, 0.6), (2, 0.8 + i * 1e-8)]) for i in range(20)]
    rows += [(f"sign{i}", [(1, 0.5), (3, -0.5 + 0.01 * i)]) for i in range(9)]
    flat = {"id": [a for a, _ in rows], "t": [[t for t, _ in v] for _, v in rows], "w": [[w for _, w in v] for _, v in rows]}
    left, want = pa.table(flat | {"low": [0.0] * len(rows), "k": [3] * len(rows)}), nearest_by_hand(rows, 3)
    for many, tile, opened in ((1, 16, 1), (4, 2048, 1 << 17)):
        monkeypatch.setattr(nearest, "MANY", many)
        monkeypatch.setattr(nearest, "TILE", tile)
        monkeypatch.setattr(nearest, "OPENED", opened)
        got = nearest.best_of_piece(left, pa.table(flat)).to_pydict()
        assert sorted(zip(got["src"], got["dst"], got["score"])) == sorted((a, b, s) for a in want for _, b, s in want[a])


def test_few_pairs_are_multiplied_in_double_precision(monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(f"d{i:03d}", [(int(t), float(w)) for t, w in zip(np.sort(rng.choice(60, 12, replace=False)), rng.random(12) / 3.5)]) for i in range(300)]
    flat = {"id": [a for a, _ in rows], "t": [[t for t, _ in v] for _, v in rows], "w": [[w for _, w in v] for _, v in rows]}
    pairs, products = [], nearest._products
    monkeypatch.setattr(nearest, "_products", lambda rows, *rest: (pairs.append(len(rows)), products(rows, *rest))[1])
    got = nearest.best_of_piece(pa.table(flat | {"low": [0.0] * 300, "k": [5] * 300}), pa.table(flat))
    assert got.num_rows == 1500 and sum(pairs) < 2 * 1500


def test_pieces_visited_in_rounds_give_the_same_lists(spark, monkeypatch):
    rng = random.Random(2)
    rows = sparse_rows(rng, 120, 30)
    df = spark.createDataFrame(rows, "id string, vec array<struct<t:int,w:double>>").cache()
    travelled, meet = [], nearest._meet
    monkeypatch.setattr(nearest, "_meet", lambda sources, candidates: (travelled.append(1), meet(sources, candidates))[1])
    monkeypatch.setattr(nearest, "ENTRIES", 200)
    monkeypatch.setattr(nearest, "ROUND", 1)
    got = {}
    for r in vectors.best_per(nearest.scored(df.withColumn("k", F.lit(5)), df, 7, 1), "src", "score", "dst", 5).collect():
        got.setdefault(r["src"], []).append((r["rank"], r["dst"], r["score"]))
    assert {a: sorted(v) for a, v in got.items()} == nearest_by_hand(rows, 5)
    assert len(travelled) > 2


def test_rounds_hold_every_piece_once_and_little_more_than_all_rows():
    n, entries = 10_000, 1_000_000
    bands = nearest.Bands({t: n for t in range(100)}, n * 100, 500, 1000)
    bands.cut({(0, 7): (n, 1.0)}, {0: n})
    nearest_round, nearest.ROUND = nearest.ROUND, 1
    try:
        rounds = bands.rounds({0: n}, ((n, entries), (n, entries)), 4)
    finally:
        nearest.ROUND = nearest_round
    assert [p for r in rounds for p in r] == list(range(20)) and len(rounds) > 5
    assert bands.rounds({0: n}, ((n, entries), (n, entries)), 4) == [range(20)]


def test_the_words_are_gone_once_the_vectors_are_there(spark):
    import glob

    from aislerank.session import shared_folder

    folder = shared_folder(spark).removeprefix("file:")
    before = set(glob.glob(f"{folder}/*"))
    docs = spark.createDataFrame([(f"d{i}", f"red kettle steel lid{i % 3} handle") for i in range(9)], "product_id string, combined_text_tfidf string")
    vocab, vecs = vectors.fit(docs)
    assert vecs.count() == 9 and vocab.count() > 5
    left = [spark.read.parquet(p).columns for p in set(glob.glob(f"{folder}/*")) - before if p.split("/")[-1].startswith(("stored", "passing"))]
    assert left == [["id", "vec"]]
