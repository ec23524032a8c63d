"""Learned models on held-out rows, the splitting tree, and the bit-sliced index against plain products."""

import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from aislerank.llm import bitslice, language, mixing, toxicity
from aislerank.llm.common import row_keyed
from conftest_llm import ODD


# ---------------------------------------------------------------- language


def test_languages_on_held_out_documents(spark, docs_of):
    rng = random.Random(2)
    syllables = {"en": "th er in on ed ing ly", "de": "sch ung ein ach ich keit", "fr": "eau eux ment tion elle que", "es": "ción ado ez los mente rr"}
    rows = []
    for i in range(400):
        lang = rng.choice(sorted(syllables))
        part = syllables[lang].split()
        rows.append((i, " ".join("".join(rng.choice(part) for _ in range(3)) for _ in range(30)), lang, "s"))
    rows += [(9000 + n, *row[1:]) for n, row in enumerate(ODD)]
    docs = docs_of(rows)
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    got = {r.doc_id: r for r in language.predictions(docs, language.model(docs, ~held)).collect()}
    assert len(got) == len(rows)
    unseen = [(i, lang) for i, _, lang, _ in rows if i < 9000 and zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum(got[i].lang_pred == lang for i, lang in unseen) >= 0.98 * len(unseen)
    assert all(0 <= r.score <= 1 for r in got.values())
    assert [n for n in range(len(ODD)) if got[9000 + n].lang_pred == "und"] == [3, 4, 5, 7]


def test_no_labels_and_empty_tables(docs_of):
    docs = docs_of([(1, "text", None, None), (2, None, None, None)])
    model = language.model(docs, F.lit(True))
    assert [r.lang_pred for r in language.predictions(docs, model).collect()] == ["und", "und"]
    none = docs.where("doc_id > 5")
    assert language.predictions(none, model).count() == 0


def test_features_of_pieces_are_those_of_the_whole(monkeypatch):
    text = "Überlegung über alles " * 50
    whole = language.features(text)
    monkeypatch.setattr(language, "_PIECE", 7)
    assert np.allclose(whole, language.features(text))


# ---------------------------------------------------------------- toxicity


def test_toxicity_on_held_out_documents(docs_of, spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    rows, labels = [], []
    for i in range(900):
        text = [rng.choice(words) for _ in range(60)]
        toxic = i % 5 == 0
        for _ in range(4 if toxic else 0):
            text[rng.randrange(60)] = rng.choice(["vile", "rotten"])
        rows.append((i, " ".join(text), "en", "s"))
        labels.append((i, None if i == 7 else int(toxic)))
    rows += [(9000 + n, *row[1:]) for n, row in enumerate(ODD)]
    docs, known = docs_of(rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    weights = toxicity.fit(toxicity.sample(docs, known, F.crc32(F.col("doc_id").cast("string")) % 3 != 1)).cache()
    got = {r.doc_id: r.score for r in toxicity.scores(docs, weights, ["doc_id"]).collect()}
    assert len(got) == len(rows) and all(0 <= s <= 1 for s in got.values())
    unseen = [i for i in range(900) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert not any(got[i] >= toxicity.THRESHOLD for i in unseen if i % 5)
    assert np.mean([got[i] >= toxicity.THRESHOLD for i in unseen if i % 5 == 0]) >= 0.9
    # two words tell the classes apart, so the L1 pull may leave these two alone, but not fewer
    assert 2 <= weights.where("weight <> 0 and index >= 0").count() < 100
    assert toxicity.scores(docs_of([]), weights, ["doc_id"]).count() == 0
    nothing = toxicity.fit(toxicity.sample(docs, known.where("doc_id < 0"), F.lit(True)))
    assert {r.score for r in toxicity.scores(docs, nothing, ["doc_id"]).collect()} == {0.5}


def test_toxicity_that_only_a_skip_gram_shows(docs_of, spark):
    """Both words are common everywhere; toxic texts have them in this order with one word between."""
    rng = random.Random(9)
    words = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(900):
        text = [rng.choice(words) for _ in range(60)]
        for at in rng.sample(range(0, 57, 3), 6):
            if i % 4 == 0:
                text[at], text[at + 2] = "you", "die"
            else:
                text[at], text[at + 1 + rng.randrange(2) * 1] = rng.choice([("die", "you"), ("you", "die")])
                if text[at] == "you" and text[at + 2] == "die":
                    text[at + 2] = "live"
        rows.append((i, " ".join(text), "en", "s"))
        labels.append((i, int(i % 4 == 0)))
    docs, known = docs_of(rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    weights = toxicity.fit(toxicity.sample(docs, known, F.crc32(F.col("doc_id").cast("string")) % 3 != 1)).cache()
    got = {r.doc_id: r.score for r in toxicity.scores(docs, weights, ["doc_id"]).collect()}
    unseen = [i for i in range(900) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([(got[i] >= toxicity.THRESHOLD) == (i % 4 == 0) for i in unseen]) >= 0.95
    skip = int(toxicity.gram_hashes("you x die")[-1])
    assert weights.where(F.col("index") == skip).first().weight > 0


def test_sample_takes_one_row_of_an_id(docs_of, spark):
    docs = docs_of([(1, f"text {i % 3}", "en", "s") for i in range(400)] + [(2, "two", "en", "s"), (None, "x", "en", "s")])
    known = spark.createDataFrame([(1, 1), (2, 0), (None, 1)], "doc_id long, toxic int")
    assert sorted(r.doc_id for r in toxicity.sample(docs, known, F.lit(True)).collect()) == [1, 2]
    assert sorted(r.doc_id for r in language.sample(docs, F.lit(True)).collect()) == [1, 2]


# ---------------------------------------------------------------- mixing


def targets(size):
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    found, rest, left = {}, set(names), float(sum(size.values()))
    while rest:
        share = left / sum(weight[s] for s in rest)
        over = [s for s in rest if share * weight[s] > 3 * size[s]]
        if not over:
            return found | {s: share * weight[s] for s in rest}
        for s in over:
            found[s] = 3.0 * size[s]
            left -= found[s]
            rest.discard(s)
    return found


def test_mix_meets_targets(docs_of, spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, " ".join(["w"] * rng.randint(1, 60)), "en", rng.choice(["a"] * 6 + ["b", "c", None, "d" if i < 9 else "a"]))
            for i in range(1500)]
    rows += [(9000 + n, *row[1:]) for n, row in enumerate(ODD[:6])]
    docs_of(rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = mixing.op3_hypergeometric_tree(spark, str(tmp_path)).collect()
    sizes = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _, _ in rows}
    source = {i: s for i, _, _, s in rows}
    total = {}
    for i, n in sizes.items():
        total[source[i]] = total.get(source[i], 0) + n
    want, taken = targets(total), dict.fromkeys(total, 0)
    assert len(got) == len(rows)
    for r in got:
        s = source[r.doc_id]
        assert (r.size, r.source_size) == (sizes[r.doc_id], total[s]) and abs(r.target - want[s]) < 1e-6 * max(1, want[s])
        assert r.taken % max(1, r.size) == 0 and r.taken <= 3 * r.size and len(r.shards) * r.size >= r.taken
        taken[s] += r.taken
    assert all(abs(taken[s] - want[s]) <= 60 for s in want)
    again = mixing.op3_hypergeometric_tree(spark, str(tmp_path)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_splitting_tree_is_exact(spark):
    counts = np.array([1000, 0, 37, 5003])
    leaves = sorted((f, n, c, a) for f, n, c, a in ((f, n, tuple(c), tuple(a)) for f, n, c, a in mixing.split(counts, 40, 0, 30)))
    assert [f for f, _, _, _ in leaves] == list(range(40))
    ahead = np.zeros(4, int)
    for _, _, c, a in leaves:  # ranges of a source follow each other without gap or overlap
        assert tuple(ahead) == a
        ahead += c
        assert abs(sum(c) - counts.sum() / 40) <= 6
    assert (ahead == counts).all()
    totals = spark.createDataFrame([(n, int(c)) for n, c in enumerate(counts) if c], "number long, draws long")
    quotas = mixing.shard_quotas(totals, 150).toPandas()
    assert quotas.groupby("number")["count"].sum().tolist() == [1000, 37, 5003] and quotas["shard"].nunique() == 150


def test_draws_beyond_the_librarys_bound():
    rng = np.random.default_rng(5)
    for n, rest, need in ((4, 3 * 10**9, 10**9), (2 * 10**9, 7, 10**9), (3 * 10**9, 5 * 10**9, 2 * 10**9), (10**10, 10**10, 5)):
        drawn = [mixing.drawn(rng, n, rest, need) for _ in range(300)]
        assert all(max(0, need - rest) <= d <= min(n, need) for d in drawn)
        mean = need * n / (n + rest)
        sd = (mean * rest / (n + rest) * (n + rest - need) / (n + rest - 1)) ** 0.5
        assert abs(np.mean(drawn) - mean) <= 5 * sd / 300**0.5 + 1e-6 * mean
    counts = np.array([4 * 10**9, 3, 0, 9 * 10**9])
    leaves = list(mixing.split(counts, 8, 0, 30))
    assert len(leaves) == 8 and (sum(c for _, _, c, _ in leaves) == counts).all()
    assert all(abs(c.sum() - counts.sum() / 8) <= 8 for _, _, c, _ in leaves)


def test_repeated_rows_are_dealt_apart(docs_of):
    docs = docs_of([(1, "same text here", "en", "a")] * 500 + [(i, f"text {i}", "en", "a") for i in range(2, 40)]).repartition(5)
    rows, key = row_keyed(docs)
    orders = [r.order for r in mixing.hashed_rows(rows, key).collect()]
    assert len(orders) == 538 and len(set(orders)) == 538
    again, key = row_keyed(docs.repartition(3))
    assert sorted(orders) == sorted(r.order for r in mixing.hashed_rows(again, key).collect())


def test_mix_of_nothing(docs_of):
    for rows in ([], [(1, None, None, None), (2, "", None, "a")]):
        taken, account = mixing.mix(*row_keyed(docs_of(rows)))
        assert taken.count() == 0 and account.count() == len(rows)


# ---------------------------------------------------------------- bit slices


def test_slices_add_and_select_exactly():
    rng = np.random.default_rng(0)
    for rows, dims, most in ((5, 3, 10), (200, 8, 300), (700, 16, 300), (130, 4, 1 << 25)):
        vectors = rng.integers(-most, most + 1, (rows, dims))
        vectors[rng.random(rows) < 0.3] = vectors[0]
        index = bitslice.Slices(vectors)
        for turn in range(8):
            query = vectors[rng.integers(rows)] if turn % 2 else rng.integers(-most, most + 1, dims)
            sums, base = index.sums(query)
            total = sum(np.unpackbits(m.view(np.uint8), bitorder="little")[:rows].astype(object) << p for p, m in enumerate(sums))
            assert (total + base == (vectors >> bitslice.DROPPED) @ query).all()
            found, scores = index.nearest(query, 10)
            exact = vectors @ query
            assert (scores == exact[found]).all()
            assert set(np.lexsort((np.arange(rows), -exact))[:10]) <= set(found.tolist())


def test_search_against_all_products(spark):
    rng = np.random.default_rng(3)
    vectors = np.round(rng.normal(0, 0.2, (600, 6)), 2).astype(np.float32)
    vectors[100:300] = vectors[0]  # many ties
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    rows += [(1000, None), (1001, [None] * 6), (1100, [float("nan")] * 6), (1200, [float("inf")] * 6), (None, [0.1] * 6),
             (1300, []), (1400, [1.0, 2.0]), (1500, [0.5, -2.0]), (0, vectors[5].tolist()), (1600, [1e30] * 6)]
    rows += [(1601, [1e15, 0.5, 0.0, 0.0, 0.0, 0.0]), (1602, [-1e15, 0.25, 0.0, 0.0, 0.0, 0.0]), (1603, [70000.0, 0.0, 0.0, 0.0, 0.0, 1.0])]
    table = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<float>, score int")
    used = [(i, tuple(int(np.floor(1024 * float(np.float32(x)))) for x in v)) for i, v in rows
            if i is not None and v and i not in (1001, 1100, 1200)]
    held = bitslice.integers(table).cache()
    got = {}
    for r in bitslice.search(held.where("vec_id % 100 = 0"), held, query_bytes=200, block_rows=100).collect():
        got.setdefault(r.query_id, []).append((r["rank"], -r.score, r.vec_id))
    for q, x in used:
        if q % 100 or q == 0:  # id 0 comes twice
            continue
        scored = sorted((max(-(2**63 - 1), min(2**63, -sum(a * b for a, b in zip(x, y)))), i)
                        for i, y in used if i != q and len(y) == len(x))[:10]
        assert sorted(got.get(q, [])) == [(n + 1, s, i) for n, (s, i) in enumerate(scored)], q
    none = held.where("vec_id < 0")
    assert bitslice.search(none, none).count() == 0
