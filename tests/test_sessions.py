"""Events and personalisation."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from aislerank.operators import features, interactions, personal, vectors
from aislerank.settings import SessionModel, TextModel
from aislerank.streaming import jobs

EVENT = "event_id bigint, session_id string, product_id string, event_type string, us bigint"


def event_frame(spark, rows):
    return spark.createDataFrame(rows, EVENT).withColumn("ts", F.timestamp_micros("us"))


def client_rule(rows, gap_us):
    """What the shop's client does, one event after the other."""
    kept = {}
    for _, session, product, kind, us in sorted(rows, key=lambda r: (r[4], r[0])):
        stored = kept.setdefault(session, [])
        last = stored[-1] if stored else None
        if (kind == "view" and last and last[0] == product and last[1] in ("view", "repeat_view")
                and us - last[2] < gap_us):
            stored[-1] = (product, "repeat_view", us)
        else:
            stored.append((product, kind, us))
    return sorted((s, *e) for s, events in kept.items() for e in events)


@pytest.mark.parametrize("seed,gap", [(1, 60), (2, 60), (3, 4000)])
def test_repeat_views_follow_the_client_rule(spark, seed, gap):
    rng = random.Random(seed)
    rows = [(i, f"s{rng.randint(0, 2)}", rng.choice("ab"), rng.choice(["view", "view", "cart"]),
             rng.randint(0, 3 * 3600) * 1_000_000 * (gap // 60 if gap > 60 else 1)) for i in range(300)]
    # A burst right across the edges of the time slices.
    rows += [(1000 + i, "s9", "a", "view", 3_600_000_000 * 5 - 90_000_000 + i * 30_000_000) for i in range(9)]
    got = interactions.collapse_repeat_views(event_frame(spark, rows), gap).collect()
    assert sorted((r["session_id"], r["product_id"], r["event_type"], r["us"]) for r in got) == client_rule(rows, gap * 1_000_000)


def test_streamed_repeat_views_share_states_between_sessions(spark, tmp_path):
    """Files in the order of time, one per micro-batch; sessions pass the hour that the watermark waits."""
    rng = random.Random(4)
    rows = [(i, f"s{rng.randint(0, 39)}", rng.choice("ab"), rng.choice(["view", "view", "view", "cart"]),
             rng.randint(1, 6 * 3600) * 1_000_000) for i in range(1500)]
    for n, edge in enumerate((2, 4, 6)):
        part = [r for r in rows if edge - 2 <= (r[4] - 1) // 3_600_000_000 < edge]
        event_frame(spark, part).coalesce(1).write.parquet(str(tmp_path / f"in/part={n}"))
    kept = spark.read.parquet(str(tmp_path / "in")).drop("part")
    stream = (spark.readStream.schema(kept.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True)
              .parquet(str(tmp_path / "in")))
    handle = (jobs.repeat_views(stream, 600, buckets=3).writeStream.option("checkpointLocation", str(tmp_path / "progress"))
              .trigger(availableNow=True).foreachBatch(lambda batch, n: batch.write.parquet(str(tmp_path / f"out/batch={n}"))).start())
    handle.awaitTermination()
    states = [s["numRowsTotal"] for p in handle.recentProgress for s in p["stateOperators"]]
    assert 0 < max(states) <= 3
    got = sorted((r["session_id"], r["product_id"], r["event_type"], r["us"])
                 for r in spark.read.parquet(str(tmp_path / "out")).collect())
    # The last hour is not closed, and the newest event of a session waits for what may merge into it.
    mark = max(r[4] for r in rows) - 3_600_000_000
    closed = client_rule([r for r in rows if r[4] < mark], 600_000_000)
    newest = {s: max(us for t, *_, us in closed if t == s) for s, *_ in closed}
    assert got == [e for e in closed if e[3] < newest[e[0]] or e[3] + 600_000_000 <= mark]
    assert any(e[2] == "repeat_view" for e in got) and len(got) < len(closed)


def test_positions_number_each_session(spark):
    rng = random.Random(5)
    rows = [(i, f"s{i % 3}", "a", "view", rng.randint(0, 10 * 86400) * 1_000_000) for i in range(200)]
    got = {(r["session_id"], r["event_id"]): r["position"] for r in interactions.positions(event_frame(spark, rows)).collect()}
    for s in ("s0", "s1", "s2"):
        mine = sorted((r for r in rows if r[1] == s), key=lambda r: (-r[4], -r[0]))
        assert [got[s, r[0]] for r in mine] == list(range(len(mine)))


def test_validation_and_lists(spark):
    df = event_frame(spark, [(1, "s", " p1 ", " CART ", 1), (2, "s", "p2", "hover", 2), (3, "s", "  ", "view", 3)])
    got = [(r["product_id"], r["event_type"]) for r in interactions.validated(df).orderBy("event_id").collect()]
    assert got == [("p1", "cart"), ("p2", "view")]
    times = spark.createDataFrame([("2024-01-02T03:04:05Z",), ("1704164645",), ("1704164645000",), ("soon",)], "t string")
    seconds = [r[0] for r in times.select(F.unix_seconds(interactions.event_time(F.col("t")))).collect()]
    assert seconds == [1704164645, 1704164645, 1704164645, None]


def test_wishlist_toggles_and_cart_keeps_last_action(spark):
    df = event_frame(spark, [
        (1, "s", "a", "wishlist", 1), (2, "s", "a", "wishlist", 2), (3, "s", "b", "wishlist", 3),
        (4, "s", "c", "cart", 4), (5, "s", "d", "cart", 5)])
    removed = event_frame(spark, [(9, "s", "c", "x", 9)]).select("session_id", "product_id", "ts")
    assert [r["product_id"] for r in interactions.wishlist(df).collect()] == ["b"]
    assert [r["product_id"] for r in interactions.cart(df, removed).collect()] == ["d"]


# Five products; plain words, no pairs.
SHELF = [
    ("COFFEE", "Espresso Coffee Maker", "espresso coffee maker brewer machine barista", "Kitchen", "Coffee Makers", 4.5),
    ("LAPTOP", "Gaming Laptop", "gaming laptop keyboard mouse graphics processor", "Electronics", "Laptops", 4.2),
    ("YOGA", "Yoga Mat", "yoga mat exercise fitness stretching pilates", "Sports", "Fitness", 4.0),
    ("COFFEE2", "Coffee Grinder", "espresso coffee grinder burr barista beans", "Kitchen", "Coffee Makers", 4.4),
    ("MOUSE", "Gaming Mouse", "gaming mouse laptop keyboard rgb precision", "Electronics", "Laptops", 4.1),
]


@pytest.fixture(scope="module")
def shelf(spark):
    df = spark.createDataFrame(SHELF, "product_id string, product_name string, combined_text string, category_l1 string, category_l2 string, rating double")
    df = df.withColumns({
        "category": F.concat_ws("|", "category_l1", "category_l2"), "brand": F.lit("Unknown"), "discounted_price": F.lit(10.0),
        "price_bucket": F.lit("Budget"), "rating_count": F.lit(100.0)})
    df = features.add_trend(features.add_popularity(df))
    _, vecs = vectors.fit(df, text_column="combined_text", model=TextModel(min_df=1, max_df=1.0, bigrams=False), stops=())
    return df, vecs


def history_of(spark, shelf, *items):
    rows = [(i, "s", p, kind, 1_000_000 * (100 - i)) for i, (p, kind) in enumerate(items)]
    return personal.history(event_frame(spark, rows), shelf[0])


def profile_scores(spark, shelf, *items):
    hist = history_of(spark, shelf, *items)
    prof = {e["t"]: e["w"] for e in personal.profiles(hist, shelf[1]).first()["vec"]}
    return {r["id"]: sum(prof.get(e["t"], 0.0) * e["w"] for e in r["vec"]) for r in shelf[1].collect()}


def test_newer_item_weighs_more_and_purchase_beats_recency(spark, shelf):
    scores = profile_scores(spark, shelf, ("COFFEE", "view"), ("LAPTOP", "view"))
    assert scores["COFFEE"] > scores["LAPTOP"] > scores["YOGA"]
    scores = profile_scores(spark, shelf, ("LAPTOP", "view"), ("COFFEE", "purchase"))
    assert scores["COFFEE"] > scores["LAPTOP"]


def test_item_weight_is_base_times_decay(spark, shelf):
    hist = history_of(spark, shelf, ("COFFEE", "cart"), ("YOGA", "repeat_view"), ("NOPE", "view"), ("MOUSE", "purchase"))
    got = {r["product_id"]: r["weight"] for r in personal.item_weights(hist).collect()}
    assert got == pytest.approx({"COFFEE": 3.0, "YOGA": 1.5 * 0.85, "MOUSE": 5.0 * 0.85**2})


@pytest.mark.parametrize("events,mode,signal", [
    ([], "cold_start", None),
    ([("COFFEE", "view"), ("YOGA", "view")], "personalized", "view"),
    ([("COFFEE", "view"), ("YOGA", "wishlist"), ("MOUSE", "cart")], "personalized", "cart"),
    ([("COFFEE", "purchase")], "personalized", "purchase"),
    ([("NOPE", "view")], "cold_start", None),
])
def test_scenarios(spark, shelf, events, mode, signal):
    rows = [(i, "s", p, kind, 1_000_000 * (100 - i)) for i, (p, kind) in enumerate(events)]
    frame = event_frame(spark, rows)
    sessions = spark.createDataFrame([("s",)], "session_id string")
    got = personal.recommend_sessions(frame, sessions, *shelf, k=3).collect()
    assert got and {r["mode"] for r in got} == {mode}
    assert sorted(r["rank"] for r in got) == list(range(1, len(got) + 1))
    if mode == "personalized":
        assert not {r["product_id"] for r in got} & {p for p, _ in events}
    if signal:
        assert personal.dominant_signal(history_of(spark, shelf, *events)).first()["dominant_signal"] == signal


def test_mmr_prefers_a_different_second_item():
    similarity = np.array([[0, .95, .10], [.95, 0, .12], [.10, .12, 0]])
    assert personal.greedy_mmr(np.array([.90, .89, .70]), similarity, 2, 0.0) == [0, 2]
    for lam in (0.0, 0.6, 1.0):
        assert personal.greedy_mmr(np.array([.9, .8, .5]), similarity, 1, lam) == [0]


def test_mmr_job_matches_direct_rule(spark):
    rng = random.Random(3)
    vecs = []
    for i in range(12):
        raw = {t: rng.random() for t in rng.sample(range(9), 4)}
        norm = sum(x * x for x in raw.values()) ** 0.5
        vecs.append((f"p{i:02d}", sorted((t, x / norm) for t, x in raw.items())))
    rel = sorted((round(rng.random(), 6) for _ in vecs), reverse=True)
    df = spark.createDataFrame(vecs, "id string, vec array<struct<t:int,w:double>>")
    pool = spark.createDataFrame(
        [("s", v[0], r, i + 1) for i, (v, r) in enumerate(zip(vecs, rel))], "session_id string, product_id string, score double, rank bigint")
    got = [r["product_id"] for r in personal.mmr(pool, df, 5).orderBy("rank").collect()]
    cos = lambda a, b: sum(x * dict(vecs[b][1]).get(t, 0.0) for t, x in vecs[a][1])
    chosen = [0]
    while len(chosen) < 5:
        rest = [i for i in range(12) if i not in chosen]
        chosen.append(max(rest, key=lambda i: (0.6 * rel[i] - 0.4 * max(cos(i, j) for j in chosen), -i)))
    assert got == [vecs[i][0] for i in chosen]


def test_text_weights_follow_the_formula(spark):
    import math

    docs = spark.createDataFrame([("a", "red red bolt"), ("b", "red gear"), ("c", "blue gear gear")], "product_id string, text string")
    vocab, vecs = vectors.fit(docs, text_column="text", model=TextModel(min_df=1, max_df=1.0), stops=())
    names = {r["t"]: r["term"] for r in vocab.collect()}
    got = {names[e["t"]]: e["w"] for e in vecs.filter("id = 'a'").first()["vec"]}
    idf = lambda df: math.log((1 + 3) / (1 + df)) + 1
    raw = {"red": (1 + math.log(2)) * idf(2), "bolt": idf(1), "red red": idf(1), "red bolt": idf(1)}
    norm = math.sqrt(sum(x * x for x in raw.values()))
    assert got == pytest.approx({t: x / norm for t, x in raw.items()})


def test_modes_show_the_reranked_picks(spark, sf):
    from aislerank.plans import sessions

    keys = ["query_id", "product_id", "rank", "score"]
    asked = {str(r[0]) for r in spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey").collect()}
    picks = {(r["session_id"], r["product_id"], r["rank"], r["score"]) for r in sessions.p7(spark, sf).collect()}
    got = sessions.p10(spark, sf).filter("mode = 'personalized'").select(*keys).collect()
    assert got and {tuple(r) for r in got} == {p for p in picks if p[0] in asked}
    rows = {(r["query_id"], r["product_id"], r["rank"]) for r in sessions.p11(spark, sf).collect()}
    assert {p[:3] for p in picks if p[0] in asked} <= rows


def test_holdout_recommends_from_the_whole_catalogue(spark, sf):
    from aislerank.plans import measuring
    from aislerank.plans.ranking import shelf

    best = shelf(spark, sf).orderBy(F.desc("trending_score"), "product_id").limit(8)
    want = {r["product_id"] for r in best.collect()}
    recs = measuring.holdout(spark, sf)[3].filter("scenario = 'trending'")
    assert {r["product_id"] for r in recs.select("product_id").distinct().collect()} == want


def test_pool_of_each_session_has_its_own_reach(spark):
    """Against all products; one session has seen most of the catalogue, which leaves the others' fetches as they are."""
    rng = random.Random(12)
    vecs = []
    for i in range(90):
        own = {rng.randrange(12): rng.uniform(0.5, 2) for _ in range(4)}
        norm = sum(x * x for x in own.values()) ** 0.5
        vecs.append((f"p{i:02d}", [(t, round(x / norm, 12)) for t, x in sorted(own.items())]))
    vecs += [(f"q{i:02d}", vecs[3][1]) for i in range(30)]  # copies of one text
    seen = {"long": [v for v, _ in vecs[:80]], "short": ["p03", "p10"], "copies": ["q01", "q02", "p05"], "none": []}
    profiles = [(s, vecs[n * 7 + 3][1]) for n, s in enumerate(sorted(seen))]
    vec = "array<struct<t:int,w:double>>"
    prof, table = spark.createDataFrame(profiles, f"id string, vec {vec}"), spark.createDataFrame(vecs, f"id string, vec {vec}")
    hist = spark.createDataFrame([(s, p) for s, ps in seen.items() for p in ps], "session_id string, product_id string")
    got = {}
    for r in personal.candidate_pool(prof, table, hist, 6).collect():
        got.setdefault(r["session_id"], []).append((r["rank"], r["product_id"], r["score"]))
    for session, v in profiles:
        v = dict(v)
        scored = sorted((-round(sum(v.get(t, 0.0) * w for t, w in u), 9), p) for p, u in vecs if p not in seen[session])
        assert sorted(got.get(session, [])) == [(n + 1, p, -s) for n, (s, p) in enumerate(x for x in scored if x[0] < 0)][:6]
    fetched = {}
    for r in personal.reached(prof, table, hist, 6).collect():
        fetched[r["src"]] = fetched.get(r["src"], 0) + len(r["ids"])
    assert fetched["short"] < 2 * (6 + 2) and fetched["long"] >= 86


def test_profile_of_a_long_session_in_slices(spark, monkeypatch):
    """Vectors travel whole and in slices; the sums are those of all (weight, term) rows."""
    rng = random.Random(2)
    vecs = {f"p{i}": {t: round(rng.uniform(0.1, 1), 6) for t in rng.sample(range(20), 4)} for i in range(30)}
    hist = [("long", f"p{i}", "view", i) for i in range(25)] + [("short", f"p{i}", "cart", i - 20) for i in range(20, 23)]
    frame = spark.createDataFrame(hist, "session_id string, product_id string, event_type string, position long")
    rows = spark.createDataFrame([(p, sorted(v.items())) for p, v in vecs.items()], "id string, vec array<struct<t:int,w:double>>")
    monkeypatch.setattr(personal, "SLICE", 4)
    profile = personal.profiles(frame, rows)
    plan = profile._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(session_id" in plan and ", t#" not in "".join(
        line.split("hashpartitioning")[1].split(")")[0] for line in plan.splitlines() if "hashpartitioning" in line)
    for r in profile.collect():
        want = {}
        for s, p, kind, at in hist:
            if s == r["id"]:
                for t, w in vecs[p].items():
                    want[t] = want.get(t, 0.0) + {"view": 1.0, "cart": 3.0}[kind] * 0.85**at * w
        norm = sum(x * x for x in want.values()) ** 0.5
        assert [(t, round(w, 9)) for t, w in r["vec"]] == [(t, round(w / norm, 9)) for t, w in sorted(want.items())]


def test_a_vector_travels_once_for_a_bucket_of_sessions(spark, monkeypatch):
    """Sessions with the same products are added up from one copy of each vector."""
    met, join = [], personal.salted_join
    monkeypatch.setattr(personal, "salted_join", lambda left, *rest: (met.append(left.count()), join(left, *rest))[1])
    monkeypatch.setattr(personal, "BUCKETS", 1)
    vecs = spark.createDataFrame([(f"p{i}", [(i, 0.6), (9, 0.8)]) for i in range(5)], "id string, vec array<struct<t:int,w:double>>")
    hist = spark.createDataFrame([(f"s{n:03d}", f"p{i}", "view", i) for n in range(400) for i in range(5)],
                                 "session_id string, product_id string, event_type string, position bigint")
    got = personal.profiles(hist, vecs).collect()
    assert met[0] <= 5 * int(spark.conf.get("spark.sql.shuffle.partitions")) < hist.count()
    weights = [0.85**i for i in range(5)]
    raw = {i: 0.6 * w for i, w in enumerate(weights)} | {9: 0.8 * sum(weights)}
    norm = sum(x * x for x in raw.values()) ** 0.5
    assert len(got) == 400
    assert all(abs(e["w"] - raw[e["t"]] / norm) < 1e-11 for r in got for e in r["vec"]) and all(len(r["vec"]) == 6 for r in got)
