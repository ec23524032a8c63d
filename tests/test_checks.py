"""Quality rules, cleaning, drift, co-purchase, spelling and metrics."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from aislerank.functions import numbers, text
from aislerank.operators import cleaning, drift, merchandising, metrics, quality, reports, search
from aislerank.plans import pipeline
from aislerank.settings import RAW_COLUMNS
from aislerank.sources import csv_catalogue, tables
from aislerank.sources.driver_tables import raw_catalogue
from aislerank.streaming import jobs


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x"))).first()[0]


@pytest.mark.parametrize("fn,value,want", [
    (numbers.parse_price, "₹1,09,990", 109990.0), (numbers.parse_price, "n/a", None), (numbers.parse_price, "1d", None),
    (numbers.parse_percent, " 64 %", 64.0), (numbers.parse_rating, "4,1 out of 5", 4.1), (numbers.parse_rating, "Get", None),
    (numbers.parse_rating, "7.5", None), (numbers.parse_count, "24,269 ratings", 24269.0), (numbers.parse_count, "24269.0", 24269.0),
    (numbers.safe_number, "Rs. -12.5x", 0.0), (numbers.safe_number, "NaN", 0.0), (numbers.safe_text, " None ", ""),
    (text.normalise, "['Big—Bolt'] (2)", "big bolt 2"), (text.brand_of, "the 3-M tape", "3m"), (text.brand_of, "a an in X", "Unknown"),
    (text.readable_category, "HomeTheater,TV&Video", "Home Theater,TV & Video"),
])
def test_scalars(spark, fn, value, want):
    assert one(spark, value, fn) == want


def test_csv_round_trip_in_latin_1(spark, tmp_path):
    row = ['a1', 'Café "x", y', 'A|B', '₹1'.replace('₹', ''), 'NA', '', '4.1', '1,000', 'two\nlines', 'null', 'l']
    quoted = ",".join('"' + v.replace('"', '""') + '"' for v in row)
    path = tmp_path / "raw.csv"
    path.write_bytes((",".join(RAW_COLUMNS) + "\n" + quoted + "\n").encode("latin-1"))
    found = csv_catalogue.source_files(spark, str(path)).first()
    assert (found["encoding"], found["bytes"]) == ("ISO-8859-1", path.stat().st_size)
    got = csv_catalogue.read_catalogue_csv(spark, str(path)).first()
    assert got["product_name"] == 'Café "x", y' and got["actual_price"] is None and got["discount_percentage"] is None
    assert got["about_product"] == "two\nlines" and got["img_link"] is None


def test_every_file_is_read_in_its_own_encoding(spark, tmp_path):
    for name, encoding in (("utf 8.csv", "utf-8"), ("latin.csv", "latin-1")):
        lines = [",".join(RAW_COLUMNS), ",".join([name[0], "café"] + ["x"] * (len(RAW_COLUMNS) - 2))]
        (tmp_path / name).write_bytes("\n".join(lines).encode(encoding))
    got = csv_catalogue.read_catalogue_csv(spark, str(tmp_path)).collect()
    assert sorted((r["product_id"], r["product_name"]) for r in got) == [("l", "café"), ("u", "café")]


def test_white_space_of_every_kind(spark):
    assert one(spark, "1\u00a0234,5", numbers.parse_price) == 12345.0
    assert one(spark, "\u3000 12 \u00a0%", numbers.parse_percent) == 12.0
    assert one(spark, "\t none\u2003", numbers.safe_text) == ""
    assert one(spark, " \t\u00a0\n", quality.is_blank) is True


def test_a_replayed_batch_does_not_repeat_its_log(spark, tmp_path):
    rows = spark.createDataFrame([("s", "a", "b", 0.5)], "query_id string, source_product_id string, product_id string, score double")
    write = jobs.log_recommendations(rows, str(tmp_path), "hybrid")
    write(rows, 3)
    write(rows, 3)
    write(rows, 4)
    assert spark.read.parquet(str(tmp_path)).groupBy("batch").count().orderBy("batch").collect() == [(3, 1), (4, 1)]


def test_content_version_ignores_order_but_not_copies(spark, sf):
    raw = raw_catalogue(spark, sf)
    version = lambda df: csv_catalogue.content_version(df).first()["version"]
    assert version(raw) == version(raw.repartition(3).orderBy(F.desc("ingest_order")))
    assert version(raw) != version(raw.union(raw.limit(1)).union(raw.limit(1)))


def test_error_rule_stops_the_run(spark):
    rows = [(str(i) if i > 5 else None, "n", "c", "1", "1", "1", "4", "1", "d", "i", "l") for i in range(100)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in RAW_COLUMNS))
    found = quality.verdict(quality.issues(quality.measure(df)))
    assert found.first()["errors"] == 1
    with pytest.raises(quality.DataQualityError):
        quality.enforce(found)
    assert quality.schema_check(df.drop("rating")).first()["missing_columns"] == "rating"


def test_pipeline_end_to_end(spark, sf, tmp_path):
    raw = raw_catalogue(spark, sf)
    trained = pipeline.run(raw, str(tmp_path / "run"), k=5)
    row = trained.metrics.first()
    assert 0 < row["dataset_rows"] <= raw.count() and row["vocab_size"] > 0
    for name in ("precision_at_5", "recall_at_10", "coverage", "diversity", "novelty"):
        assert 0 <= row[name] <= 1
    for name in ("evaluation", "summary"):
        assert spark.read.text(str(tmp_path / "run" / "reports" / name)).count() == 1
    assert trained.features.filter("popularity_score < 0 OR popularity_score > 1").count() == 0
    assert set(r[0] for r in trained.features.select("price_bucket").distinct().collect()) <= {
        "Budget", "Mid-Range", "Premium", "Luxury", "Unknown"}
    ids = trained.features.select(F.col("product_id").alias("query_id")).union(spark.createDataFrame([("zz",)], "q string"))
    for name in ("content_based", "frequently_bought", "trending", "no such strategy"):
        recs = pipeline.recommend(trained, ids, name, 4)
        assert recs.filter("query_id = product_id").count() == 0
        assert recs.groupBy("query_id").agg(F.max("rank").alias("m"), F.count("*").alias("n")).filter("m <> n").count() == 0


def test_log_rows_accumulate(spark, tmp_path):
    recs = spark.createDataFrame([("s", "a", "b", "hybrid", 0.5)], "query_id string, source_product_id string, product_id string, strategy string, score double")
    for _ in range(2):
        tables.append_recommendations(recs, str(tmp_path / "log"))
    log = spark.read.parquet(str(tmp_path / "log"))
    assert log.count() == 2 and log.agg(F.sum("clicked"), F.sum("purchased")).first() == (0, 0)


def normal_rows(spark, seed, mean, n=3000, share=0.9):
    rng = random.Random(seed)
    rows = [(rng.gauss(mean, 100), rng.gauss(mean * 1.2, 100), rng.uniform(3, 5), rng.randint(1, 1000),
             "A|x" if rng.random() < share else "B|y") for _ in range(n)]
    return spark.createDataFrame(rows, "discounted_price double, actual_price double, rating double, rating_count bigint, category string")


def test_drift_cases(spark, tmp_path):
    path = str(tmp_path / "baseline")
    base = normal_rows(spark, 1, 500)
    first = drift.check(base, path).collect()
    assert [r["status"] for r in first] == ["baseline_established"]
    same = {r["feature"]: r["grade"] for r in drift.check(normal_rows(spark, 2, 500), path).collect()}
    assert set(same.values()) == {"none"}
    moved = {r["feature"]: (r["value"], r["grade"]) for r in drift.check(normal_rows(spark, 3, 5000), path).collect()}
    assert moved["discounted_price"][1] == "high" and moved["discounted_price"][0] > 0.25
    mixed = {r["feature"]: r["grade"] for r in drift.check(normal_rows(spark, 4, 500, share=0.1), path).collect()}
    assert mixed["category"] == "high"
    later = normal_rows(spark, 3, 5000)
    drift.save_baseline(later, path)
    assert {r["grade"] for r in drift.check(later, path).collect()} == {"none"}


def test_drift_document_of_first_and_later_runs(spark, tmp_path):
    import json

    path = str(tmp_path / "baseline")
    read = lambda df: json.loads(reports.document(reports.drift_summary(df, path)).first()["report"])
    first = read(normal_rows(spark, 1, 500))
    assert first["status"] == "baseline_established" and first["overall_grade"] == "none" and not first.get("features")
    later = read(normal_rows(spark, 3, 5000))
    assert later["baseline_record_count"] == 3000 and later["overall_grade"] == "high"
    assert later["features"]["discounted_price"]["metric"] == "psi" and set(later["features"]) == {*drift.NUMERIC, "category"}


def test_a_promotion_during_a_check_changes_nothing_in_it(spark, tmp_path):
    path = str(tmp_path / "baseline")
    base, later = normal_rows(spark, 1, 500), normal_rows(spark, 3, 5000)
    assert drift.load_baseline(spark, path) is None
    drift.save_baseline(base, path)
    running = drift.check(later, path)  # not evaluated yet
    held = drift.load_baseline(spark, path)
    drift.save_baseline(later, path)
    assert {r["feature"]: r["grade"] for r in running.collect()}["discounted_price"] == "high"
    assert held.records == 3000 and held.bins.agg(F.sum("n")).first()[0] == 4 * 3000
    newest = drift.load_baseline(spark, path)
    assert newest.version > held.version and newest.records == 3000
    assert {r["grade"] for r in drift.check(later, path).collect()} == {"none"}


def test_sketched_latency_is_near_in_rank_and_merges_days(spark):
    rng = random.Random(6)
    values = [rng.lognormvariate(3, 1) for _ in range(30_000)]
    rows = spark.createDataFrame([(v, i % 40) for i, v in enumerate(values)], "ms double, d int").select(
        F.lit("p").alias("path"), "ms", F.date_add(F.lit("2024-01-01"), F.col("d")).alias("ts")).union(
            spark.sql("select 'one', 5.0D, date'2024-01-01' union all select 'none', cast(null as double), date'2024-01-01'"))
    stored = drift.latency_sketches(rows, "path", "ms")
    assert stored.filter("path = 'p'").count() == 40
    got = {r["path"]: r for r in drift.sketched_latency(stored).collect()}
    assert set(got) == {"p", "one"} and got["one"]["p50_ms"] == 5.0 and got["p"]["count"] == 30_000
    assert got["p"]["avg_ms"] == round(sum(values) / len(values), 2)
    for p in (50, 95, 99):
        assert abs(sum(v <= got["p"][f"p{p}_ms"] for v in values) / len(values) - p / 100) < 0.01


def test_profile_names_its_files(spark, tmp_path):
    path = str(tmp_path / "one.csv")
    with open(path, "w", encoding="utf-8") as f:
        f.write(",".join(RAW_COLUMNS) + "\n" + ",".join(["é"] * len(RAW_COLUMNS)) + "\n")
    size = (tmp_path / "one.csv").stat().st_size
    rows = csv_catalogue.ingestion_profile(
        csv_catalogue.read_catalogue_csv(spark, path), files=csv_catalogue.source_files(spark, path)).collect()
    assert {(r["files"], r["bytes"], r["null_count"], r["records"]) for r in rows} == {(1, size, 0, 1)}
    assert rows[0]["source_path"].endswith("/one.csv")


@pytest.mark.parametrize("n", [1, 2, 7, 500])
def test_order_statistics(spark, n):
    rng = random.Random(n)
    values = [float(rng.choice([rng.randint(0, 5), rng.randint(0, 1000)])) for _ in range(n)]
    rows = spark.createDataFrame([("k", v) for v in values], "feature string, value double")
    got = drift.order_statistics(rows, "feature", F.sequence(F.lit(0), (F.col("n") - 1).cast("int")), blocks=5)
    assert [r["value"] for r in got.orderBy("rank").collect()] == sorted(values)


def brute_together(baskets, k):
    count = {}
    for items in baskets.values():
        for a, b in itertools.permutations(sorted(items), 2):
            count[a, b] = count.get((a, b), 0) + 1
    out = {}
    for (a, b), n in count.items():
        if n >= 2:
            out.setdefault(a, []).append((-n, b))
    return {a: [(b, -n) for n, b in sorted(found)[:k]] for a, found in out.items()}


@pytest.mark.parametrize("seed,large", [(1, 500), (1, 4), (2, 2), (3, 0), (4, 6)])
def test_co_purchases_with_large_baskets(spark, seed, large):
    rng = random.Random(seed)
    baskets = {b: set(rng.sample(range(12), rng.randint(1, 9))) for b in range(14)}
    lines = spark.createDataFrame(
        [(b, f"p{i:02d}") for b, items in baskets.items() for i in items for _ in range(rng.randint(1, 2))], "basket int, product_id string")
    got = {}
    for r in merchandising.co_purchases(lines, 4, large=large).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["product_id"], r["together"]))
    assert got == brute_together({b: {f"p{i:02d}" for i in items} for b, items in baskets.items()}, 4)


@pytest.mark.parametrize("wide", [0, 1])
def test_pairs_of_too_few_baskets_go_no_further_than_their_count(spark, monkeypatch, wide):
    """One basket in two holds the same two products; all the other pairs, forty to a line, are met once."""
    lines = spark.range(100).select(F.col("id").alias("basket"), F.explode(F.sequence(F.lit(0), F.lit(39))).alias("i")).select(
        "basket", F.when((F.col("i") < 2) & (F.col("basket") % 2 == 0), F.format_string("twin%d", "i"))
        .otherwise(F.format_string("p%d-%d", "basket", "i")).alias("product_id"))
    for b in range(wide):  # a large basket of products that no small one has
        lines = lines.union(spark.range(50).select(F.lit(-1 - b).cast("long"), F.format_string("w%d", "id")))
    sizes, cut = [], merchandising.cut

    def counted(df):
        rows = cut(df)
        sizes.append(rows.count())
        return rows

    monkeypatch.setattr(merchandising, "cut", counted)
    got = {(r["query_id"], r["product_id"], r["together"]) for r in merchandising.co_purchases(lines, 4, large=40).collect()}
    assert got == {("twin0", "twin1", 50), ("twin1", "twin0", 50)}
    assert max(sizes) <= 100 * 40 + 50 * wide


def test_one_basket_of_very_many_products(spark):
    """100,000 products in one basket and in 300 others: only what those share brings products together."""
    n = 100_000
    wide = spark.range(n).select(F.lit(-1).alias("basket"), F.format_string("p%06d", "id").alias("product_id"))
    small = spark.range(300).select(
        F.col("id").cast("int").alias("basket"), F.explode(F.sequence(F.lit(0), F.lit(5))).alias("j")).select(
            "basket", F.format_string("p%06d", (F.col("basket") * 331 + F.col("j") * 7) % n).alias("product_id"))
    lines = wide.union(small)
    baskets = {}
    for r in small.collect():
        baskets.setdefault(r["basket"], set()).add(r["product_id"])
    want = {}
    for items in baskets.values():
        for a, b in itertools.permutations(items, 2):
            want[a, b] = want.get((a, b), 1) + 1
    got = {(r["query_id"], r["product_id"]): r["together"] for r in merchandising.co_purchases(lines, 50, large=4).collect()}
    assert got == want
    classes = spark.createDataFrame([(f"s{i}", b) for i in range(2000) for b in (-1, i // 2)], "sig string, basket int")
    assert merchandising.classes_that_meet(classes, 2).count() == 2 * 2000


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_corrections_match_brute_force(spark):
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abc") for _ in range(n))
    vocabulary = sorted({word(rng.randint(1, 9)) for _ in range(250)})
    typed = sorted({word(rng.randint(1, 10)) for _ in range(60)})
    got = {}
    rows = merchandising.corrections(
        spark.createDataFrame([(t,) for t in typed], "typed string"), spark.createDataFrame([(w,) for w in vocabulary], "word string"))
    for r in rows.orderBy("typed", "rank").collect():
        got.setdefault(r["typed"], []).append(r["word"])
    want = {}
    for t in typed:
        scored = sorted((-round(100 * (1 - edits(t, w) / max(len(t), len(w))), 6), w) for w in vocabulary)
        near = [w for s, w in scored if s <= -75][:3]
        if near:
            want[t] = near
    assert got == want


@pytest.mark.parametrize("least", [60.0, 80.0])
def test_correction_candidates_lose_none_and_stay_few(spark, least):
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    vocabulary = sorted({word(rng.randint(4, 9)) for _ in range(1500)})
    typed = sorted({w[:i] + rng.choice(["", "x", w[i] + "y"]) + w[i + 1:] for w in vocabulary[::25] for i in [rng.randrange(len(w))]} | {"a", ""})
    pairs = merchandising.correction_candidates(
        spark.createDataFrame([(t,) for t in typed], "typed string"),
        spark.createDataFrame([(w,) for w in vocabulary], "word string"), least).collect()
    assert len(pairs) == len(set(pairs))
    near = {(t, w) for t in typed for w in vocabulary if 100 * (1 - edits(t, w) / max(len(t), len(w))) >= least}
    assert near and near <= {(r["typed"], r["word"]) for r in pairs}
    assert len(pairs) < (0.2 if least < 70 else 0.02) * len(typed) * len(vocabulary)


def _attributed(spark, folder, files):
    """The stream's rows after reading one file per micro-batch."""
    import os
    import time

    for i, rows in enumerate(files):
        path = f"{folder}/part-{i}.parquet"
        rows.coalesce(1).write.parquet(path)
        for name in os.listdir(path):
            os.utime(f"{path}/{name}", (time.time() - 1000 + 10 * i,) * 2)
    stream = (spark.readStream.schema(files[0].schema).option("maxFilesPerTrigger", 1)
              .option("recursiveFileLookup", "true").parquet(folder))
    out = jobs.run_once(jobs.conversions(stream, 30))
    return {(r["event_id"], r["purchased_at"]) for r in out.collect()}, out.select("batch").distinct().count()


def test_streamed_attribution_over_files_with_late_events(spark, tmp_path):
    rng = random.Random(4)
    minute = 60_000_000
    events = [(i, rng.choice(["hot", "a", "b", "c"]), rng.choice(["click", "click", "purchase", "view"]), rng.randrange(0, 900) * minute + i)
              for i in range(400)]
    events += [(9000, "end", "click", 3000 * minute), (9001, "end", "purchase", 3000 * minute)]
    # Up to 50 minutes late: inside the allowed hour, across file borders.
    arrival = sorted(events, key=lambda e: e[3] + rng.randrange(0, 50) * minute)
    cuts = [arrival[:130], arrival[130:260], arrival[260:]]
    frames = [spark.createDataFrame(part, "event_id bigint, session_id string, event_type string, us bigint").select(
        "event_id", "session_id", "event_type", F.timestamp_micros("us").alias("ts")) for part in cuts]
    got, batches = _attributed(spark, str(tmp_path / "in"), frames)
    whole = frames[0].union(frames[1]).union(frames[2])
    want = {(r["event_id"], r["purchased_at"]) for r in merchandising.conversions(whole, 30).collect() if r["event_id"] != 9000}
    assert got == want and batches > 1
    assert any(p is None for _, p in got) and any(p is not None for _, p in got)


def test_ndcg_and_recall_by_hand(spark):
    recs = spark.createDataFrame([("s", "a", 1), ("s", "b", 2), ("s", "c", 3), ("t", "a", 1)], "session_id string, product_id string, rank int")
    relevant = spark.createDataFrame([("s", "b"), ("s", "z")], "session_id string, product_id string")
    got = {r["session_id"]: r for r in metrics.relevance_metrics(recs, relevant).collect()}
    assert got["s"]["precision"] == pytest.approx(1 / 3) and got["s"]["recall"] == 0.5
    assert got["s"]["ndcg"] == pytest.approx((1 / math.log2(3)) / (1 + 1 / math.log2(3)))
    assert (got["t"]["recall"], got["t"]["ndcg"], got["t"]["hit_rate"]) == (0.0, 0.0, 0.0)


def test_search_points(spark):
    rows = [("1", "Bolt bolt cutter", 0.1, "Tools"), ("2", "Bolts set", 0.9, "Tools"), ("3", "bolt", 0.5, "Parts"), ("4", "gear", 0.9, "Parts")]
    df = spark.createDataFrame(rows, "product_id string, product_name string, popularity_score double, category_l1 string").withColumns({
        "category_l2": F.lit(""), "brand": F.lit(""), "discounted_price": F.lit(1.0), "price_bucket": F.lit(""), "rating": F.lit(4.0), "rating_count": F.lit(1.0)})
    ask = lambda q, **kw: [(r["product_id"], r["score"]) for r in search.search(
        df, spark.createDataFrame([(q,)], "query string"), **kw).orderBy("rank").collect()]
    assert ask("bolt") == [("1", 4.0), ("3", 2.0), ("2", 0.5)]
    assert ask("bolt", k=1) == [("1", 4.0)]
    assert ask("BOLT bolt", category="tools") == [("1", 8.0), ("2", 1.0)]
    assert ask("b zzz") == []


def test_row_accounting_balances(spark, sf):
    row = cleaning.row_accounting(raw_catalogue(spark, sf)).first()
    assert row["rows_in"] - row["exact_copies"] - row["product_copies"] - row["rows_dropped"] == row["rows_out"]


def test_a_description_is_normalised_in_one_pass(spark):
    rng = random.Random(3)
    odd = ["", " ", "nan", " nan ", "[nan]", "None", "'None'", "none", "NAN", "NaN|", "nan.", "No|ne", "(nan) x", "\u0130stanbul\u03a3", "a\u00a0b",
           "\U0001F600x", "a\tb\n\x0bc\x1cd", None, "|", "{}"]
    odd += ["".join(rng.choice("aZ9 nN|['].\t\u00e9-") for _ in range(rng.randint(1, 12))) for _ in range(300)]
    rows = spark.createDataFrame([(t,) for t in odd], "t string")
    steps = lambda c: F.regexp_replace(F.regexp_replace(F.lower(c), text.LIST_MARKS, " "), r"[^a-z0-9\s]", " ")
    blank = lambda c: c.isNull() | F.trim(c).isin("", "nan", "None")
    plain = lambda c: F.when(blank(c), "").otherwise(text.squeeze(steps(c)))
    t = F.col("t")
    got = rows.select(
        "t", text.normalise(t).alias("n"), plain(t).alias("wanted_n"), text.normalised_description(t).alias("d"),
        plain(text.clean_description(t)).alias("wanted_d")).collect()
    assert [r for r in got if (r["n"], r["d"]) != (r["wanted_n"], r["wanted_d"])] == []
    cleaned = rows.select(text.normalise(t).alias("n"))._jdf.queryExecution().optimizedPlan().toString()
    assert cleaned.count("regexp_replace") == 1
