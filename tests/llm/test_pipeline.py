"""The pipeline's stages on the smallest tables, each held against what it was given."""

import re
import zlib

import corpus_pipeline
import numpy as np
from conftest_llm import ODD
from test_dedup_and_links import classes, fingerprint

from aislerank.llm import packing, secret_scan, tokens, toxicity
from aislerank.llm.common import store

CODER = tokens.encoder(tokens.vocabulary_path())


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_stages_in_turn(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    tables = [docs.collect()]
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "secrets", "mixing", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        docs = store(stage(spark, docs, sf), "test-stage")
        tables.append(docs.collect())
        assert name == "packing" or docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    raw, civil, single, masked, mixed, packed = tables

    known = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    dropped = {r.doc_id for r in raw} - {r.doc_id for r in civil}
    clean = [r for r in raw if known.get(r.doc_id) == 0]
    assert sum(r.doc_id in dropped for r in clean) <= 0.01 * len(clean)
    scored = toxicity.scores(spark.createDataFrame(raw), toxicity.model(spark, sf), ["doc_id"]).collect()
    assert dropped == {r.doc_id for r in scored if r.score >= toxicity.THRESHOLD}

    fps = {r.doc_id: fingerprint(r.text) for r in civil}
    root = classes(set(fps.values()), lambda a, b: (a ^ b).bit_count() <= 2)
    first = {}
    for doc_id, fp in fps.items():
        first[root[fp]] = min(doc_id, first.get(root[fp], doc_id))
    assert {r.doc_id for r in single} == set(first.values())

    texts = {r.doc_id: r.text for r in single}
    for r in masked:
        spans = next(secret_scan.scan_texts([texts[r.doc_id]], secret_scan.RULES))
        assert r.text == secret_scan.masked_text(texts[r.doc_id], spans, "[SECRET]") and r.n_chars == len(r.text)

    size, taken = {}, {}
    for r in masked:
        size[r.source] = size.get(r.source, 0) + words(r.text)
    for r in mixed:
        taken[r.source] = taken.get(r.source, 0) + words(r.text)
    times = {}
    for r in mixed:
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    assert max(times.values()) <= 3 and set(times) <= {r.doc_id for r in masked}
    from test_models_and_mix import targets

    longest = max(words(r.text) for r in masked)
    assert all(abs(taken.get(s, 0) - t) <= longest for s, t in targets(size).items())

    want = []
    for r in mixed:
        ids = np.array([*CODER.tokenizer.encode(r.text, add_special_tokens=False).ids, 2], "<u4")
        first = (len(ids) - 1) % 1024 + 1
        bounds = [0, *range(first, len(ids) + 1, 1024)]
        want += [(r.doc_id, n, zlib.crc32(ids[a:b].tobytes())) for n, (a, b) in enumerate(zip(bounds, bounds[1:]))]
    assert sorted((r.doc_id, r.piece, r.ids_crc32) for r in packed) == sorted(want)
    fill = {}
    for r in packed:
        fill[r.sequence_id] = fill.get(r.sequence_id, 0) + r.length
    assert max(fill.values()) <= packing.CAPACITY and len(fill) <= 1.02 * sum(fill.values()) / packing.CAPACITY + 1


def test_odd_and_empty_tables_through_all_stages(spark, docs_of, tmp_path):
    """Nulls, blanks, repeated rows and columns whose names the operators use themselves."""
    spark.createDataFrame([(1, 0, 0), (None, 1, None), (2, None, None)], "doc_id long, quality int, toxic int").write.parquet(
        str(tmp_path / "labels.parquet"))
    odd = docs_of(ODD)
    odd.write.parquet(str(tmp_path / "documents.parquet"))
    extra = ("score", "size", "row", "class", "fp", "keys", "shard", "block", "target", "_score", "_a", "_b", "_n", "_SHARD",
             "_place", "row_key", "copies", "number", "key", "home", "order")
    for docs in (odd.selectExpr("*", *[f"'e' AS {c}" for c in extra]), odd.where("false")):
        some = not docs.isEmpty()
        for name, stage in corpus_pipeline.STAGES:
            columns = docs.columns
            docs = store(stage(spark, docs, str(tmp_path)), "odd-stage")
            assert name == "packing" or docs.columns == columns
            assert bool(docs.count()) == some
