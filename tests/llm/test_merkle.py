"""The postorder log against trees built node by node, and the proofs against those trees."""

import random
import zlib
from hashlib import sha256

import pytest
from conftest_llm import ODD
from pyspark.sql import functions as F

from aislerank.llm import merkle


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    values = (row.doc_id, row.source, row.lang, row.n_chars, text)
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels(nodes):
    """All levels of a tree, the leaves first."""
    found = [nodes]
    while len(nodes) > 1:
        nodes = [h(*nodes[i : i + 16]) for i in range(0, len(nodes), 16)]
        found.append(nodes)
    return found


def siblings(tree, i):
    out = []
    for nodes in tree[:-1]:
        first = i // 16 * 16
        out.append((i - first, [n for j, n in enumerate(nodes[first : first + 16], first) if j != i]))
        i //= 16
    return out


def brute_force(rows):
    """Rows of (doc_id, leaf, subroot, root, proof_sha256, folded_root, verified), sorted as text."""
    by_source = {}
    for row in rows:
        by_source.setdefault(row.source, []).append(row)
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for name in names:
        by_source[name].sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r, r.text)))
        trees[name] = levels([leaf(r, r.text) for r in by_source[name]])
    last = levels([trees[name][-1][0] for name in names])
    out = []
    for n, name in enumerate(names):
        for i, row in enumerate(by_source[name]):
            steps = siblings(trees[name], i) + siblings(last, n)
            fold = trees[name][0][i]
            if row.doc_id is not None and zlib.crc32(str(row.doc_id).encode()) % 5 == 0 and row.text is not None:
                fold = leaf(row, "".join(c.lower() if "A" <= c <= "Z" else c for c in row.text))
            for at, others in steps:
                fold = h(*others[:at], fold, *others[at:])
            out.append((row.doc_id, trees[name][0][i], trees[name][-1][0], last[-1][0],
                        h(*[d for _, others in steps for d in others]), fold, fold == last[-1][0]))
    return sorted(map(str, out))


def altered():
    return F.crc32(F.col("doc_id").cast("string")) % 5 == 0


def result(docs):
    found = merkle.verified(docs, altered())
    return sorted(str((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified)) for r in found.collect())


@pytest.fixture
def low(monkeypatch):
    monkeypatch.setattr(merkle, "LEVELS", 1)  # so that small trees take several rounds


def some(docs_of, sizes, seed=0):
    rng = random.Random(seed)
    rows = [(rng.randrange(10**6), rng.choice(["Alpha b", "beta", "Über Z", ""]), "en", source)
            for source, n in sizes.items() for _ in range(n)]
    rng.shuffle(rows)
    return docs_of(rows)


def test_given_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert result(docs) == brute_force(docs.collect())


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 16, None: 1}, {"a": 17, "b": 256, "é": 257, "c": 3}, {f"s{i}": 1 + i % 3 for i in range(40)}])
def test_trees_of_many_shapes(docs_of, low, sizes):
    docs = some(docs_of, sizes)
    assert result(docs) == brute_force(docs.collect())


def test_blocks_of_three_levels(docs_of):
    docs = some(docs_of, {"a": 4096 + 17, "b": 40})
    assert result(docs) == brute_force(docs.collect())


def test_odd_rows_repeats_and_other_columns(docs_of, low):
    rows = [*ODD, *[(77, "the Same row", "en", "hot")] * 300]
    docs = docs_of(rows).selectExpr("*", "'x' AS tree", "1 AS at", "'y' AS leaf", "2 AS id", "3 AS n", "4 AS Leaves")
    assert result(docs) == brute_force(docs.collect())
    assert result(docs_of([])) == []


def test_every_place_of_the_log_once(docs_of, low):
    docs = some(docs_of, {"a": 300, "b": 16, "c": 1, "d": 18})
    log = merkle.build(merkle.numbered(merkle.leaves(docs)))
    held = {}
    for r in log.nodes().collect():
        held.setdefault(r.tree, {})[r.place] = bytes(r.digest).hex()
    by_source = {}
    for row in docs.collect():
        by_source.setdefault("+" + row.source, []).append((row.doc_id, leaf(row, row.text)))
    for tree, leaves in by_source.items():
        nodes = levels([digest for _, digest in sorted(leaves)])
        assert held[tree] == dict(enumerate(postorder(nodes, len(nodes) - 1, 0)))


def postorder(nodes, level, i):
    for child in range(16 * i, min(16 * i + 16, len(nodes[level - 1]))) if level else ():
        yield from postorder(nodes, level - 1, child)
    yield nodes[level][i]


def test_altered_sibling_is_noticed(docs_of):
    docs = some(docs_of, {"a": 40})
    row = merkle.manifest(docs).first()
    steps = merkle.unpacked(bytes(row.above))
    assert merkle.folded(bytes(row.leaf), steps) == bytes(row.root)
    steps[0][1][0] = b"\0" * 32
    assert merkle.folded(bytes(row.leaf), steps) != bytes(row.root)


def test_proofs_are_folded_where_they_are_made(docs_of):
    docs = docs_of([(n, f"text {n}", "en", "a") for n in range(merkle.HELD + 40)])
    done = merkle.verified(docs, F.lit(False))
    plan = done._jdf.queryExecution().optimizedPlan().toString()
    assert "above" not in plan.split("MapInArrow")[0] and plan.split("Join")[0].count("MapInArrow") == 1
    assert done.where("verified").count() == merkle.HELD + 40
