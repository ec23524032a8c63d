"""Merkle manifest of a data set, kept as a postorder append log.

Every row is a leaf: the SHA-256 of its encoded fields. The leaves of a source, by doc_id, are hashed in runs of FANOUT
up to one subroot; the subroots, by source, are the leaves of a last tree.

A tree's log holds its nodes in the order in which they are complete: a node follows its last descendant. So the place of
a node follows from the sizes of subtrees alone. Before leaf i come i leaves and every node that ends at or before it,
i + i div 16 + i div 16^2 + ..., and the node of level k whose last leaf is e comes k places after that leaf; this holds
for the short nodes at the right edge as well. Builders are aligned: one takes 16^LEVELS neighbouring leaves and appends
their nodes up to LEVELS, a segment that is contiguous in the log of its tree and can be written apart from all others.
The top nodes of segments are the leaves of the next round, so a tree of n leaves takes log(n) / log(16^LEVELS) rounds.
Proofs go the other way: a segment's siblings are read at their places, and its own proof is handed to the segments below.

Ordering n leaves needs no single task: rows are put in order by a range exchange, equal rows as one row with a count,
each task numbers what it has, and what lies in the tasks before is added.

Null fields are `-`. A null doc_id comes before all others of its source, a null source before all sources; rows of one
doc_id go by leaf, and equal rows are leaves of their own. One row alone is leaf, subroot and root with an empty proof. An
empty table gives no rows. Texts are hashed whole where they are read; only digests are exchanged. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from aislerank.llm.common import ready, store, table

FANOUT = 16
#: Levels that one builder completes; it holds FANOUT^LEVELS leaves.
LEVELS = 3
TAMPER = 5
SIZE = 32  # bytes of a digest
#: Leaves whose proofs a worker holds at once.
HELD = 512

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

SEGMENT = "tree string, block long, n_nodes int, digests binary, ids array<long>, tampered array<binary>"


# ---------------------------------------------------------------- places


def height(leaves: int) -> int:
    """Levels above the leaves of a tree."""
    levels = 0
    while leaves > 1:
        leaves = -(-leaves // FANOUT)
        levels += 1
    return levels


def place(level: int, index: int, leaves: int) -> int:
    """Place of a node in the log of a tree (of this many leaves at level 0)."""
    last = min((index + 1) * FANOUT**level, leaves) - 1
    at, rest = last + level, last // FANOUT
    while rest:
        at += rest
        rest //= FANOUT
    return at


class Segment:
    """The log of an aligned run of leaves: all its nodes up to `levels`, in the order in which they are complete."""

    def __init__(self, leaves: int, levels: int, digests: bytes = b""):
        self.leaves, self.levels, self.digests = leaves, levels, digests

    @classmethod
    def build(cls, leaves: list[bytes], levels: int) -> Segment:
        log: list[bytes] = []
        open_runs: list[list[bytes]] = [[] for _ in range(levels + 1)]  # digests of each level that wait for their run's end

        def close(level: int) -> None:
            digest = digest_of(open_runs[level])
            open_runs[level] = []
            log.append(digest)
            open_runs[level + 1].append(digest)

        for leaf in leaves:
            log.append(leaf)
            open_runs[0].append(leaf)
            for level in range(levels):
                if len(open_runs[level]) < FANOUT:
                    break
                close(level)
        for level in range(levels):  # the right edge
            if open_runs[level]:
                close(level)
        return cls(len(leaves), levels, b"".join(log))

    def node(self, level: int, index: int) -> bytes:
        at = place(level, index, self.leaves) * SIZE
        return self.digests[at : at + SIZE]

    @property
    def top(self) -> bytes:
        return self.digests[-SIZE:]

    def proof(self, leaf: int) -> list[tuple[int, list[bytes]]]:
        """For every level: the leaf's place in its run and the run's other nodes, read at their places."""
        steps = []
        nodes = self.leaves
        for level in range(self.levels):
            first = leaf // FANOUT * FANOUT
            run = range(first, min(first + FANOUT, nodes))
            steps.append((leaf - first, [self.node(level, i) for i in run if i != leaf]))
            leaf, nodes = leaf // FANOUT, -(-nodes // FANOUT)
        return steps


def digest_of(run: list[bytes]) -> bytes:
    return sha256(b"".join(run).hex().encode()).digest()


def packed(steps: list[tuple[int, list[bytes]]]) -> bytes:
    """Steps as bytes: own place, number of siblings, siblings."""
    return b"".join(bytes([at, len(others)]) + b"".join(others) for at, others in steps)


def unpacked(data: bytes) -> list[tuple[int, list[bytes]]]:
    steps, i = [], 0
    while i < len(data):
        at, n = data[i], data[i + 1]
        steps.append((at, [data[i + 2 + SIZE * j : i + 2 + SIZE * (j + 1)] for j in range(n)]))
        i += 2 + SIZE * n
    return steps


def folded(leaf: bytes, steps: list[tuple[int, list[bytes]]]) -> bytes:
    """The root that a leaf and its siblings give."""
    for at, others in steps:
        leaf = digest_of([*others[:at], leaf, *others[at:]])
    return leaf


# ---------------------------------------------------------------- leaves


def encoded(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(text: Column) -> Column:
    fields = [F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text]
    return F.unhex(F.sha2(F.concat(*map(encoded, fields)).cast("binary"), 256))


def leaves(docs: DataFrame, tamper: Column | None = None) -> DataFrame:
    """tree, id, leaf, tampered (the leaf of the altered row, null if it is not altered) of every row.

    tree is the source with a mark in front, so that it is never null and a null source comes first.
    """
    tamper = F.lit(False) if tamper is None else tamper
    altered = F.when(tamper, leaf_digest(F.translate("text", UPPER, LOWER)))
    tree = F.coalesce(F.concat(F.lit("+"), F.col("source")), F.lit(""))
    return docs.select(tree.alias("tree"), F.col("doc_id").cast("long").alias("id"),
                       leaf_digest(F.col("text")).alias("leaf"), altered.alias("tampered"))


def numbered(rows: DataFrame) -> DataFrame:
    """tree, id, leaf, tampered, n, at and leaves: equal rows as one with their number n; at is the first one's place in
    its tree, which has that many leaves. A range exchange orders the rows; the tasks number what they hold, tree by tree.
    """
    ready(rows.sparkSession)
    order = ["tree", "id", "leaf"]
    columns = [*order, "tampered", "n"]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, current, at = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            starts = np.zeros(batch.num_rows, np.int64)
            trees, counts = batch.column(0).to_pylist(), batch.column(4).to_pylist()
            for i, (tree, n) in enumerate(zip(trees, counts)):
                if tree != current:
                    current, at = tree, 0
                starts[i] = at
                at += n
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(batch.num_rows, part, np.int32)), pa.array(starts)],
                names=[*columns, "part", "local"])

    single = rows.groupBy(*order, "tampered").agg(F.count("*").alias("n"))
    local = store(single.select(*columns).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        number, "tree string, id long, leaf binary, tampered binary, n long, part int, local long"), "numbered")
    sums = local.groupBy("tree", "part").agg(F.sum("n").alias("sum"))
    ahead = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task
    offsets = sums.select("tree", "part", F.coalesce(F.sum("sum").over(ahead), F.lit(0)).alias("offset"),
                          F.sum("sum").over(Window.partitionBy("tree")).alias("leaves"))
    return (local.join(offsets, ["tree", "part"])
            .select("tree", "id", "leaf", "tampered", "n", (F.col("local") + F.col("offset")).alias("at"), "leaves"))


# ---------------------------------------------------------------- log


@dataclass
class Log:
    """rounds: the segments of each round, lowest first; trees: tree, leaves, height and subroot of every tree."""

    rounds: list[DataFrame]
    trees: DataFrame

    def nodes(self) -> DataFrame:
        """tree, place, digest of every node: the append log itself, a place for each node of a tree."""

        def spread(number: int):
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                base = LEVELS * number
                for batch in batches:
                    for row in batch.to_pylist():
                        levels = min(LEVELS, row["height"] - base)
                        part, out = Segment(row["n_nodes"], levels, row["digests"]), []
                        nodes, first = row["n_nodes"], row["block"] * FANOUT**LEVELS
                        for level in range(levels + 1):
                            if level or not number:  # the leaves of a later round are nodes of the one before
                                out += [(row["tree"], place(base + level, first + i, row["leaves"]), part.node(level, i))
                                        for i in range(nodes)]
                            nodes, first = -(-nodes // FANOUT), first // FANOUT
                        if out:
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(c) for c in zip(*out)], names=["tree", "place", "digest"])
            return run

        parts = [segments.join(self.trees, "tree").select("tree", "block", "n_nodes", "digests", "leaves", "height")
                 .mapInArrow(spread(n), "tree string, place long, digest binary") for n, segments in enumerate(self.rounds)]
        found = parts[0]
        for part in parts[1:]:
            found = found.unionByName(part)
        return found


def _builder(base: int):
    """Segments from the leaves of a block: tree, block, first, n, leaf, id, tampered, height."""

    def build(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("first")
        repeat = np.repeat(np.arange(rows.num_rows), rows.column("n").to_numpy())
        held = rows.select(["leaf", "id", "tampered"]).take(pa.array(repeat))
        head = rows.slice(0, 1).to_pylist()[0]
        part = Segment.build(held.column("leaf").to_pylist(), min(LEVELS, head["height"] - base))
        return pa.table({
            "tree": pa.array([head["tree"]], pa.string()), "block": pa.array([head["block"]], pa.int64()),
            "n_nodes": pa.array([part.leaves], pa.int32()), "digests": pa.array([part.digests], pa.binary()),
            "ids": pa.array([held.column("id").to_pylist()], pa.list_(pa.int64())),
            "tampered": pa.array([held.column("tampered").to_pylist()], pa.list_(pa.binary()))})

    return build


def build(rows: DataFrame) -> Log:
    """The log of every tree from rows as `numbered` gives them."""
    size = FANOUT**LEVELS
    steps = sum((F.col("leaves") > FANOUT**k).cast("int") for k in range(15))  # 16^15 leaves are more than a long counts
    rows = rows.withColumn("height", steps)
    trees = store(rows.groupBy("tree").agg(F.max("leaves").alias("leaves"), F.max("height").alias("height")), "trees")
    rounds = max(1, -(-(trees.agg(F.coalesce(F.max("height"), F.lit(0))).first()[0]) // LEVELS))
    found: list[DataFrame] = []
    tops = None
    for number in range(rounds):
        first, last = F.floor(F.col("at") / size), F.floor((F.col("at") + F.col("n") - 1) / size)
        end = F.least(F.col("at") + F.col("n"), (F.col("block") + 1) * size)
        dealt = (rows.withColumn("block", F.explode(F.sequence(first, last)))
                 .withColumn("first", F.greatest("at", F.col("block") * size))
                 .withColumn("n", end - F.col("first"))
                 .select("tree", "block", "first", "n", "leaf", "id", "tampered", "height"))
        found.append(store(dealt.groupBy("tree", "block").applyInArrow(_builder(LEVELS * number), SEGMENT), "segments"))
        top = found[-1].join(trees, "tree").select(
            "tree", F.lit(None).cast("long").alias("id"), F.substring("digests", -SIZE, SIZE).alias("leaf"),
            F.lit(None).cast("binary").alias("tampered"), F.lit(1).cast("long").alias("n"), F.col("block").alias("at"), "height")
        done = top.where(F.col("height") <= LEVELS * (number + 1)).select("tree", F.col("leaf").alias("subroot"))
        tops = done if tops is None else tops.unionByName(done)
        rows = top.where(F.col("height") > LEVELS * (number + 1))
    return Log(found, store(trees.join(tops, "tree"), "subroots"))


# ---------------------------------------------------------------- proofs


PROOFS = "tree string, at long, id long, tampered binary, leaf binary, subroot binary, root binary, above binary"


def proofs(log: Log, above: DataFrame, use: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]] | None = None,
           schema: str = PROOFS) -> DataFrame:
    """One row for each leaf: tree, at, id, leaf, tampered, subroot, root and above, its siblings up to the root.

    `above`: tree, root and the siblings of the tree's subroot. Rounds are gone through from the top: the proof of a
    segment's own top is joined to it, and its leaves get their siblings inside it and those. `use` turns batches of
    these rows into batches of `schema` where they are made, so that proofs, far larger than leaves, need not travel.
    """
    size = FANOUT**LEVELS
    own = above.join(log.trees.select("tree", "subroot", "height"), "tree")
    handed = None  # proofs of the tops of the segments of a round
    for number in range(len(log.rounds) - 1, -1, -1):
        base = LEVELS * number
        last = own.where((F.col("height") <= base + LEVELS) & ((F.col("height") > base) | F.lit(number == 0)))
        tops = last.select("tree", F.lit(0).cast("long").alias("block"), "above", "subroot", "root", "height")
        if handed is not None:
            tops = tops.unionByName(handed.join(log.trees.select("tree", "height"), "tree").select(
                "tree", F.col("at").alias("block"), "above", "subroot", "root", "height"))

        def extract(batches: Iterator[pa.RecordBatch], base: int = base) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for one in range(batch.num_rows):
                    row = batch.slice(one, 1).to_pylist()[0]
                    part = Segment(row["n_nodes"], min(LEVELS, row["height"] - base), row["digests"])
                    for first in range(0, part.leaves, HELD):
                        held = range(first, min(first + HELD, part.leaves))
                        n = len(held)
                        yield pa.RecordBatch.from_arrays([
                            pa.array([row["tree"]] * n, pa.string()), pa.array(row["block"] * size + np.arange(first, first + n)),
                            pa.array(row["ids"][first : first + n], pa.int64()),
                            pa.array(row["tampered"][first : first + n], pa.binary()),
                            pa.array([part.node(0, i) for i in held], pa.binary()),
                            pa.array([row["subroot"]] * n, pa.binary()), pa.array([row["root"]] * n, pa.binary()),
                            pa.array([packed(part.proof(i)) + row["above"] for i in held], pa.binary())],
                            names=["tree", "at", "id", "tampered", "leaf", "subroot", "root", "above"])

        met = log.rounds[number].join(tops, ["tree", "block"]).select(
            "tree", "block", "n_nodes", "digests", "ids", "tampered", "subroot", "root", "above", "height")
        if number:
            handed = store(met.mapInArrow(extract, PROOFS), "proofs")
        elif use is None:
            handed = met.mapInArrow(extract, PROOFS)
        else:
            handed = met.mapInArrow(lambda batches: use(extract(batches)), schema)
    return handed


def manifest(docs: DataFrame, tamper: Column | None = None,
             use: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]] | None = None, schema: str = PROOFS) -> DataFrame:
    """The rows of `proofs` for every row of docs, or what `use` makes of them."""
    by_source = build(numbered(leaves(docs, tamper)))
    subroots = by_source.trees.select(
        F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("subroot").alias("leaf"))
    # the trees are leaves of the last one, in the order of their names: numbered by a key in the place of an id
    ranked = _ranked_names(subroots)
    last = build(ranked.select("tree", F.col("at").alias("id"), "leaf", F.lit(None).cast("binary").alias("tampered"),
                               F.lit(1).cast("long").alias("n"), "at", "leaves"))
    whole = last.trees.select("tree", F.col("subroot").alias("root"), F.lit(b"").alias("above"))
    names = ranked.select("name", F.col("at").alias("id"))
    above = (proofs(last, whole).select("id", "root", "above").join(names, "id")
             .select(F.col("name").alias("tree"), "root", "above"))
    return proofs(by_source, store(above, "subroot-proofs"), use, schema)


def _ranked_names(subroots: DataFrame) -> DataFrame:
    """tree, name, leaf, at: the place of every name, by a range exchange and the counts of the tasks before."""
    rows = store(subroots.repartitionByRange("name").sortWithinPartitions("name").select(
        "tree", "name", "leaf", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row")), "names")
    sums = rows.groupBy("part").agg(F.count("*").alias("sum"), F.min("row").alias("first"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task
    offsets = sums.select("part", "first", F.coalesce(F.sum("sum").over(ahead), F.lit(0)).alias("offset"),
                          F.sum("sum").over(Window.partitionBy(F.lit(0))).alias("leaves"))
    return rows.join(offsets, "part").select(
        "tree", "name", "leaf", (F.col("row") - F.col("first") + F.col("offset")).alias("at"), "leaves")


def verified(docs: DataFrame, tamper: Column) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: every proof is folded, from the altered leaf if
    the row is one that `tamper` names."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            proof, root = [], []
            for leaf, tampered, above in zip(*(batch.column(c).to_pylist() for c in ("leaf", "tampered", "above"))):
                steps = unpacked(above)
                proof.append(sha256(b"".join(d for _, others in steps for d in others).hex().encode()).hexdigest())
                root.append(folded(leaf if tampered is None else tampered, steps).hex())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("id", "leaf", "subroot", "root")), pa.array(proof, pa.string()),
                 pa.array(root, pa.string())], names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root"])

    done = manifest(docs, tamper, fold, "doc_id long, leaf binary, subroot binary, root binary, proof_sha256 string, folded_root string")
    hexed = [F.lower(F.hex(c)).alias(c) for c in ("leaf", "subroot", "root")]
    return done.select("doc_id", *hexed, "proof_sha256", "folded_root",
                       (F.col("folded_root") == F.lower(F.hex("root"))).alias("verified"))


def op13_postorder_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    tamper = F.crc32(F.col("doc_id").cast("string")) % TAMPER == 0
    return verified(table(spark, sf_dir, "documents"), tamper)


# ---------------------------------------------------------------- SQL


def _sql(source_levels: int = 5, top_levels: int = 3) -> str:
    """The same trees level by level, for sources of at most 16^5 rows and at most 16^3 sources."""

    def field(column: str) -> str:
        return f"coalesce(strlen({column}::VARCHAR) || ':' || {column}::VARCHAR, '-')"

    head = " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars"))
    bits = "list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0])"
    step = "CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END"
    digits = "list_transform(string_split(doc_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT)"
    crc = (f"xor(list_reduce(list_concat([4294967295::BIGINT], {digits}), "
           f"lambda c, b: list_reduce({bits}, lambda x, y: {step})), 4294967295)")
    parts = [f"""
leaves AS (SELECT row_number() OVER () AS r, doc_id, coalesce('+' || source, '') AS tree, sha256({head} || {field('text')}) AS leaf,
  CASE WHEN {crc} % {TAMPER} = 0 THEN sha256({head} || {field(f"translate(text, '{UPPER}', '{LOWER}')")}) END AS tampered
  FROM documents),
s0 AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, leaf AS node FROM leaves)"""]
    # n<k>: tree, i, node of level k; a tree with one node keeps it
    parts.append("n0 AS (SELECT tree, i, node, count(*) OVER (PARTITION BY tree) AS m FROM s0)")

    def level(name: str, k: int) -> str:
        return (f"{name}{k + 1} AS (SELECT tree, i // 16 AS i, CASE WHEN max(m) > 1 THEN sha256(string_agg(node, '' ORDER BY i)) "
                f"ELSE min(node) END AS node, (max(m) + 15) // 16 AS m FROM {name}{k} GROUP BY tree, i // 16)")

    parts += [level("n", k) for k in range(source_levels)]
    parts.append(f"t0 AS (SELECT 0 AS tree, tree AS name, row_number() OVER (ORDER BY tree) - 1 AS i, node, "
                 f"count(*) OVER () AS m FROM n{source_levels})")
    parts += [level("t", k) for k in range(top_levels)]
    parts.append(f"root AS (SELECT node AS root FROM t{top_levels})")
    parts.append("p0 AS (SELECT r, doc_id, s0.tree, leaf, s0.i, coalesce(tampered, leaf) AS fold, '' AS proof FROM s0)")

    def climb(k: int, nodes: str) -> str:
        key = "p.tree = n.tree" if nodes[0] == "n" else "true"
        return f"""p{k + 1} AS (SELECT p.r, any_value(p.doc_id) AS doc_id, any_value(p.tree) AS tree, any_value(p.leaf) AS leaf,
  any_value(p.i) // 16 AS i, CASE WHEN max(n.m) > 1 THEN sha256(string_agg(CASE WHEN n.i = p.i THEN p.fold ELSE n.node END, '' ORDER BY n.i))
  ELSE any_value(p.fold) END AS fold, any_value(p.proof) || coalesce(string_agg(n.node, '' ORDER BY n.i) FILTER (n.i <> p.i), '') AS proof
  FROM p{k} p JOIN {nodes} n ON {key} AND p.i // 16 = n.i // 16 GROUP BY p.r)"""

    parts += [climb(k, f"n{k}") for k in range(source_levels)]
    k = source_levels
    parts.append(f"p{k + 1} AS (SELECT p.r, p.doc_id, p.tree, p.leaf, t0.i, p.fold, p.proof FROM p{k} p JOIN t0 ON p.tree = t0.name)")
    parts += [climb(k + 1 + j, f"t{j}") for j in range(top_levels)]
    return (f"WITH {', '.join(parts)} SELECT p.doc_id, p.leaf, n.node AS subroot, root.root, sha256(p.proof) AS proof_sha256, "
            f"p.fold AS folded_root, p.fold = root.root AS verified "
            f"FROM p{k + 1 + top_levels} p JOIN n{source_levels} n ON p.tree = n.tree, root")


OP13_SQL = _sql()
