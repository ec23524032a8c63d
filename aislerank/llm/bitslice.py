"""Exact top-k inner products by a bit-sliced index.

Every component is turned into the integer floor(scale * x). Vectors lie in blocks; a block stores, for each attribute,
bit slices of its coarse value (the integer without its lowest DROPPED bits, shifted to be non-negative): one bitmap over
the block's rows for each bit. A query adds the slices with bitmap arithmetic: each slice is a one-bit number for all
rows at once, weighted by the query's component, and carry-save adders sum them into the slices of the score. Rows are
selected from the most significant slice of that sum downward. The dropped bits bound how far a score may be from its
coarse value; rows within that bound of the k-th coarse score are the boundary, whose integer products are computed
exactly. So are ties: every row that may equal the k-th score is among them.

Rows are put into blocks once. Queries are taken in sets of at most QUERY_BYTES, which are broadcast one after the other;
the row blocks are read where they lie for each set and never exchanged, and a query puts out at most k rows of a block.

Vectors that are null or empty, hold null or non-finite components, or have a null id take no part. Vectors with a scaled
component of 2^26 or more, whose products need not fit a long, are kept beside the index: pairs with such a vector on
either side are multiplied in exact integers, which costs far more. A score beyond the range of a long counts as that
range's end, so such scores are ties. A query meets vectors of its own length only. Rows that repeat an id are candidates of their own, but never of
a query of that id. An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from operator import mul

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from aislerank.llm.common import ready, store, table

SCALE = 1024
DROPPED = 4
BLOCK_ROWS = 1 << 14
QUERY_BYTES = 1 << 25
LIMIT = 1 << 26
LONGEST = (1 << 63) - 1

BLOCKS = "dims int, block long, ids binary, vectors binary"


# ---------------------------------------------------------------- slices


class Slices:
    """Bit slices of a block of integer vectors (rows x attributes)."""

    def __init__(self, vectors: np.ndarray, dropped: int = DROPPED):
        self.vectors = vectors
        self.rows = len(vectors)
        self.dropped = dropped
        coarse = vectors >> dropped
        self.low = coarse.min(axis=0)
        coarse = coarse - self.low
        width = max(1, int(coarse.max()).bit_length()) if coarse.size else 1
        pad = -self.rows % 64
        self.valid = self._bitmap(np.ones(self.rows, bool), pad)
        # slices[b] holds bit b of every attribute: attributes x words
        self.slices = [np.stack([self._bitmap((c >> b & 1).astype(bool), pad) for c in coarse.T]) for b in range(width)]

    @staticmethod
    def _bitmap(bits: np.ndarray, pad: int) -> np.ndarray:
        return np.packbits(np.concatenate([bits, np.zeros(pad, bool)]), bitorder="little").view(np.uint64)

    def sums(self, query: np.ndarray) -> tuple[list[np.ndarray], int]:
        """Slices, lowest first, of sum(query * coarse) less a constant that makes it non-negative, and that constant.

        A negative component adds the slice's complement instead: -q * s = q * (1 - s) - q.
        """
        columns: list[list[np.ndarray]] = []  # bitmaps that wait at each power of two
        base = int((query * self.low).sum())
        size = np.abs(query)
        for bit in range(int(size.max()).bit_length() if len(size) else 0):
            with_bit = (size >> bit & 1).astype(bool)
            plus, minus = with_bit & (query > 0), with_bit & (query < 0)
            for b, maps in enumerate(self.slices):
                while len(columns) <= bit + b:
                    columns.append([])
                columns[bit + b] += [*maps[plus], *(~maps[minus])]
                base -= int(minus.sum()) << (bit + b)
        out = []
        power = 0
        while power < len(columns):
            maps = columns[power]
            while len(maps) > 2:  # carry-save: three bitmaps of one power are one of it and one of the next
                third = len(maps) // 3
                x, y, z = (np.stack(maps[i * third : (i + 1) * third]) for i in range(3))
                half = x ^ y
                rest = maps[3 * third :]
                maps = [*(half ^ z), *rest]
                if power + 1 == len(columns):
                    columns.append([])
                columns[power + 1] += [*((x & y) | (half & z))]
            if len(maps) == 2:
                if power + 1 == len(columns):
                    columns.append([])
                columns[power + 1].append(maps[0] & maps[1])
                maps = [maps[0] ^ maps[1]]
            out.append(maps[0] & self.valid if maps else np.zeros_like(self.valid))
            power += 1
        return out, base

    def top(self, sums: list[np.ndarray], k: int, slack: int) -> np.ndarray:
        """Rows whose sum is at least the k-th largest sum less slack, found from the highest slice downward."""
        if self.rows <= k:
            return np.arange(self.rows)
        inside, edge, kth = np.zeros_like(self.valid), self.valid, 0
        count = 0
        for power in range(len(sums) - 1, -1, -1):
            ones = edge & sums[power]
            n = count + int(np.bitwise_count(ones).sum())
            if n >= k:
                edge, kth = ones, kth | 1 << power
            else:
                inside, count, edge = inside | ones, n, edge & ~sums[power]
        least = max(0, kth - slack)
        above, equal = np.zeros_like(self.valid), self.valid  # sum > least, sum = least so far
        for power in range(len(sums) - 1, -1, -1):
            if least >> power & 1:
                equal = equal & sums[power]
            else:
                above, equal = above | (equal & sums[power]), equal & ~sums[power]
        bits = np.unpackbits((above | equal).view(np.uint8), bitorder="little")[: self.rows]
        return np.flatnonzero(bits)

    def nearest(self, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows that may be among the k best, ties included, and their exact scores."""
        sums, _ = self.sums(query)
        lost = (1 << self.dropped) - 1
        spread = int(np.abs(query).sum()) * lost  # what the dropped bits can add or take away between two rows
        rows = self.top(sums, k, -(-spread >> self.dropped))
        return rows, self.vectors[rows].astype(np.int64) @ query


# ---------------------------------------------------------------- tables


def integers(vectors: DataFrame, key: str = "vec_id", value: str = "embedding", scale: int = SCALE) -> DataFrame:
    """vec_id, dims, vector (array<long>) of the rows that take part; wide rows have no vector but `wide`, the scaled
    components as doubles."""
    x = F.transform(value, lambda c: c.cast("double") * scale)
    finite = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    wide = F.exists("x", lambda c: F.abs(c) >= LIMIT)
    rows = vectors.where(F.col(key).isNotNull() & (F.size(value) > 0)).select(F.col(key).cast("long").alias("vec_id"), x.alias("x"))
    return rows.where(finite).select(
        "vec_id", F.size("x").alias("dims"), F.when(~wide, F.transform("x", lambda c: F.floor(c).cast("long"))).alias("vector"),
        F.when(wide, F.col("x")).alias("wide"))


def blocks(rows: DataFrame, size: int) -> DataFrame:
    """Rows of equal length in blocks of about `size`, dealt by hash; `rows` is a stored table.

    A task sorts its rows by block and puts each block out as it ends, so it holds one at a time.
    """
    ready(rows.sparkSession)
    number = max(1, -(-rows.count() // size))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, ids, vectors = None, [], []

        def close() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([
                pa.array([current[0]], pa.int32()), pa.array([current[1]], pa.int64()),
                pa.array([np.concatenate(ids).astype("<i8").tobytes()]), pa.array([np.concatenate(vectors).tobytes()])],
                names=["dims", "block", "ids", "vectors"])

        for batch in batches:
            dims, place = (batch.column(i).to_numpy() for i in range(2))
            new = np.flatnonzero((np.diff(dims, prepend=-1) != 0) | (np.diff(place, prepend=-1) != 0))
            for start, end in zip(new, [*new[1:], batch.num_rows]):
                key = (int(dims[start]), int(place[start]))
                if key != current:
                    if ids:
                        yield close()
                    current, ids, vectors = key, [], []
                part = batch.slice(start, end - start)
                ids.append(part.column(2).to_numpy())
                vectors.append(part.column(3).flatten().to_numpy(zero_copy_only=False).astype("<i4"))
        if ids:
            yield close()

    dealt = rows.select("dims", F.pmod(F.xxhash64(F.lit(6), "vec_id", "vector"), F.lit(number)).alias("block"), "vec_id", "vector")
    return dealt.repartition("dims", "block").sortWithinPartitions("dims", "block").mapInArrow(pack, BLOCKS)


def query_sets(queries: DataFrame, most_bytes: int) -> Iterator[list]:
    """The queries in sets of about most_bytes of vectors, dealt by hash; `queries` is a stored table."""
    total = queries.agg(F.coalesce(F.sum(8 * (F.col("dims").cast("long") + 1)), F.lit(0))).first()[0]
    number = max(1, -(-int(total) // most_bytes))
    for n in range(number if total else 0):
        yield queries.where(F.pmod(F.xxhash64(F.lit(7), "vec_id", "vector", "wide"), F.lit(number)) == n).collect()


def whole(row) -> list[int]:
    """The integer vector of a row, wide or not."""
    return row["vector"] if row["vector"] is not None else [math.floor(x) for x in row["wide"]]


FOUND = "query_id long, vec_id long, score long"


def _batch(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    columns = [np.concatenate(c) for c in zip(*parts)] if parts else [np.zeros(0, np.int64)] * 3
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])


def by_index(held: DataFrame, asked: list, k: int) -> DataFrame:
    """The k best rows of every block for each of the queries `asked`."""
    by_length: dict[int, list] = {}
    for row in asked:
        by_length.setdefault(row["dims"], []).append(row)
    shared = held.sparkSession.sparkContext.broadcast(
        {d: (np.array([r["vec_id"] for r in rows], np.int64), np.array([r["vector"] for r in rows], np.int64))
         for d, rows in by_length.items()})

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                query_ids, wanted = shared.value.get(row["dims"], ((), ()))
                if not len(query_ids):
                    continue
                ids = np.frombuffer(row["ids"], "<i8")
                index = Slices(np.frombuffer(row["vectors"], "<i4").reshape(len(ids), row["dims"]).astype(np.int64))
                copies = dict(zip(*(c.tolist() for c in np.unique(ids, return_counts=True))))
                out = []
                for query_id, query in zip(query_ids.tolist(), wanted):
                    found, scores = index.nearest(query, k + copies.get(query_id, 0))
                    other = ids[found] != query_id
                    found, scores = ids[found[other]], scores[other]
                    best = np.lexsort((found, -scores))[:k]
                    out.append((np.full(len(best), query_id), found[best], scores[best]))
                yield _batch(out)

    return held.select("dims", "ids", "vectors").mapInArrow(meet, FOUND)


def by_product(rows: DataFrame, asked: list, k: int) -> DataFrame:
    """The k best rows of every batch for each of the queries `asked`, by exact products of whole numbers of any size."""
    shared = rows.sparkSession.sparkContext.broadcast([(r["vec_id"], r["dims"], whole(r)) for r in asked])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [(r["vec_id"], r["dims"], whole(r)) for r in batch.to_pylist()]
            out = []
            for query_id, dims, query in shared.value:
                scored = [(-max(-LONGEST - 1, min(LONGEST, sum(map(mul, query, v)))), i)
                          for i, d, v in held if d == dims and i != query_id]
                best = heapq.nsmallest(k, scored)
                out.append((np.full(len(best), query_id), np.array([i for _, i in best], np.int64),
                            np.array([-s for s, _ in best], np.int64)))
            yield _batch(out)

    return rows.select("vec_id", "dims", "vector", "wide").mapInArrow(meet, FOUND)


def search(queries: DataFrame, rows: DataFrame, k: int = 10, query_bytes: int = QUERY_BYTES, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows of every query, ties to the smaller id.

    Both sides come from `integers`, stored. Every row meets every query of its length, a set of queries at a time.
    """
    spark = rows.sparkSession
    ready(spark)
    held = store(blocks(rows.where("wide is null"), block_rows), "row-blocks")
    wide = rows.where("wide is not null")
    any_wide = not wide.isEmpty()
    found = spark.createDataFrame([], FOUND)
    for asked in query_sets(queries.where("wide is null"), query_bytes):
        part = by_index(held, asked, k)
        found = found.unionByName(store(part.unionByName(by_product(wide, asked, k)) if any_wide else part, "found"))
    if any_wide:
        for asked in query_sets(queries.where("wide is not null"), query_bytes):
            found = found.unionByName(store(by_product(rows, asked, k), "found"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")


def op6_bit_sliced_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = store(integers(table(spark, sf_dir, "embeddings")), "integer-vectors")
    queries = rows.where(F.col("vec_id") % 100 == 0)
    return search(queries, rows)


OP6_SQL = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.x, c.x), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.x) = len(c.x) WHERE q.vec_id % 100 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
  FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10"""
