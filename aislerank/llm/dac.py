"""Token ids as directly addressable codes: any token is read without decoding a block.

An id is cut into chunks of `CHUNK` bits, the lowest first. Level k holds the k-th chunks of the ids that reach it, a
bitmap that says which of them go on to level k + 1, and a rank directory: the number of set bits before every block of
`BLOCK` bits. The place of an id on the next level is the rank of its bit, so one id costs one step for each level.

A file is a Parquet folder of segments in ascending doc_id order (null first, equal ids by text). A segment holds whole
documents: their ids and first positions, and one coded buffer. Null and empty texts are documents that hold the end id
alone; an empty table gives an empty file; other columns are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from aislerank.llm import tokens
from aislerank.llm.common import ready, table
from aislerank.session import scratch_path

CHUNK = 8
BLOCK = 512
_MAGIC = b"DAC1"

SEGMENT = "part int, segment int, n_ids long, doc_ids array<long>, starts array<long>, codes binary"


# ---------------------------------------------------------------- codes


def encode(ids: np.ndarray) -> bytes:
    """Header, then per level: chunks, continuation bitmap, rank directory."""
    rest = ids.astype(np.uint32, copy=False)
    levels = []
    while True:
        more = (rest >> CHUNK) > 0
        bits = np.packbits(more, bitorder="little")
        bits = np.concatenate([bits, np.zeros(-len(bits) % (BLOCK // 8), np.uint8)])
        per_block = np.bitwise_count(bits.reshape(-1, BLOCK // 8)).sum(axis=1, dtype=np.uint32)
        ranks = np.concatenate([[0], np.cumsum(per_block, dtype=np.uint32)]).astype("<u4")
        levels.append((rest.astype(np.uint8).tobytes(), bits.tobytes(), ranks.tobytes()))
        rest = rest[more] >> CHUNK
        if not len(rest):
            break
    head = struct.pack("<4sI", _MAGIC, len(levels)) + b"".join(struct.pack("<I", len(c)) for c, _, _ in levels)
    return head + b"".join(part for level in levels for part in level)


class Codes:
    """A coded buffer. `codes[i]` and `codes.slice(i, j)` read only the bytes of those ids."""

    def __init__(self, buffer: bytes):
        magic, depth = struct.unpack_from("<4sI", buffer)
        if magic != _MAGIC:
            raise ValueError("not a buffer of directly addressable codes")
        counts = struct.unpack_from(f"<{depth}I", buffer, 8)
        at = 8 + 4 * depth
        self.levels = []
        for n in counts:
            blocks = -(-(-(-n // 8)) // (BLOCK // 8))
            chunks = np.frombuffer(buffer, np.uint8, n, at)
            bits = np.frombuffer(buffer, np.uint8, blocks * BLOCK // 8, at + n)
            ranks = np.frombuffer(buffer, "<u4", blocks + 1, at + n + len(bits))
            self.levels.append((chunks, bits, ranks))
            at += n + len(bits) + 4 * len(ranks)

    def __len__(self) -> int:
        return len(self.levels[0][0])

    @staticmethod
    def _rank(bits: np.ndarray, ranks: np.ndarray, i: int) -> int:
        """Set bits before bit i: the directory's count and the bits of one block."""
        block = i // BLOCK
        first = block * BLOCK // 8
        whole = int(np.bitwise_count(bits[first : i // 8]).sum())
        left = i % 8
        return int(ranks[block]) + whole + (int(bits[i // 8] & ((1 << left) - 1)).bit_count() if left else 0)

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < len(self):
            raise IndexError(i)
        value = 0
        for k, (chunks, bits, ranks) in enumerate(self.levels):
            value |= int(chunks[i]) << (CHUNK * k)
            if not bits[i // 8] >> (i % 8) & 1:
                break
            i = self._rank(bits, ranks, i)
        return value

    def slice(self, start: int, end: int) -> np.ndarray:
        """Ids start to end (exclusive)."""
        out = np.zeros(max(0, end - start), np.uint32)
        at = np.arange(len(out))
        for k, (chunks, bits, ranks) in enumerate(self.levels):
            if start >= end:
                break
            out[at] |= chunks[start:end].astype(np.uint32) << np.uint32(CHUNK * k)
            lead = start // 8 * 8
            more = np.unpackbits(bits[start // 8 : -(-end // 8)], bitorder="little")[start - lead : end - lead]
            going = np.flatnonzero(more)
            if not len(going):
                break
            start = self._rank(bits, ranks, start)
            end = start + len(going)
            at = at[going]
        return out


# ---------------------------------------------------------------- files


def write(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = 0, segment_ids: int = 1 << 20) -> None:
    """Token ids of all documents, each with the end id after it, as segments under `path`.

    One range exchange puts the texts in order. A segment is closed once it holds `segment_ids` ids; the bound is on
    memory, not on documents, which are never cut.
    """
    ready(docs.sparkSession)
    vocabulary = vocabulary or tokens.vocabulary_path()

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokens.encoder(vocabulary)
        end = int(end_id).to_bytes(4, "little")
        part = TaskContext.get().partitionId()
        number, ids, starts, held, n = 0, [], [], [], 0

        def close() -> pa.RecordBatch:
            codes = encode(np.frombuffer(b"".join(held), "<u4"))
            return pa.RecordBatch.from_arrays([
                pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([n], pa.int64()),
                pa.array([ids], pa.list_(pa.int64())), pa.array([starts], pa.list_(pa.int64())),
                pa.array([codes], pa.binary())],
                names=["part", "segment", "n_ids", "doc_ids", "starts", "codes"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                coded = coder.ids(text.as_py()) + end
                ids.append(doc_id)
                starts.append(n)
                held.append(coded)
                n += len(coded) // 4
                if n >= segment_ids:
                    yield close()
                    number, ids, starts, held, n = number + 1, [], [], [], 0
        if ids:
            yield close()

    (docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
     .mapInArrow(segments, SEGMENT).write.parquet(path))


def documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document in the files under `path`."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                codes = Codes(row["codes"])
                starts = row["starts"]
                ids = memoryview(codes.slice(0, len(codes)).astype("<u4", copy=False)).cast("B")
                crcs = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(starts, [*starts[1:], len(codes)])]
                n = len(starts)
                yield pa.RecordBatch.from_arrays([
                    pa.array([row["part"]] * n, pa.int32()), pa.array([row["segment"]] * n, pa.int32()),
                    pa.array(row["doc_ids"], pa.int64()), pa.array(starts, pa.int64()),
                    pa.array(np.diff(starts, append=len(codes)), pa.int64()), pa.array(crcs, pa.int64())],
                    names=["part", "segment", "doc_id", "at", "n_tokens", "ids_crc32"])

    files = spark.read.schema(SEGMENT).parquet(path)
    read = files.select("part", "segment", "doc_ids", "starts", "codes").mapInArrow(
        digests, "part int, segment int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return (read.join(first_ids(files), ["part", "segment"])
            .select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32"))


def first_ids(files: DataFrame) -> DataFrame:
    """Number of ids before every segment: running sums over the parts (one row each), then inside a part."""
    manifest = files.select("part", "segment", "n_ids")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    parts = (manifest.groupBy("part").agg(F.sum("n_ids").alias("ids"))
             .select("part", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("part_base")))
    return (manifest.withColumn("in_part", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)))
            .join(parts, "part").select("part", "segment", (F.col("part_base") + F.col("in_part")).alias("base")))


def tokens_of(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """The ids at wanted positions (column position), each read from its segment by direct access.

    Output: position, token. Positions outside the file are left out.
    """
    ready(spark)
    files = spark.read.schema(SEGMENT).parquet(path)
    bases = first_ids(files).join(files.select("part", "segment", "n_ids"), ["part", "segment"])
    size = 1 << 20
    cells = bases.select("part", "segment", "base", "n_ids", F.explode(F.sequence(
        F.floor(F.col("base") / size), F.floor((F.col("base") + F.col("n_ids") - 1) / size))).alias("cell"))
    asked = (wanted.select("position", F.floor(F.col("position") / size).alias("cell")).join(cells, "cell")
             .where("position >= base and position < base + n_ids")
             .select("part", "segment", (F.col("position") - F.col("base")).alias("at"), "position"))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                codes = Codes(row["codes"])
                yield pa.RecordBatch.from_arrays([
                    pa.array([p["position"] for p in row["asked"]], pa.int64()),
                    pa.array([codes[p["at"]] for p in row["asked"]], pa.int64())], names=["position", "token"])

    # a segment meets at most as many rows of its positions as it has ids / 4096, each a bounded list
    lists = asked.groupBy("part", "segment", F.floor(F.col("at") / 4096).alias("slot")).agg(
        F.collect_set(F.struct("position", "at")).alias("asked"))
    return (lists.join(files.select("part", "segment", "codes"), ["part", "segment"])
            .select("asked", "codes").mapInArrow(pick, "position long, token long"))


def op9_direct_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "direct-codes")
    write(table(spark, sf_dir, "documents"), path)
    return documents(spark, path)
