"""SimHash near-duplicates by a segment-popcount embedding.

A text's fingerprint has a bit set where over half of its shingles' hashes have it. A fingerprint is embedded as the
counts of set bits in 16 segments of 4 bits; the Manhattan distance of two embeddings is a lower bound of the Hamming
distance. Every distinct fingerprint visits the unit cells of that grid within distance 1, so two of them within
distance 2 meet in a cell. Fingerprints that meet another one are verified exactly: inside a cell they are filed under
the 64-bit words that lie in it and at most one bit away (4 at most), and two fingerprints differ in at most two bits
exactly when they share such a word. At most 65 fingerprints can share one, so links are stars of bounded lists however
large a group of near copies is; pairs of a group are never listed.

Copies share one fingerprint and are linked through it. Texts without words have fingerprint zero; a null text counts as
one. Null doc_ids are kept and get the smallest non-null id of their component. An empty table gives no rows. Rows that
repeat a doc_id are reported once each; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aislerank.llm.common import ready, row_keyed, store, table
from aislerank.llm.components import components
from aislerank.session import cut

SEED = 42
SEGMENTS = 16


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 of every shingle of the lower-cased (A-Z) words; of the whole sequence if it has fewer words."""
    import xxhash

    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes split at exactly the six spaces
    if not parts:
        return np.zeros(0, "<u8")
    digest = xxhash.xxh64_intdigest
    line = b" ".join(parts)
    if len(parts) <= words:
        return np.array([digest(line, SEED)], "<u8")
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(parts) - words + 1].tolist()
    return np.array([digest(line[a:b], SEED) for a, b in zip(starts, ends[words - 1 :].tolist())], "<u8")


def majority(hashes: np.ndarray) -> int:
    """The 64-bit word of the bits that are set in over half of the hashes."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes), bitorder="little").tobytes(), "little")


def fingerprint(text: str | None, words: int = 3) -> int:
    """Unsigned 64-bit SimHash over the shingles of a text, repeats included."""
    return majority(shingle_hashes(text, words))


def fingerprints(docs: DataFrame, words: int = 3, key: str | None = None) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of every row, and its key if there is such a column."""
    ready(docs.sparkSession)
    keep = [F.col("doc_id").cast("long").alias("doc_id"), *([F.col(key).alias("key")] if key else [])]
    schema = docs.select(*keep).schema.add("fp", "long")

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *kept, texts = batch.columns
            found = np.fromiter((fingerprint(t.as_py(), words) for t in texts), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*kept, pa.array(found.view(np.int64))], names=schema.names)

    return docs.select(*keep, "text").mapInArrow(compute, schema)


def popcounts(fp: Column) -> Column:
    """Set bits of each 4-bit segment, as the 4-bit segments of a long."""
    ones = F.lit(0x1111111111111111)
    parts = [F.shiftrightunsigned(fp, j).bitwiseAND(ones) if j else fp.bitwiseAND(ones) for j in range(4)]
    return parts[0] + parts[1] + parts[2] + parts[3]


def grid_cells(fps: DataFrame) -> DataFrame:
    """fp, own (its embedding) and every grid cell within Manhattan distance 1 of it."""
    steps = F.array(*[F.lit(1 << (4 * j)) for j in range(SEGMENTS)])
    own = F.col("own")
    up = F.transform(steps, lambda s: F.when(own.bitwiseAND(s * 4) == 0, own + s))  # segments below 4 set bits
    down = F.transform(steps, lambda s: F.when(own.bitwiseAND(s * 7) != 0, own - s))
    reach = F.array_compact(F.concat(F.array(own), up, down))
    return fps.select("fp", popcounts(F.col("fp")).alias("own")).select("fp", "own", F.explode(reach).alias("cell"))


def words_in_cell(met: DataFrame) -> DataFrame:
    """fp and the 64-bit words at most one bit from it whose embedding is the cell."""
    fp, step = F.col("fp"), F.col("cell") - F.col("own")
    unit = F.abs(step)
    free = F.when(step > 0, F.bitwise_not(fp)).otherwise(fp)  # bits that may be flipped: zeros to go up, ones to go down
    bits = [F.shiftleft(unit, b) for b in range(4)]
    flips = [F.when(free.bitwiseAND(bit) != 0, fp.bitwiseXOR(bit)) for bit in bits]
    words = F.when(step == 0, F.array(fp)).otherwise(F.array_compact(F.array(*flips)))
    return met.select("fp", F.explode(words).alias("word"))


def links(fps: DataFrame) -> DataFrame:
    """Star links (a, b) that connect distinct fingerprints as the relation "at most two bits differ" does."""
    cells = grid_cells(fps)
    shared = store(cells.groupBy("cell").agg(F.min("fp").alias("low"), F.max("fp").alias("high"))
                   .where("low <> high").select("cell"), "shared-cells")
    met = cells.join(shared, "cell", "left_semi")
    stars = words_in_cell(met).groupBy("word").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
    return (stars.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b"))
            .where((F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2)).distinct())


def near_duplicates(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id that links reach) of every row."""
    found = store(fingerprints(docs, words), "fingerprints")
    firsts = cut(found.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(links(firsts.select("fp")))
    rooted = cut(firsts.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
                 .select("fp", "first", F.coalesce("root", "fp").alias("root")))
    lowest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = store(rooted.join(lowest, "root").select("fp", "component_id"), "components")
    return found.join(classes, "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, words: int = 3) -> DataFrame:
    """The row with the smallest doc_id (a null one last, then by place) of every component; the columns of docs.

    Only row keys and fingerprints are exchanged, and texts once to leave out the rows that go.
    """
    rows, key = row_keyed(docs)
    found = store(fingerprints(rows, words, key), "fingerprints")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    firsts = cut(found.groupBy("fp").agg(F.min(place).alias("first")))
    roots = components(links(firsts.select("fp"))).withColumnRenamed("node", "fp")
    stay = (firsts.join(roots, "fp", "left").groupBy(F.coalesce("root", "fp").alias("root"))
            .agg(F.min("first").alias("first")).select("first.key"))
    gone = store(found.select("key").join(stay, "key", "left_anti"), "dropped-rows")
    return rows.join(gone.withColumnRenamed("key", key), key, "left_anti").select(*docs.columns)


def op4_popcount_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
