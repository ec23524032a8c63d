"""Best-fit packing of token pieces into sequences, improved by swap-based local search.

Documents become token ids with an end id; longer ones than a sequence are cut, the first piece taking what is left
over. Pieces are dealt by hash to groups of bounded size, and each group is packed by itself: best fit in order of
falling length, then local search. The search takes the emptiest bin and hands its pieces on: it moves one, exchanges one
for one, two for one or one for two with a fuller bin, each time raising the sum of squared fills, until the bin is empty
or nothing fits; then the next one gives. It ends when the bins reach the bound total / capacity, or when no bin can give any more.

Null and empty texts are one end id. Repeated rows are packed once each. An empty table packs to no rows; other columns
are not read. Null ids are kept as they are.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aislerank.llm import tokens
from aislerank.llm.common import ready, store, table

CAPACITY = 1024
END_ID = 2
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, vocabulary: str | None = None,
           with_ids: bool = False) -> DataFrame:
    """Pieces of every document; with_ids adds the ids themselves (array<int>)."""
    ready(docs.sparkSession)
    vocabulary = vocabulary or tokens.vocabulary_path()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokens.encoder(vocabulary)
        end = int(end_id).to_bytes(4, "little")
        for batch in batches:
            out: list[tuple] = []
            ids = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                coded = coder.ids(text.as_py()) + end
                first = (len(coded) // 4 - 1) % capacity + 1
                bounds = [0, *range(first, len(coded) // 4 + 1, capacity)]
                for n, (a, b) in enumerate(zip(bounds, bounds[1:])):
                    part = coded[4 * a : 4 * b]
                    out.append((doc_id, n, a, b - a, zlib.crc32(part)))
                    if with_ids:
                        ids.append(np.frombuffer(part, "<u4").astype(np.int32))
            columns = list(zip(*out)) or [()] * 5
            arrays = [pa.array(c, t) for c, t in zip(
                columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                arrays.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return docs.select("doc_id", "text").mapInArrow(cut, PIECE + (", ids array<int>" if with_ids else ""))


# ---------------------------------------------------------------- one group


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Pieces (by place in `lengths`, longest first) into the fullest bin that still holds them."""
    bins: list[list[int]] = []
    room: list[tuple[int, int]] = []  # free space and bin, ascending
    for item in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        at = bisect_left(room, (lengths[item], -1))
        if at < len(room):
            free, number = room.pop(at)
        else:
            free, number = capacity, len(bins)
            bins.append([])
        bins[number].append(item)
        if free > lengths[item]:
            insort(room, (free - lengths[item], number))
    return bins


def _exchange(giver: list[int], taker: list[int], gap: int, lengths: list[int]) -> tuple[int, list[int], list[int]] | None:
    """The exchange that carries most tokens from giver to taker, at most `gap`: (tokens, given, given back)."""
    best: tuple[int, list[int], list[int]] | None = None
    most = 0
    give = [([i], lengths[i]) for i in giver]
    give += [([i, j], lengths[i] + lengths[j]) for n, i in enumerate(giver) for j in giver[:n]]
    back: list[tuple[list[int], int]] = [([], 0)] + [([i], lengths[i]) for i in taker]
    back += [([i, j], lengths[i] + lengths[j]) for n, i in enumerate(taker) for j in taker[:n]]
    back.sort(key=lambda x: x[1])
    sums = [s for _, s in back]
    for given, size in give:
        for n in range(bisect_left(sums, size - gap), len(sums)):  # the smallest return that still fits
            returned, cost = back[n]
            if size - cost <= most:
                break
            if len(given) + len(returned) <= 3:
                best, most = (size - cost, given, returned), size - cost
                break
        if most == gap:
            break
    return best


def local_search(bins: list[list[int]], lengths: list[int], capacity: int, patience: int = 16) -> list[list[int]]:
    """Pass pieces from emptier bins to fuller ones until the emptiest are empty.

    The emptiest bin gives first. One that no exchange can make emptier is set aside until another bin has changed, and
    the next one gives; so gaps gather in few bins. `patience` such bins in a row end the search. Each step raises the
    sum of squared fills, so it ends.
    """
    fill = [sum(lengths[i] for i in b) for b in bins]
    least = -(-sum(fill) // capacity)
    alive = {n for n in range(len(bins)) if fill[n] < capacity}
    count, aside = len(bins), set()
    while count > least and len(aside) < min(patience, len(alive)):
        donor = min(alive - aside, key=lambda n: (fill[n], n))
        before = fill[donor]
        for n in sorted(alive - {donor}, key=lambda n: (fill[n], n), reverse=True):
            found = _exchange(bins[donor], bins[n], capacity - fill[n], lengths)
            # tokens * (fill[taker] - fill[giver] + tokens) > 0: the squares grow
            if found and fill[n] - fill[donor] + found[0] > 0:
                moved, given, returned = found
                bins[donor] = [i for i in bins[donor] if i not in given] + returned
                bins[n] = [i for i in bins[n] if i not in returned] + given
                fill[n] += moved
                fill[donor] -= moved
                if fill[n] == capacity:
                    alive.discard(n)
                if not bins[donor]:
                    break
        if not bins[donor]:
            alive.discard(donor)
            count -= 1
        aside = aside | {donor} if fill[donor] == before else set()
    return [b for b in bins if b]


def pack_lengths(lengths: list[int], capacity: int) -> list[list[int]]:
    return local_search(best_fit(lengths, capacity), lengths, capacity)


# ---------------------------------------------------------------- all groups


def pack(cut: DataFrame, capacity: int = CAPACITY, group_pieces: int = 4096) -> DataFrame:
    """Place every piece: the columns of `cut` with sequence_id and offset.

    `cut` is read twice (counted, then dealt), so pass a stored table.
    """
    ready(cut.sparkSession)
    groups = max(1, -(-cut.count() // group_pieces))
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def place(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "doc_id", "piece", "ids_crc32"], ignore_index=True)
        lengths = frame["length"].tolist()
        sequence, offset = np.zeros(len(frame), np.int64), np.zeros(len(frame), np.int64)
        for number, members in enumerate(pack_lengths(lengths, capacity)):
            at = 0
            for item in members:
                sequence[item], offset[item] = number, at
                at += lengths[item]
        frame["sequence_id"] = sequence * groups + int(frame["bucket"].iloc[0])
        frame["offset"] = offset
        return frame[[*names, "sequence_id", "offset"]].astype({"doc_id": "Int64"})

    dealt = cut.select(*names, F.pmod(F.xxhash64(F.lit(5), "doc_id", "piece", "ids_crc32"), F.lit(groups)).alias("bucket"))
    return dealt.groupBy("bucket").applyInPandas(place, PIECE + ", sequence_id long, offset long")


def sequences(placed: DataFrame, cut_with_ids: DataFrame) -> DataFrame:
    """The packed sequences: sequence_id, ids (array<int>), doc_ids and lengths in place order."""
    keys = ["doc_id", "piece", "start", "length", "ids_crc32"]
    rows = placed.join(cut_with_ids.dropDuplicates(keys).select(*keys, "ids"),
                       [placed[k].eqNullSafe(cut_with_ids[k]) for k in keys]).select(
        "sequence_id", F.struct("offset", placed["doc_id"], placed["length"], "ids").alias("part"))
    held = rows.groupBy("sequence_id").agg(F.sort_array(F.collect_list("part")).alias("parts"))
    return held.select("sequence_id", F.flatten("parts.ids").alias("ids"), F.col("parts.doc_id").alias("doc_ids"),
                       F.col("parts.length").alias("lengths"))


def packed(docs: DataFrame) -> DataFrame:
    return pack(store(pieces(docs), "pieces"))


def op5_swap_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))
