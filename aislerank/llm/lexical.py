"""Ranked lexical search by one automaton that scans the documents; documents get no index.

The terms of all items, each between two boundary marks, form one Aho-Corasick automaton. A text is reduced to its terms
with one boundary mark between them, so that a match is a whole term, and the automaton's outputs are the term's number.
Every output maps to the items that hold the term. Texts are scanned twice: once for the counts over all documents (N, L
and df), once to score. Each task keeps the `k` best documents of every item, which is all that is shuffled.

Items are dealt to blocks of at most BLOCK_BYTES of terms (an item is never divided), and every block is a search of its
own over all documents: this bounds what is broadcast and gathered on the driver, however many items there are.

A null or empty text has no term: such a document is not counted and never found, such an item gets no row. Every row of
the items is an item of its own, also if ids repeat; every row of the documents is a document. Equal scores go by
ascending doc_id, null ids last. Empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from aislerank.llm.common import ready, store, table

#: Terms of a block of items, in bytes, each item counting ITEM_BYTES more.
BLOCK_BYTES = 1 << 21
ITEM_BYTES = 64
#: Cells (documents x items) and postings that are scored at once.
CELLS = 1 << 21

#: What a term is made of, and the only letters whose case is ignored.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_MARKS = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256)).lower()
_DOCUMENTS, _TERMS = -1, -2


# ---------------------------------------------------------------- the automaton


def guarded(text: bytes) -> bytes:
    """The lower-cased terms of a text in UTF-8; other characters are boundary marks."""
    return b" " + text.translate(_MARKS) + b" "


class Scanner:
    """Automaton over whole terms. `counts` gives the number of terms of a text and tf by the place of a term in the list."""

    def __init__(self, terms: list[bytes]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for place, term in enumerate(terms):
            self.automaton.add_word(guarded(term).decode("latin-1"), place)
        self.automaton.make_automaton()

    def counts(self, text: bytes) -> tuple[int, Counter]:
        line = guarded(text)
        return len(line.split()), Counter(map(itemgetter(1), self.automaton.iter(line.decode("latin-1"))))


_SCANNERS: dict[str, Scanner] = {}


def _scanner(model: dict) -> Scanner:
    """One automaton for each worker process; the one of the block before is let go."""
    if model["name"] not in _SCANNERS:
        _SCANNERS.clear()
        _SCANNERS[model["name"]] = Scanner(model["terms"])
    return _SCANNERS[model["name"]]


class Best:
    """The k best (score, doc_id) of every item seen so far."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.least = np.ones(items, np.int64)  # a score must reach this to count
        self.held = [np.zeros(0, np.int64) for _ in range(4)]  # item, score, no id, doc_id

    def offer(self, scores: np.ndarray, no_id: np.ndarray, doc_ids: np.ndarray) -> None:
        """scores: documents x items."""
        row, item = np.nonzero(scores >= self.least)
        if not len(row):
            return
        new = (item, scores[row, item], no_id[row], doc_ids[row])
        item, score, null, doc = (np.concatenate(pair) for pair in zip(self.held, new))
        order = np.lexsort((doc, null, -score, item))
        item, score, null, doc = item[order], score[order], null[order], doc[order]
        starts = np.flatnonzero(np.diff(item, prepend=-1))
        rank = np.arange(len(item)) - np.repeat(starts, np.diff(starts, append=len(item)))
        full = rank == self.k - 1
        self.least[item[full]] = score[full]
        self.held = [column[rank < self.k] for column in (item, score, null, doc)]


class Scores:
    """Scores documents a chunk at a time; a chunk is bounded by its cells and by its postings."""

    def __init__(self, model: dict, k: int):
        self.start, self.item, self.times = model["start"], model["item"], model["times"]
        self.weights, self.n, self.terms, self.items = model["weights"], model["documents"], model["length"], model["items"]
        self.best = Best(self.items, k)
        self.clear()

    def clear(self) -> None:
        self.docs, self.found, self.tf, self.m, self.postings = [], [], [], [], 0

    def add(self, doc_id: int | None, length: int, tf: Counter) -> None:
        if not tf:
            return
        found = np.fromiter(tf.keys(), np.int64, len(tf))
        self.docs.append(doc_id)
        self.found.append(found)
        self.tf.append(np.fromiter(tf.values(), np.int64, len(tf)))
        self.m.append(100 - 75 + (75 * length * self.n) // self.terms)
        self.postings += int((self.start[found + 1] - self.start[found]).sum())
        if len(self.docs) * self.items >= CELLS or self.postings >= CELLS:
            self.flush()

    def flush(self) -> None:
        if not self.docs:
            return
        many = [len(f) for f in self.found]
        row, found, tf = np.repeat(np.arange(len(many)), many), np.concatenate(self.found), np.concatenate(self.tf)
        part = self.weights[found] * ((1_000_000_000 * tf) // (1000 * tf + 8 * np.repeat(np.array(self.m, np.int64), many)))
        size = self.start[found + 1] - self.start[found]
        ends = np.cumsum(size)
        posting = np.arange(int(ends[-1])) + np.repeat(self.start[found] - (ends - size), size)
        scores = np.zeros(len(many) * self.items, np.int64)
        np.add.at(scores, np.repeat(row, size) * self.items + self.item[posting], np.repeat(part, size) * self.times[posting])
        no_id = np.array([d is None for d in self.docs], np.int64)
        self.best.offer(scores.reshape(-1, self.items), no_id, np.array([d or 0 for d in self.docs], np.int64))
        self.clear()


# ---------------------------------------------------------------- tables


def item_terms(items: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """item (a number of the row), item_id, found (its terms, repeats included) of the rows with a term."""
    found = F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(TERM), F.lit(0))
    rows = items.select(F.col(key).alias("item_id"), F.monotonically_increasing_id().alias("item"), found.alias("found"))
    return store(rows.where(F.size("found") > 0), "items")


def blocks_of(items: DataFrame, block_bytes: int) -> DataFrame:
    """items with the number of their block: as many blocks, dealt by hash, as none needs more than block_bytes.

    Blocks are made finer until this holds, or until an item alone is above it.
    """
    cost = F.aggregate("found", F.lit(ITEM_BYTES).cast("long"), lambda sum, t: sum + F.octet_length(t).cast("long"))
    costs = items.select("item", cost.alias("cost"))
    total, largest = costs.agg(F.coalesce(F.sum("cost"), F.lit(0)), F.coalesce(F.max("cost"), F.lit(0))).first()
    number = max(1, -(-int(total) // block_bytes))
    block = F.pmod(F.xxhash64(F.lit(11), "item"), F.lit(number))
    while number > 1:
        most = costs.groupBy(block).agg(F.sum("cost").alias("cost")).agg(F.max("cost")).first()[0]
        if most <= max(block_bytes, largest):
            break
        number *= 2
        block = F.pmod(F.xxhash64(F.lit(11), "item"), F.lit(number))
    return items.withColumn("block", block)


def _postings(block: DataFrame) -> dict:
    """Terms of a block, and by term the places of the items that hold it and how often. Bounded by the block."""
    rows = (block.select("item", F.explode("found").alias("term")).groupBy("term", "item").agg(F.count("*").alias("times"))
            .toPandas().sort_values(["term", "item"], ignore_index=True))
    terms, start = np.unique(rows["term"].to_numpy(str), return_index=True)
    keys, item = np.unique(rows["item"].to_numpy(np.int64), return_inverse=True)
    return {"name": uuid.uuid4().hex, "terms": [t.encode() for t in terms.tolist()], "start": np.append(start, len(rows)),
            "item": item, "times": rows["times"].to_numpy(np.int64), "keys": keys, "items": len(keys)}


def corpus_counts(docs: DataFrame, shared) -> tuple[int, int, np.ndarray]:
    """N, L and df of every term, counted by the automaton over all documents."""
    terms = len(shared.value["terms"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(shared.value)
        df, n, length = np.zeros(terms, np.int64), 0, 0
        for batch in batches:
            for text in batch.column(0):
                if text.is_valid:
                    own, tf = scanner.counts(text.as_py())
                    n, length = n + (own > 0), length + own
                    df[np.fromiter(tf.keys(), np.int64, len(tf))] += 1
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([
            pa.array(np.append(some, [_DOCUMENTS, _TERMS])), pa.array(np.append(df[some], [n, length]))], names=["place", "n"])

    rows = (docs.select(F.col("text").cast("binary")).mapInArrow(count, "place long, n long")
            .groupBy("place").agg(F.sum("n").alias("n")).collect())  # one row for each term of a block at most
    found = {r["place"]: r["n"] for r in rows}
    df = np.zeros(terms, np.int64)
    for place, n in found.items():
        if place >= 0:
            df[place] = n
    return found.get(_DOCUMENTS, 0), found.get(_TERMS, 0), df


def weights_of(n: int, df: np.ndarray) -> np.ndarray:
    by_df = {d: math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for d in set(df.tolist())}
    return np.array([by_df[d] for d in df.tolist()], np.int64)


def search_block(docs: DataFrame, block: DataFrame, k: int) -> DataFrame | None:
    """item, doc_id, score: at least the k best documents of every item of a block."""
    spark = docs.sparkSession
    model = _postings(block)
    if not model["terms"]:
        return None
    n, length, df = corpus_counts(docs, spark.sparkContext.broadcast(model))
    if not n:
        return None
    shared = spark.sparkContext.broadcast(model | {"weights": weights_of(n, df), "documents": n, "length": length})

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner, scores = _scanner(shared.value), Scores(shared.value, k)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if text.is_valid:
                    scores.add(doc_id, *scanner.counts(text.as_py()))
        scores.flush()
        item, value, null, doc = scores.best.held
        yield pa.RecordBatch.from_arrays([
            pa.array(shared.value["keys"][item]), pa.array(doc, mask=null.astype(bool)), pa.array(value)],
            names=["item", "doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(
        score, "item long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of every row of items (item_id, text)."""
    spark = docs.sparkSession
    ready(spark)
    dealt = blocks_of(item_terms(items), block_bytes)
    found = None
    for number in sorted(r[0] for r in dealt.select("block").distinct().collect()):
        part = search_block(docs, dealt.where(F.col("block") == number), k)
        if part is not None:
            part = store(part, "found")
            found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], "item long, doc_id long, score long")
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.join(dealt.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def op11_term_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP11_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS terms FROM documents),
b AS (SELECT row_number() OVER () AS i, item_id,
    regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS terms FROM benchmark),
s AS (SELECT count(*) FILTER (len(terms) > 0) AS docs, sum(len(terms))::BIGINT AS words FROM d),
q AS (SELECT i, item_id, term, count(*) AS c FROM (SELECT i, item_id, unnest(terms) AS term FROM b) GROUP BY ALL),
t AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(terms) AS n, unnest(terms) AS term FROM d)
  WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
  FROM (SELECT term, count(*) AS df FROM t GROUP BY term), s),
p AS (SELECT r, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + ((75 * n * docs) // words)))) AS part
  FROM t JOIN w USING (term), s),
z AS (SELECT i, item_id, r, doc_id, sum(c * part)::BIGINT AS score FROM q JOIN p USING (term) GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank FROM z WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM o WHERE rank <= 10"""
