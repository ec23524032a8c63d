"""Secret scans over a trigram inverted index.

From every rule's regular expression a Boolean query over byte trigrams is derived that each matching text satisfies. A
task indexes its documents in segments: the postings of the trigrams that the rules ask for, over texts lower-cased from
A to Z. The query intersects and unites postings; only its candidates are verified with the expression itself. A rule
whose expression forces no trigram is verified on every text of the segment.

Texts are read whole; a null text is an empty one. A span is (kind, start, end) in code points, end exclusive; the spans
of a kind do not overlap. An empty table gives no rows, repeated rows one each. `mask` keeps all columns.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce
from re import _constants as C
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aislerank.llm.common import ready, table


@dataclass(frozen=True)
class Rule:
    """A match counts if the group has at least `least` characters; matches are taken before that test."""

    kind: str
    pattern: str
    least: int = 1
    group: int = 0
    any_case: bool = False

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.A | (re.I if self.any_case else 0))


#: The three kinds every scan reports.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2, True),
    Rule("access", r"AKIA[A-Z0-9]+", 16),
    Rule("hex", r"[0-9a-f]{32,}"),  # maximal runs, so the same as runs of any length of which 32+ are kept
)

#: Public key formats that the scan adds.
ADDED = (
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE + ADDED

SPANS = "array<struct<kind:string,start:long,end:long>>"

# ---------------------------------------------------------------- trigram queries

#: A query is None (any text), a trigram, or ("and" | "or", parts).
Query = None | bytes | tuple


def _both(kind: str, parts: list[Query]) -> Query:
    if kind == "and":
        parts = [p for p in parts if p is not None]
    elif any(p is None for p in parts):
        return None
    parts = list(dict.fromkeys(parts))
    return None if not parts else parts[0] if len(parts) == 1 else (kind, tuple(parts))


def _of_strings(strings: set[bytes]) -> Query:
    """One of these strings is in the text."""
    return _both("or", [_both("and", [s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)])


def _walk(nodes: list, most: int = 64) -> tuple[set[bytes] | None, Query]:
    """The strings a part of an expression stands for (None: too many or unbounded), and what it forces."""
    open_strings: set[bytes] = {b""}
    forced: list[Query] = []
    exact = True

    def close() -> None:
        nonlocal open_strings, exact
        forced.append(_of_strings(open_strings))
        open_strings, exact = {b""}, False

    for kind, value in nodes:
        strings: set[bytes] | None = None
        inner: Query = None
        if kind is C.LITERAL:
            strings = {chr(value).encode().lower()}
        elif kind is C.IN and all(k is C.LITERAL for k, _ in value) and len(value) <= 8:
            strings = {chr(c).encode().lower() for _, c in value}
        elif kind is C.SUBPATTERN:
            strings, inner = _walk(value[-1])
        elif kind is C.BRANCH:
            arms = [_walk(arm) for arm in value[1]]
            strings = set().union(*(s for s, _ in arms)) if all(s is not None for s, _ in arms) else None
            inner = _both("or", [_both("and", [_of_strings(s) if s is not None else None, q]) for s, q in arms])
        elif kind in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
            low, high, body = value
            found, inner = _walk(body)
            if low == 0:
                inner = None
            if found is not None and high == 1:
                strings = found | ({b""} if low == 0 else set())
            elif found is not None and low == high and low <= 8:
                strings = reduce(lambda a, _: {x + y for x in a for y in found}, range(low), {b""})
            elif found is not None and low > 0:
                inner = _both("and", [inner, _of_strings(found)])
        elif kind is C.AT:
            strings = {b""}
        if strings is not None and len(strings) * len(open_strings) <= most:
            open_strings = {a + b for a in open_strings for b in strings}
            forced.append(inner)
        else:
            close()
            forced.append(inner)
            if strings is not None:
                forced.append(_of_strings(strings))
    if exact:
        return open_strings, _both("and", forced)
    forced.append(_of_strings(open_strings))
    return None, _both("and", forced)


def trigram_query(rule: Rule) -> Query:
    strings, forced = _walk(list(_parser.parse(rule.pattern)))
    return _both("and", [forced, _of_strings(strings) if strings is not None else None])


def _trigrams(query: Query) -> set[bytes]:
    if query is None:
        return set()
    return {query} if isinstance(query, bytes) else set().union(*map(_trigrams, query[1]))


# ---------------------------------------------------------------- segments


class TrigramIndex:
    """Postings (ascending document numbers) of the wanted trigrams in a segment of texts."""

    def __init__(self, texts: list[bytes], wanted: tuple[bytes, ...], piece: int = 1 << 22):
        codes, numbers = _numbering(wanted)
        buffer = np.frombuffer(b"\0".join(texts).lower(), np.uint8)
        ends = np.cumsum([len(t) + 1 for t in texts])
        found = [[] for _ in wanted]
        for at in range(0, max(0, len(buffer) - 2), piece):
            part = buffer[at : at + piece + 2].astype(np.uint32)
            number = numbers[(part[:-2] << 16) | (part[1:-1] << 8) | part[2:]]
            hits = np.flatnonzero(number)
            documents = np.searchsorted(ends, hits + at, side="right")
            key = np.unique(number[hits].astype(np.int64) << 40 | documents)
            for n in np.unique(key >> 40):
                found[n - 1].append(key[key >> 40 == n] & ((1 << 40) - 1))
        self.postings = {t: np.unique(np.concatenate(f)) if f else np.zeros(0, np.int64) for t, f in zip(wanted, found)}
        self.everything = np.arange(len(texts))

    def candidates(self, query: Query) -> np.ndarray:
        if query is None:
            return self.everything
        if isinstance(query, bytes):
            return self.postings[query]
        sets = [self.candidates(q) for q in query[1]]
        return reduce(np.intersect1d if query[0] == "and" else np.union1d, sorted(sets, key=len))


@lru_cache(maxsize=4)
def _numbering(wanted: tuple[bytes, ...]) -> tuple[list[int], np.ndarray]:
    codes = [int.from_bytes(t, "big") for t in wanted]
    numbers = np.zeros(1 << 24, np.int16)
    numbers[codes] = np.arange(1, len(codes) + 1)
    return codes, numbers


def spans_of(text: str, rule: Rule, compiled: re.Pattern) -> list[tuple[str, int, int]]:
    return [(rule.kind, m.start(), m.end()) for m in compiled.finditer(text)
            if m.end(rule.group) - m.start(rule.group) >= rule.least]


def scan_texts(texts: list[str], rules: tuple[Rule, ...], segment_bytes: int = 1 << 24) -> Iterator[list]:
    """The spans of each text, by start, then by the rules' order."""
    queries = [trigram_query(r) for r in rules]
    compiled = [r.compiled() for r in rules]
    wanted = tuple(sorted(set().union(*map(_trigrams, queries))))
    order = {r.kind: n for n, r in enumerate(rules)}

    def segment(part: list[str], coded: list[bytes]) -> Iterator[list]:
        index = TrigramIndex(coded, wanted)
        found: list[list] = [[] for _ in part]
        for rule, query, pattern in zip(rules, queries, compiled):
            for n in index.candidates(query).tolist():
                found[n] += spans_of(part[n], rule, pattern)
        for spans in found:
            yield sorted(spans, key=lambda s: (s[1], order[s[0]]))

    part, coded, size = [], [], 0
    for text in texts:
        part.append(text)
        coded.append(text.encode("utf-8", "surrogatepass"))
        size += len(coded[-1])
        if size >= segment_bytes:
            yield from segment(part, coded)
            part, coded, size = [], [], 0
    if part:
        yield from segment(part, coded)


# ---------------------------------------------------------------- tables


def find(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and spans of every row."""
    ready(docs.sparkSession)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            spans = [[dict(zip(("kind", "start", "end"), s)) for s in row] for row in scan_texts(texts, rules)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], names=["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(scan, f"doc_id long, spans {SPANS}")


def masked_text(text: str, spans: list[tuple[str, int, int]], mark: str) -> str:
    """The text with every stretch that spans cover replaced by one mark."""
    out, at = [], 0
    for _, start, end in sorted(spans, key=lambda s: s[1]):
        if end <= at:
            continue
        if start >= at:
            out += [text[at:start], mark]
        at = end
    return "".join([*out, text[at:]])


def mask(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "[SECRET]") -> DataFrame:
    """The same rows and columns with the secrets in `text` replaced by a mark; null texts stay null."""
    ready(docs.sparkSession)
    place = docs.columns.index("text")

    def cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(place).to_pylist()
            new = [masked_text(t, s, mark) if s else t
                   for t, s in zip(texts, scan_texts([t or "" for t in texts], rules))]
            yield batch.set_column(place, "text", pa.array(new, batch.schema.field(place).type))

    return docs.mapInArrow(cover, docs.schema)


def op10_trigram_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    def of(*kinds: str):
        return F.filter("spans", lambda span: span["kind"].isin(*kinds))

    def joined(column):
        return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    counts = [F.size(of(rule.kind)).cast("long").alias(f"n_{rule.kind}") for rule in BASE]
    base = of(*[rule.kind for rule in BASE])
    return find(table(spark, sf_dir, "documents")).select(
        "doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
