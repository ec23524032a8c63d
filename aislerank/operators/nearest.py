"""Exact nearest sparse vectors by an inverted index of prefixes with remaining norms.

Terms have one order, the rare ones first.  If the first term that two vectors share is ``t``, their product is at most
the norm of what the one holds from ``t`` on times the same of the other.  So an entry of a vector is a reason to meet
others only while the norm that remains from it on can still reach the score to beat; what comes after is not indexed.

Terms are cut into bands of neighbouring terms.  A candidate is filed once under every band of its prefix, with its
entries from there on; a large band is cut into pieces by the remaining norm and then by hash.  A source visits a piece
only if its own remaining norm times the highest one of the piece reaches the score that its k-th neighbour has to beat.
In the band of their first shared term two vectors meet with all their shared entries; in later bands they meet with
fewer, which gives a smaller score of the same pair, so the greatest is kept.

Narrow bands leave out more, wide ones meet fewer pairs twice.  What each width would cost is counted from the vectors
and their scores to beat, and the cheapest is taken: long texts with low scores to beat end in one band, in which every
pair meets once.  The result is the same for all.

No table of pairs of blocks exists.  What the driver holds and broadcasts is one row per term and per level of a band,
which the vocabulary bounds.  Inside a visit postings are added up, so work grows with shared entries.

Every row travels once for each piece it meets, so pieces are as large as a task may hold (``ENTRIES``) while there are
tasks for all cores.  A task holds the candidates of one piece, lets its sources pass by and works through both in tiles.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aislerank.session import ship_package, stored

SCORE_DIGITS = 9
# How far rounding may put a score above its bound.
SLACK = 1e-6
LEVELS = 8
# Cells and postings a task adds up at once.
CELLS = 1 << 21
# A term is a dense column where this share of all cells has it on both sides.
DENSE = 0.001
# Common terms that tell the kind of a row, and the numbers of terms that are told apart.
KIND_TERMS, MOST_KINDS = 3, 1 << 20
# Less than any score that counts.
TINY = 1e-30
# Pairs for each wanted one that wait for their exact scores.
MANY = 4
# Cells of rows that are laid open at once.
OPENED = 1 << 17
# Rows of a tile of candidates; a tile of sources has twice as many.
TILE = 2048
# Entries that a task takes in from either side, 12 bytes each.
ENTRIES = 1 << 23
# Entries of a batch that leaves a Python worker.
SENT = 1 << 20
# Entries that may travel at once, however few rows there are.
ROUND = 1 << 26

SCORED = "src string, dst string, score double"


class Bands:
    """Which band a term belongs to, and the pieces of every band of at most ``size`` candidates."""

    def __init__(self, counts: dict[int, int], width: int, size: int, part: int | None = None):
        """``counts``: candidates by term; a band's terms have ``width`` in all, or it has one term.
        ``part``: sources that visit a piece at once."""
        self.terms = np.array(sorted(counts), np.int64)
        self.band = np.zeros(len(self.terms), np.int64)
        held, number = 0, 0
        for i in range(len(self.terms) - 1, -1, -1):  # from the rare terms, which have the high numbers
            n = counts[int(self.terms[i])]
            if held and held + n > width:
                held, number = 0, number + 1
            held += n
            self.band[i] = number
        self.number = number + 1
        self.size = size
        self.part = part or 2 * size

    def of(self, terms: np.ndarray) -> np.ndarray:
        """Band by term; -1 where no candidate has it."""
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[at] == terms, self.band[at], -1)

    def prefixes(self, terms: np.ndarray, weights: np.ndarray, least: float) -> list[tuple[int, int, float]]:
        """(band, entries from there on, their norm) of a vector (terms ascending) while that norm reaches ``least``."""
        norms = np.sqrt(np.cumsum(weights * weights))
        own = self.of(terms)
        last = np.flatnonzero(np.append(own[1:] != own[:-1], True) & (own >= 0) & (norms >= least))
        return list(zip(own[last].tolist(), (last + 1).tolist(), norms[last].tolist()))

    def cut(self, levels: dict[tuple[int, int], tuple[int, float]], visitors: dict[int, int]) -> None:
        """Numbers the pieces.  ``levels``: candidates and highest norm by band and level; ``visitors``: sources by band."""
        self.source_parts = np.ones(self.number, np.int64)
        for band, n in visitors.items():
            self.source_parts[band] = max(1, -(-n // self.part))
        self.pieces: dict[int, list[tuple[float, int, int]]] = {}  # by band: highest norm, first number, how many
        self.first: dict[tuple[int, int], tuple[int, int]] = {}
        total: dict[int, int] = {}
        for (band, _), (n, _) in levels.items():
            total[band] = total.get(band, 0) + n
        number = 0
        for (band, level), (n, norm) in sorted(levels.items()):
            own = self.pieces.setdefault(band, [])
            if own and total[band] <= self.size:  # a small band is one piece
                own[0] = (max(norm, own[0][0]), *own[0][1:])
            else:
                own.append((norm, number, -(-n // self.size)))
                number += own[-1][2]
            self.first[band, level] = own[-1][1:]


    def rounds(self, visitors: dict[int, int], sizes: tuple[tuple[int, int], tuple[int, int]], cores: int) -> list[range]:
        """The pieces in runs: in each about twice as much travels as there is, or what ROUND allows, or what it takes to
        have work for all cores."""
        (n, n_entries), (m, m_entries) = sizes
        pieces = sorted((first, parts, band) for band, own in self.pieces.items() for _, first, parts in own)
        rounds, entries, start, end = [], 0.0, 0, 0
        for first, parts, band in pieces:
            split = int(self.source_parts[band])
            cost = visitors.get(band, 0) * m_entries / max(1, m) + min(self.size, n) * split * n_entries / max(1, n)
            most = max(ROUND, (n_entries + m_entries) * max(2, -(-3 * cores // (2 * split))))
            for piece in range(first, first + parts):
                if entries and entries + cost > most:
                    rounds.append(range(start, piece))
                    start, entries = piece, 0.0
                entries, end = entries + cost, piece + 1
        return [*rounds, range(start, end)]


def _level(norm: float) -> int:
    return min(LEVELS - 1, int(norm * LEVELS))


def _vectors(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    ids, terms, weights = batch.column("id").to_pylist(), batch.column("t"), batch.column("w")
    for name, t, w in zip(ids, terms, weights):
        yield name, t.values.to_numpy(zero_copy_only=False).astype(np.int64), w.values.to_numpy(zero_copy_only=False)


PLACED = "piece long, part long, id string, t array<int>, w array<double>"


class _Placed:
    """Prefixes of a batch of vectors and where they go; only batches of about ``SENT`` entries are ever made of them."""

    def __init__(self, batch: pa.RecordBatch, extra: tuple[str, ...] = ()):
        self.batch, self.extra = batch, extra
        self.rows: list[int] = []
        self.terms: list[np.ndarray] = []
        self.weights: list[np.ndarray] = []
        self.at: list[tuple[int, int, int]] = []  # prefix, piece, part

    def prefix(self, row: int, terms: np.ndarray, weights: np.ndarray) -> None:
        self.rows.append(row)
        self.terms.append(terms)
        self.weights.append(weights)

    def add(self, piece: int, part: int) -> None:
        """The last prefix goes to this piece."""
        self.at.append((len(self.rows) - 1, piece, part))

    def batches(self) -> Iterator[pa.RecordBatch]:
        if not self.at:
            return
        lengths = np.array([len(t) for t in self.terms], np.int64)
        ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
        rows = pa.array(self.rows, pa.int64())
        whole = pa.RecordBatch.from_arrays(
            [self.batch.column("id").take(rows),
             pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(self.terms).astype(np.int32))),
             pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(self.weights))),
             *[self.batch.column(c).take(rows) for c in self.extra]], names=["id", "t", "w", *self.extra])
        at = np.array(self.at, np.int64)
        sent = np.cumsum(lengths[at[:, 0]]) // SENT
        for some in np.split(at, np.flatnonzero(sent[1:] != sent[:-1]) + 1):
            taken = whole.take(pa.array(some[:, 0]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(some[:, 1]), pa.array(some[:, 2]), *taken.columns], names=["piece", "part", *taken.schema.names])


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of about ``SENT`` entries at most."""
    for batch in batches:
        lengths = np.diff(batch.column("t").offsets.to_numpy())
        step = max(1, SENT // max(1, int(lengths.max(initial=1))))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def _spread(name: str, parts: int, seed: int = 0) -> int:
    """Part of an id: the same in every run."""
    return zlib.crc32(name.encode(), seed) % parts if parts > 1 else 0


def _heavy(bands: Bands, terms: np.ndarray, weights: np.ndarray, least: float, heaviest: int | None) -> list[tuple]:
    """The prefixes, or only those of the bands of the heaviest terms."""
    reach = bands.prefixes(terms, weights, least)
    if heaviest is None:
        return reach
    wanted = set(bands.of(terms[np.argsort(-weights, kind="stable")[:heaviest]]).tolist())
    return [r for r in reach if r[0] in wanted]


def count_levels(flat: DataFrame, shared, least: float | None, heaviest: int | None = None) -> list[tuple[int, int, int, int, float]]:
    """(banding, band, level, rows, highest norm) for every banding; ``least`` None: every row's own score to beat.

    At most LEVELS rows for each band reach the driver.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int, int], tuple[int, float]] = {}
        for batch in batches:
            lows = batch.column("low").to_pylist()
            for (_, terms, weights), low in zip(_vectors(batch), lows):
                for number, bands in enumerate(shared.value):
                    for band, _, norm in _heavy(bands, terms, weights, low - SLACK if least is None else least, heaviest):
                        key = (number, band, _level(norm))
                        n, most = found.get(key, (0, 0.0))
                        found[key] = (n + 1, max(norm, most))
        keys, values = list(found), list(found.values())
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[i] for k in keys], pa.int64()) for i in range(3)]
            + [pa.array([n for n, _ in values], pa.int64()), pa.array([x for _, x in values], pa.float64())],
            names=["banding", "band", "level", "n", "norm"])

    rows = flat.mapInArrow(count, "banding long, band long, level long, n long, norm double")
    return [tuple(r) for r in rows.groupBy("banding", "band", "level").agg(F.sum("n"), F.max("norm")).collect()]


def candidate_rows(flat: DataFrame, shared, least: float, heaviest: int | None, wanted: range | None = None) -> DataFrame:
    """Candidates by piece, repeated for each part of the sources of their band; only of the ``wanted`` pieces."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = shared.value
        for batch in _slices(batches):
            rows = _Placed(batch)
            for at, (name, terms, weights) in enumerate(_vectors(batch)):
                for band, n, norm in _heavy(bands, terms, weights, least, heaviest):
                    first, parts = bands.first[band, _level(norm)]
                    piece = first + _spread(name, parts)
                    if wanted is not None and piece not in wanted:
                        continue
                    rows.prefix(at, terms[:n], weights[:n])
                    for part in range(int(bands.source_parts[band])):
                        rows.add(piece, part)
            yield from rows.batches()

    return flat.mapInArrow(place, PLACED)


def source_rows(flat: DataFrame, shared, heaviest: int | None, wanted: range | None = None) -> DataFrame:
    """Sources by the ``wanted`` pieces they visit; in the opening only the highest piece of the bands of their heaviest
    terms."""

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = shared.value
        for batch in _slices(batches):
            rows = _Placed(batch, ("low", "k"))
            lows = batch.column("low").to_pylist()
            for at, ((name, terms, weights), low) in enumerate(zip(_vectors(batch), lows)):
                for band, n, norm in _heavy(bands, terms, weights, low - SLACK, heaviest):
                    part = _spread(name, int(bands.source_parts[band]), 1)
                    pieces = bands.pieces.get(band, [])
                    if heaviest and pieces:
                        top, first, parts = max(pieces)
                        pieces = [(top, first + _spread(name, parts), 1)]
                    rows.prefix(at, terms[:n], weights[:n])
                    for top, first, parts in pieces:
                        if norm * top + SLACK >= low:
                            for piece in range(first, first + parts):
                                if wanted is None or piece in wanted:
                                    rows.add(piece, part)
            yield from rows.batches()

    return flat.mapInArrow(visit, PLACED + ", low double, k long")


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column, and how many each row has."""
    lists = column.combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    return lists.flatten().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy())


def _reaching(scores: np.ndarray, low: np.ndarray, k: np.ndarray, slack: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns whose true score may be among the k best of the row and reach its ``low``, if every score is
    off by ``slack`` at most."""
    reach = scores >= low[:, None]
    many = np.flatnonzero(np.count_nonzero(reach, axis=1) > k)
    if len(many):  # a row's k-th score leaves out most of the rest
        most = int(k[many].max())
        highest = np.sort(np.partition(scores[many], scores.shape[1] - most, axis=1)[:, scores.shape[1] - most :], axis=1)
        kth = highest[np.arange(len(many)), most - k[many]]
        reach[many] &= scores[many] >= (kth - 2 * slack)[:, None]
    at = np.flatnonzero(reach)
    return at // scores.shape[1], at % scores.shape[1]


def best_of_piece(left: pa.Table, right: pa.Table) -> pa.Table:
    """For every source its k best candidates of a piece that reach its score to beat, tile by tile."""
    return _best_of_sorted(left, right.sort_by("id"))


def _kinds(rows: "_Entries") -> np.ndarray:
    """A number for every row by its most common terms: rows of near numbers share terms, tiles of other kinds few."""
    kind = np.zeros(len(rows.n), np.int64)
    for i in range(KIND_TERMS):
        own = np.zeros(len(rows.n), np.int64)
        some = rows.n > i
        own[some] = np.minimum(rows.terms[rows.start[some] + i], MOST_KINDS - 1) + 1
        kind = kind * (MOST_KINDS + 1) + own
    return kind


def _best_of_sorted(left: pa.Table, right: pa.Table) -> pa.Table:
    """The same for candidates in the order of their ids.

    All pairs are scored in single precision.  What such a score can be off by is bounded, and what may still be among the
    best is scored again in double precision: at the end, or before, where equal scores make it too many.
    """
    if not left.num_rows or not right.num_rows:
        return pa.table({"src": pa.array([], pa.string()), "dst": pa.array([], pa.string()), "score": pa.array([], pa.float64())})
    left, right = left.combine_chunks(), right.combine_chunks()
    lows, ks = left.column("low").to_numpy(), np.minimum(left.column("k").to_numpy(), right.num_rows)
    asked, held = _entries(left), _entries(right)
    # Rounding of the factors, the products and the sums, against the greatest norms.
    slack = (min(asked.most, held.most) + 8) * 2.0**-23 * asked.norm * held.norm + 10.0**-SCORE_DIGITS
    kinds, kinds_held = _kinds(asked), _kinds(held)
    order, alike = np.argsort(kinds, kind="stable"), np.argsort(kinds_held, kind="stable")
    tiles = np.arange(0, right.num_rows, TILE)
    src, dst, score = [], [], []
    for first in range(0, left.num_rows, 2 * TILE):
        own = order[first : first + 2 * TILE]
        some, low, k = asked.take(own), lows[own], ks[own]
        least = np.maximum(low, 10.0**-SCORE_DIGITS) - 10.0**-SCORE_DIGITS - slack
        if asked.positive and held.positive:
            least = np.maximum(least, TINY)  # nothing cancels, so a pair without a score shares no term
        best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))

        def settled(rows: np.ndarray, cols: np.ndarray, _: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            value = np.round(_products(rows, cols, some, held), SCORE_DIGITS)
            reach = (value > 0) & (value >= low[rows])
            rows, cols, value = rows[reach], cols[reach], value[reach]
            by = np.lexsort((cols, -value, rows))
            rows, cols, value = rows[by], cols[by], value[by]
            keep = np.arange(len(rows)) - np.searchsorted(rows, rows) < k[rows]
            return rows[keep], cols[keep], value[keep]

        # The tiles of their own kind first, so that the scores to beat are high for the others.
        near = np.searchsorted(kinds_held[alike], kinds[own[len(own) // 2]])
        for at in tiles[np.argsort(np.abs(tiles + TILE / 2 - near), kind="stable")]:
            tile = np.sort(alike[at : at + TILE])
            for rows, cols, value in _scored_tile(some, held.take(tile), least, k, slack):
                if not len(rows):
                    continue
                found = rows, tile[cols], value.astype(np.float64)
                if len(rows) > MANY * int(k[rows[0] : rows[-1] + 1].sum()):
                    found = settled(*found)
                rows, cols, value = (np.concatenate(c) for c in zip(best, found))
                by = np.lexsort((-value, rows))
                rows, cols, value = rows[by], cols[by], value[by]
                kth = np.arange(len(rows)) - np.searchsorted(rows, rows) == k[rows] - 1
                least[rows[kth]] = np.maximum(least[rows[kth]], value[kth] - 2 * slack)
                keep = value >= least[rows]
                best = rows[keep], cols[keep], value[keep]
                if len(best[0]) > MANY * int(k.sum()):
                    best = settled(*best)
        best = settled(*best)
        src.append(own[best[0]])
        dst.append(best[1])
        score.append(best[2])
    return pa.table({
        "src": left.column("id").take(pa.array(np.concatenate(src))), "dst": right.column("id").take(pa.array(np.concatenate(dst))),
        "score": pa.array(np.concatenate(score))})


class _Entries:
    """Sparse rows as arrays: terms and weights of all rows, and how many each row has."""

    def __init__(self, terms: np.ndarray, weights: np.ndarray, n: np.ndarray):
        self.terms, self.weights, self.n = terms, weights, n
        self.start = np.cumsum(n) - n
        self.most = int(n.max(initial=0))

    @cached_property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.n)), self.n)

    @cached_property
    def norm(self) -> float:
        """The greatest norm of a row."""
        start = self.start[self.n > 0]
        return float(np.sqrt(np.add.reduceat(np.square(self.weights), start).max())) if len(start) else 0.0

    @cached_property
    def positive(self) -> bool:
        return bool(self.weights.min(initial=0.0) >= 0)

    def take(self, rows: np.ndarray) -> "_Entries":
        n = self.n[rows]
        stop = np.cumsum(n)
        at = np.arange(int(stop[-1])) + np.repeat(self.start[rows] - (stop - n), n)
        return _Entries(self.terms[at], self.weights[at], n)


def _entries(table: pa.Table) -> _Entries:
    (terms, n), (weights, _) = _flat(table.column("t")), _flat(table.column("w"))
    return _Entries(terms, weights, n.astype(np.int64))


def _scored_tile(left: _Entries, right: _Entries, least: np.ndarray, k: np.ndarray,
                 slack: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, column, score) in single precision of what may be among the best, some rows at a time.

    Entries of a term that many rows on both sides have are multiplied as dense columns, all others are added up
    posting by posting.  ``least`` may rise meanwhile.
    """
    sources, candidates = len(left.n), len(right.n)
    held, wanted = right.terms, left.terms
    top = int(max(held.max(initial=0), wanted.max(initial=0))) + 1
    share = np.bincount(held, minlength=top) / candidates * (np.bincount(wanted, minlength=top) / sources)
    dense = np.flatnonzero(share > DENSE)
    column = np.full(top, -1)
    column[dense] = np.arange(len(dense))

    def matrix(rows: _Entries) -> np.ndarray:
        out = np.zeros((len(rows.n), len(dense)), np.float32)
        some = column[rows.terms] >= 0
        out[rows.row[some], column[rows.terms[some]]] = rows.weights[some]
        return out

    held_dense, wanted_dense = matrix(right).T, matrix(left)
    rare = column[held] < 0
    order = np.argsort(held[rare], kind="stable")
    terms, posted, posted_w = held[rare][order], right.row[rare][order], right.weights[rare][order].astype(np.float32)
    starts = np.searchsorted(terms, np.arange(top + 1))
    rare = (column[wanted] < 0) & (starts[wanted + 1] > starts[wanted])
    asked, asked_w, asked_row = wanted[rare], left.weights[rare].astype(np.float32), left.row[rare]
    start, end = starts[asked], starts[asked + 1]
    first = np.searchsorted(asked_row, np.arange(sources + 1))
    work = np.concatenate([[0], np.cumsum(end - start)])[first]
    k = np.minimum(k, candidates)
    at = 0
    while at < sources:
        most = min(sources, at + max(1, CELLS // candidates))
        step = max(at + 1, min(most, int(np.searchsorted(work, work[at] + CELLS, "right")) - 1))
        entries = slice(first[at], first[step])
        n = (end - start)[entries]
        stop = np.cumsum(n)
        scores = wanted_dense[at:step] @ held_dense
        if len(n) and stop[-1]:
            posting = np.arange(int(stop[-1])) + np.repeat(start[entries] - (stop - n), n)
            cell = np.repeat((asked_row[entries] - at) * candidates, n) + posted[posting]
            np.add.at(scores.reshape(-1), cell, np.repeat(asked_w[entries], n) * posted_w[posting])
        rows, cols = _reaching(scores, least[at:step].astype(np.float32), k[at:step], slack)
        yield rows + at, cols, scores[rows, cols]
        at = step


def _products(rows: np.ndarray, cols: np.ndarray, left: _Entries, right: _Entries) -> np.ndarray:
    """Products of the pairs of a row of the one and a row of the other side in double precision: the longer one is laid
    open, the entries of the shorter one are looked up in it."""
    out = np.zeros(len(rows))
    longer = left.n[rows] >= right.n[cols]
    for some, (a, own), (b, other) in ((longer, (left, rows), (right, cols)), (~longer, (right, cols), (left, rows))):
        pairs = np.flatnonzero(some)
        pairs = pairs[np.argsort(own[pairs], kind="stable")]
        out[pairs] = _looked_up(own[pairs], other[pairs], a, b)
    return out


def _looked_up(rows: np.ndarray, cols: np.ndarray, left: _Entries, right: _Entries) -> np.ndarray:
    out = np.zeros(len(rows))
    top = int(max(left.terms.max(initial=0), right.terms.max(initial=0))) + 1
    cost = np.concatenate([[0], np.cumsum(right.n[cols])])
    number = np.cumsum(np.append(True, rows[1:] != rows[:-1])) if len(rows) else rows
    at = 0
    while at < len(rows):
        # Rows that are opened together, and pairs whose entries are laid out together.
        end = int(min(np.searchsorted(number, number[at] + max(1, OPENED // top)),
                      max(at + 1, np.searchsorted(cost, cost[at] + OPENED, "right") - 1)))
        place = number[at:end] - number[at]
        own = left.take(rows[at:end][np.append(True, place[1:] != place[:-1])])
        opened = np.zeros(len(own.n) * top)
        opened[own.row * top + own.terms] = own.weights
        other = right.take(cols[at:end])
        out[at:end] = np.bincount(other.row, opened[(place * top)[other.row] + other.terms] * other.weights, end - at)
        at = end
    return out


def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Scores from rows by piece, part and side, candidates (side 0, by id) before sources (side 1, alike ones together).

    The candidates of one piece are held; sources are met as they come and then let go.
    """
    at = None
    held: list[pa.RecordBatch] = []
    right: pa.Table | None = None
    waiting: list[pa.RecordBatch] = []

    def met() -> Iterator[pa.RecordBatch]:
        if waiting and right is not None:
            yield from _best_of_sorted(pa.Table.from_batches(waiting), right).to_batches()
        waiting.clear()

    for batch in batches:
        keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("piece", "part", "side")])
        bounds = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for first, end in zip(bounds, bounds[1:]):
            if first == end:
                continue
            piece, part, side = keys[:, first].tolist()
            if (piece, part) != at:
                yield from met()
                at, right = (piece, part), None
                held.clear()
            some = batch.slice(first, end - first)
            if not side:
                held.append(some.select(["id", "t", "w"]))
                continue
            if held:
                right = pa.Table.from_batches(held).combine_chunks()
                held.clear()
            waiting.append(some.select(["id", "t", "w", "low", "k"]))
            if sum(w.num_rows for w in waiting) >= 2 * TILE:
                yield from met()
    yield from met()


def _meet(sources: DataFrame, candidates: DataFrame) -> DataFrame:
    """(src, dst, score), the greatest score of each pair that a visit put out."""
    both = candidates.select("*", F.lit(0.0).alias("low"), F.lit(0).cast("long").alias("k"), F.lit(0).cast("long").alias("side")).unionByName(
        sources.select("*", F.lit(1).cast("long").alias("side")))
    kind = [F.when(F.col("side") == 1, F.try_element_at("t", F.lit(i + 1))) for i in range(KIND_TERMS)]
    dealt = both.repartition("piece", "part").sortWithinPartitions("piece", "part", "side", *kind, "id")
    return dealt.mapInArrow(visits, SCORED).groupBy("src", "dst").agg(F.max("score").alias("score"))


def _counts(rows: DataFrame) -> tuple[int, int]:
    """Rows and entries."""
    return tuple(rows.agg(F.count("*"), F.coalesce(F.sum(F.size("t")), F.lit(0))).first())


def _sizes(held: tuple[int, int], asked: tuple[int, int], size: int, cores: int) -> tuple[int, int]:
    """Candidates of a piece and sources of a part: as many as a task may hold, fewer while cores would be idle, but at
    least ``size`` and twice that if they fit."""
    (n, n_entries), (m, m_entries) = held, asked
    most = [max(1, int(ENTRIES * rows / max(1, entries))) for rows, entries in ((n, n_entries), (m, m_entries))]
    shrink = min(1.0, (n * m / (most[0] * most[1] * 4 * cores)) ** 0.5)
    return tuple(min(top, max(least, int(top * shrink))) for top, least in zip(most, (size, 2 * size)))


def scored(sources: DataFrame, candidates: DataFrame, size: int, widths: int = 6) -> DataFrame:
    """(src, dst, score) with the k best positive products of every source (id, vec, k) among candidates (id, vec), and
    possibly more.  ``vec``: array of (t, w) by ascending t, low t being the common terms; equal ids are not left out.

    Both sides are read several times, so pass written ones.  Pieces are visited in rounds, in each of which little more
    travels than there are vectors; the shuffle files of a round are gone before the next."""
    spark = sources.sparkSession
    ship_package(spark)
    flat = [F.col("id").cast("string").alias("id"), F.col("vec.t").cast("array<int>").alias("t"), F.col("vec.w").alias("w")]
    held = candidates.where(F.size("vec") > 0).select(*flat, F.lit(0.0).alias("low"))
    asked = sources.where(F.size("vec") > 0).select(*flat, F.lit(0.0).alias("low"), F.col("k").cast("long").alias("k"))
    counts = {r["t"]: r["n"] for r in held.select(F.explode("t").alias("t")).groupBy("t").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return spark.createDataFrame([], SCORED)
    cores, sizes = spark.sparkContext.defaultParallelism, (_counts(held), _counts(asked))
    piece, part = _sizes(*sizes, size, cores)

    def met(rows: DataFrame, bandings: list[Bands], least: float, heaviest: tuple = (None, None)) -> DataFrame:
        """The cheapest banding is cut by what it holds, and every source of ``rows`` visits its pieces."""
        shared = spark.sparkContext.broadcast(bandings)
        in_bands = count_levels(held, shared, least, heaviest[1])
        visits = count_levels(rows, shared, None, heaviest[0])
        work, levels, visitors = [0] * len(bandings), [{} for _ in bandings], [{} for _ in bandings]
        for number, band, _, n, _ in visits:
            visitors[number][band] = visitors[number].get(band, 0) + n
        for number, band, level, n, norm in in_bands:
            levels[number][band, level] = (n, norm)
            work[number] += n * visitors[number].get(band, 0)
        best = min(range(len(bandings)), key=lambda i: (work[i], bandings[i].number))
        bandings[best].cut(levels[best], visitors[best])
        chosen = spark.sparkContext.broadcast(bandings[best])
        rounds = bandings[best].rounds(visitors[best], sizes, cores) if heaviest[0] is None else [None]
        near = None
        for wanted in rounds:
            found = _meet(source_rows(rows, chosen, heaviest[0], wanted), candidate_rows(held, chosen, least, heaviest[1], wanted))
            if len(rounds) == 1:
                return found
            found = found if near is None else near.unionByName(found).groupBy("src", "dst").agg(F.max("score").alias("score"))
            order = Window.partitionBy("src").orderBy(F.desc("score"), "dst")
            found = found.join(asked.select(F.col("id").alias("src"), "k"), "src").withColumn("rank", F.row_number().over(order))
            near = stored(found.filter("rank <= k").select("src", "dst", "score"))
        return near

    total = sum(counts.values())
    opened = met(asked, [Bands(counts, max(size, total >> 5), piece, part)], 0.0, (1, 2))
    best = opened.groupBy("src").agg(F.sort_array(F.collect_list(-F.col("score"))).alias("best")).withColumnRenamed("src", "id")
    kth = F.when(F.size("best") >= F.col("k"), -F.element_at("best", F.col("k").cast("int")))
    lows = stored(asked.drop("low").join(best, "id", "left").select("id", "t", "w", F.coalesce(kth, F.lit(0.0)).alias("low"), "k"))
    least = lows.agg(F.coalesce(F.min("low"), F.lit(0.0))).first()[0]
    bandings = [Bands(counts, max(size, total >> 2 * i), piece, part) for i in range(widths)]
    return met(lows, bandings, max(0.0, least - SLACK))
