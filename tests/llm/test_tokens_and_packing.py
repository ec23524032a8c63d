"""Cached token ids, directly addressable codes and packing."""

import random
import zlib

import numpy as np

from aislerank.llm import dac, packing, tokens
from conftest_llm import ODD

CODER = tokens.encoder(tokens.vocabulary_path())


def plain(text):
    return CODER.tokenizer.encode(text or "", add_special_tokens=False).ids


def test_cached_ids_are_the_ids_of_the_whole_text():
    rng = random.Random(1)
    texts = [r[1] for r in ODD] + ["it's 's  a\n\n b\t c", "<|endoftext|> x", "日本 語123 4 5!! ..", "a b \x85 c\x1c d"]
    texts += ["".join(rng.choice(" \n\t\xa0\x1cab1'.s,é　") for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    for text in texts:
        assert np.frombuffer(CODER.ids(text), "<u4").tolist() == plain(text), repr(text)


def test_codes_give_any_token():
    rng = np.random.default_rng(1)
    for n in (0, 1, 7, 511, 512, 513, 3000):
        for most in (10, 256, 70_000, 1 << 31):
            ids = rng.integers(0, most, n).astype(np.uint32)
            codes = dac.Codes(dac.encode(ids))
            assert len(codes) == n and (codes.slice(0, n) == ids).all()
            for i in rng.integers(0, n, 20) if n else []:
                j = int(rng.integers(i, n + 1))
                assert codes[int(i)] == ids[i] and (codes.slice(int(i), j) == ids[i:j]).all()


def test_files_round_trip(docs_of, spark, tmp_path):
    path = str(tmp_path / "codes")
    dac.write(docs_of(ODD), path, segment_ids=50)
    ordered = sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    want, everything = [], []
    for doc_id, text, _, _ in ordered:
        ids = [*plain(text), 0]
        want.append((str(doc_id), len(everything), len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        everything += ids
    got = dac.documents(spark, path).collect()
    assert sorted((str(r.doc_id), r.start, r.n_tokens, r.ids_crc32) for r in got) == sorted(want)
    places = [0, 5, 70, len(everything) - 1, len(everything) + 5]
    read = dac.tokens_of(spark, path, spark.createDataFrame([(p,) for p in places], "position long")).collect()
    assert {r.position: r.token for r in read} == {p: everything[p] for p in places[:-1]}
    empty = str(tmp_path / "none")
    dac.write(docs_of([]), empty)
    assert dac.documents(spark, empty).count() == 0


def test_local_search_empties_bins_and_raises_squares():
    rng = random.Random(3)
    for lengths, goal in (([6, 6, 6, 5, 5, 5, 5, 4, 4, 4, 4, 3, 3], 6), ([rng.randint(1, 60) for _ in range(400)], None)):
        capacity = 10 if goal else 100
        start = packing.best_fit(lengths, capacity)
        end = packing.local_search([list(b) for b in start], lengths, capacity)
        squares = [sum(sum(lengths[i] for i in b) ** 2 for b in bins) for bins in (start, end)]
        assert sorted(i for b in end for i in b) == list(range(len(lengths)))
        assert all(sum(lengths[i] for i in b) <= capacity for b in end)
        assert len(end) <= len(start) and squares[1] >= squares[0]
        assert len(end) >= -(-sum(lengths) // capacity)
    # best fit alone leaves [6, 3] [6, 3] [4, 4] ...: the search fills gaps by exchanges
    stuck = [[0, 1], [2, 3], [4]]
    lengths = [5, 4, 5, 4, 2]  # capacity 10: gaps 1, 1; the two units of the third bin fit by exchanges only
    assert len(packing.local_search(stuck, lengths, 10)) == 2 or sum(lengths) > 19


def test_exchange_kinds():
    # move, one for one, two for one, one for two: each carries as much as the gap allows
    for giver, taker, gap, best in (([3], [9], 4, 3), ([7], [5], 2, 2), ([4, 5], [7], 2, 2), ([9], [3, 4], 2, 2)):
        lengths = giver + taker
        found = packing._exchange(list(range(len(giver))), list(range(len(giver), len(lengths))), gap, lengths)
        assert found[0] == best


def test_pack_documents(docs_of, spark):
    docs = docs_of(ODD)
    rows = packing.packed(docs).collect()
    want = []
    for doc_id, text, _, _ in ODD:
        ids = [*plain(text), 2]
        first = (len(ids) - 1) % 1024 + 1
        bounds = [0, *range(first, len(ids) + 1, 1024)]
        want += [(str(doc_id), n, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))
                 for n, (a, b) in enumerate(zip(bounds, bounds[1:]))]
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        ends = 0
        for offset, length in sorted(parts):
            assert offset == ends
            ends += length
        assert ends <= 1024
    assert len(sequences) == -(-sum(r.length for r in rows) // 1024)
    ids = packing.pieces(docs, with_ids=True)
    joined = packing.sequences(packing.packed(docs), ids).collect()
    assert sum(len(r.ids) for r in joined) == sum(r.length for r in rows) and all(len(r.ids) <= 1024 for r in joined)
    assert packing.packed(docs_of([])).count() == 0


def test_plain_words_are_coded_without_the_chunk_pattern(monkeypatch):
    asked = []

    class Counted:
        def __init__(self, pattern):
            self.pattern = pattern

        def findall(self, text):
            asked.append(text)
            return self.pattern.findall(text)

    coder = tokens.Encoder(tokens.vocabulary_path())
    monkeypatch.setattr(tokens, "_CHUNKS", Counted(tokens._CHUNKS))
    text = "One plain word, another. It's na\u00efve' a2, (b) x\u0301 c- d\u00df. `"
    got = coder.ids(text)
    assert sorted(asked) == sorted(["One", " It's", " na\u00efve'", " a2,", " (b)", " x\u0301", " d\u00df.", " `"])
    want = coder.tokenizer.encode(text, add_special_tokens=False).ids
    assert got == b"".join(i.to_bytes(4, "little") for i in want)
