"""Token ids of whole texts by a public tokenizer file, with a bounded cache of words."""

from __future__ import annotations

import re
from functools import lru_cache
from struct import Struct

#: The white space of the tokenizer's own splitting pattern, and letters up to U+024F.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_LETTERS = r"A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
_MARKS = r"!-&(-/:-@\[-`{-~"

#: Chunks that the tokenizer's pattern never joins, so that coded one by one they give the ids of the whole text:
#: a run of letters before an ASCII non-letter, a run of marks before a space, letter or digit, what is left up to
#: the next white space, and white space but for the one space that goes with the next chunk.
_CHUNKS = re.compile(
    f" ?[{_LETTERS}]++(?![^\x00-\x7f])| ?[{_MARKS}]++(?![^{_SPACE}0-9A-Za-z])| ?[^{_SPACE}]+"
    f"|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]")


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


_ONE_PIECE = re.compile(f" ?(?:[{_LETTERS}]+|[{_MARKS}]+)")

#: The byte-level alphabet of the vocabulary file: printable bytes stand for themselves, the others for U+0100 on.
_PLAIN = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_ALPHABET = {b: 0x100 + n for n, b in enumerate(sorted({*range(256)} - _PLAIN))}


#: ASCII marks that are a chunk of their own behind letters and before white space.
_ENDS = frozenset(c for c in map(chr, range(0x21, 0x7F)) if not c.isalnum() and c != "'")


class _Words(dict):
    """A word behind a single space to its ids; None when its white space does not allow to cut in front of it."""

    def __init__(self, chunks: Encoder, keep: int):
        super().__init__()
        self.chunks, self.keep = chunks, keep

    def __missing__(self, word: str) -> bytes | None:
        if word.isalpha() and word.isascii():  # one chunk
            coded = self.chunks[" " + word]
        elif word[-1:] in _ENDS and word[:-1].isalpha() and word.isascii():  # two
            coded = self.chunks[" " + word[:-1]] + self.chunks[word[-1]]
        elif not word or word[0].isspace() or word[-1].isspace():
            return None
        else:
            coded = b"".join(map(self.chunks.__getitem__, _CHUNKS.findall(" " + word)))
        if len(self) < self.keep:
            self[word] = coded
        return coded


@lru_cache(256)
def _packer(n: int) -> Struct:
    return Struct(f"<{n}I")


class Encoder(dict):
    """Chunk of text to its ids as little-endian unsigned 32-bit bytes.

    At most `keep` chunks and half as many words are kept; others are coded each time they are met. Texts of any
    length are coded whole, a null text as an empty one.
    """

    def __init__(self, path: str, keep: int = 400_000):
        from tokenizers import Tokenizer

        super().__init__()
        self.keep = keep
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.model = self.tokenizer.model
        self.size = self.tokenizer.get_vocab_size()
        self.words = _Words(self, keep // 2)

    def __missing__(self, chunk: str) -> bytes:
        letters = chunk[1:] if chunk[0] == " " else chunk
        if letters.isalpha() and letters.isascii():
            piece = "\u0120" + letters if letters is not chunk else chunk
            found = [token.id for token in self.model.tokenize(piece)]
        elif _ONE_PIECE.fullmatch(chunk) and "'" not in chunk:
            piece = chunk.encode().decode("latin-1").translate(_ALPHABET)
            found = [token.id for token in self.model.tokenize(piece)]
        else:
            found = self.tokenizer.encode(chunk, add_special_tokens=False).ids
        coded = _packer(len(found)).pack(*found)
        if len(self) < self.keep:
            self[chunk] = coded
        return coded

    def ids(self, text: str | None) -> bytes:
        """The ids of a text, four bytes each."""
        if not text:
            return b""
        first, *rest = text.split(" ")
        if first and not first[-1].isspace():
            coded = list(map(self.words.__getitem__, rest))
            if None not in coded:
                return b"".join([*map(self.__getitem__, _CHUNKS.findall(first)), *coded])
        return b"".join(map(self.__getitem__, _CHUNKS.findall(text)))


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each worker process, so that tasks that follow each other share its cache."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
