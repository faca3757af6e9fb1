"""Token ids by a public tokenizer, chunk by chunk.

The tokenizer named by default drops white space and never joins across it, so the ids of a text are the ids of its
chunks between ASCII spaces one after the other. A tokenizer that doesn't do so on some probing texts encodes whole
texts by the library alone. With the others, each Python worker keeps the ids of the chunks that it has met, as
bytes. A new chunk of Latin letters, with a comma or full stop behind it or none, is one or two units to the
tokenizer's rules and goes straight to the library's model; any other goes through its whole chain.
"""

from __future__ import annotations

import functools
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np

#: Chunks that a worker remembers at most; past it, it starts anew. It bounds memory and changes no result.
REMEMBERED = 400_000
#: A chunk longer than this is encoded each time and not kept.
LONGEST = 64
#: Characters split at once.
SLICE = 2_000_000
#: Texts in which lower case is the same character by character and composition changes nothing.
_ODD = re.compile("[\u0130\u0250-\U0010ffff]")
#: Texts by which a tokenizer shows whether it drops white space: words, signs, digits and space of all sorts between.
_SPACES = ("a b", " a  b ", "The cat's hat, (3.5 kg)\nnext line\tof it\r\n\r\n end.", "it 's we 'll", "don' t 1 2 ,. x", "été à\u00a0la \u3000 ñu", "\n", " ", "von von von A B")


def _byte_letters() -> list[str]:
    """The letter by which byte-level vocabularies write each byte: itself if it is printable, else one past 255."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = dict(zip(shown, map(chr, shown), strict=True))
    for b in range(256):
        if b not in letters:
            letters[b] = chr(256 + len(letters) - len(shown))
    return [letters[b] for b in range(256)]


_BYTE = _byte_letters()


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _pieces(text: str) -> Iterator[str]:
    """A very long text in pieces that end at a space."""
    at = 0
    while len(text) - at > 2 * SLICE:
        to = text.find(" ", at + SLICE)
        if to < 0:
            break
        yield text[at:to]
        at = to
    yield text[at:] if at else text


class _Known(dict):
    """Ids by chunk; a chunk that is missing is encoded, and kept if it is short."""

    def __init__(self, encoder: ChunkEncoder):
        self.encoder = encoder

    def __missing__(self, chunk: str) -> bytes:
        ids = self.encoder.chunk(chunk)
        if len(chunk) <= LONGEST:
            self[chunk] = ids
        return ids


class ChunkEncoder:
    """Ids of whole texts as little-endian unsigned integers of 2 bytes, or 4 where the vocabulary needs them."""

    def __init__(self, path: str | None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path or default_path())
        self.dtype = np.dtype("<u2" if self.tok.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        self.code, self.model = "H" if self.dtype.itemsize == 2 else "I", self.tok.model
        self.sign = {c: self._bytes([t.id for t in self.model.tokenize(c)]) for c in ".,"}
        self.known = _Known(self)
        self.split = all(self._bytes(self.tok.encode(t, add_special_tokens=False).ids) == b"".join(self._bytes(self.tok.encode(c, add_special_tokens=False).ids) for c in self._chunks(t)) for t in _SPACES)
        self.plain = self.split and self._plain()

    @staticmethod
    def _chunks(text: str) -> list[str]:
        return text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")

    def _plain(self) -> bool:
        """Whether letters may go straight to the model: lower case, byte-level letters and the rules named above."""
        probe = ["Thé", "été", "ab", "q.", "über,", "don", "Straße.", "ñandú"]
        return [self._letters(c.lower()) for c in probe] == [self._bytes(e.ids) for e in self.tok.encode_batch(probe, add_special_tokens=False)]

    def _bytes(self, ids: list[int]) -> bytes:
        return np.array(ids, dtype=self.dtype).tobytes()

    def _letters(self, chunk: str) -> bytes | None:
        """The ids of lower-case letters with one sign behind them or none; None: not of this kind."""
        stem, sign = (chunk[:-1], chunk[-1]) if chunk[-1:] in (".", ",") else (chunk, "")
        if not stem.isalpha():
            return None
        if not stem.isascii() and _ODD.search(stem):
            return None
        stem = stem.lower()
        ids = self.known.get(stem) if sign else None
        if ids is None:
            written = stem if stem.isascii() else "".join([_BYTE[b] for b in stem.encode()])
            ids = array(self.code, [t.id for t in self.model.tokenize(written)]).tobytes()
        return ids + self.sign[sign] if sign else ids

    def chunk(self, chunk: str) -> bytes:
        """The ids of one chunk that is not remembered."""
        ids = self._letters(chunk) if self.plain else None
        return self._bytes(self.tok.encode(chunk, add_special_tokens=False).ids) if ids is None else ids

    def _slice(self, texts: list[str]) -> list[bytes]:
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        if self.plain:
            texts = [t if _ODD.search(t) else t.lower() for t in texts]
        return [b"".join(map(known.__getitem__, self._chunks(t))) for t in texts]

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        """The ids of one text after the other; a null is an empty text."""
        if not self.split:
            for text in texts:
                yield self._bytes(self.tok.encode(text or "", add_special_tokens=False).ids)
            return
        held: list[str] = []
        size = 0
        for text in texts:
            text = text or ""
            if size + len(text) > SLICE and held:
                yield from self._slice(held)
                held, size = [], 0
            if len(text) > 2 * SLICE:
                yield b"".join(b"".join(self._slice([p])) for p in _pieces(text))
                continue
            held.append(text)
            size += len(text)
        if held:
            yield from self._slice(held)


@functools.lru_cache(maxsize=4)
def encoder(path: str | None) -> ChunkEncoder:
    return ChunkEncoder(path)
