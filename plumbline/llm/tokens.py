"""Token ids of whole texts inside Spark tasks, through the ``tokenizers`` library.

Texts repeat their words, so a worker keeps the ids of pieces it has seen. A piece ends before a blank that is followed
by something else than white space; both published pre-tokenizers always cut there, which makes the ids of the text the
ids of its pieces one after another. A text that holds a special token's string is encoded in one go instead.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

PIECES = 400_000  # pieces kept by a worker, twice: the current ones and those before
LONGEST = 64  # longer pieces are encoded each time


#: Byte-level BPE spells byte b as this character: itself where printable, else the next free one from U+0100 on.
_SHOWN = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
BYTES = [chr(b) if b in _SHOWN else chr(0x100 + b - sum(s < b for s in _SHOWN)) for b in range(256)]
_LATIN = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+")


class _Pieces(dict):
    """Ids of pieces that follow ``before``; a piece not seen yet is taken apart where the pre-tokenizers always cut."""

    def __init__(self, encoder: "Encoder", before: str):
        super().__init__()
        self.encoder, self.before, self.old = encoder, before, {}
        self.spelt = before and BYTES[ord(before)]

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            ids = self.apart(piece)
        if len(piece) <= LONGEST:
            if len(self) >= PIECES:
                self.old = dict(self)
                self.clear()
            self[piece] = ids
        return ids

    def apart(self, piece: str) -> bytes:
        e = self.encoder
        if "\n" in piece:
            parts = piece.split("\n")
            if all(parts) and not (e.blank and any(p[0].isspace() or p[-1].isspace() for p in parts)):
                return self[parts[0]] + b"".join(e.line + e.first[p] for p in parts[1:])
        elif len(piece) > 1 and piece[-1] in ".," and piece[-2].lower().isalpha():
            return self[piece[:-1]] + e.first[piece[-1]]
        elif e.lower and piece[:1].isupper() and (small := piece.lower()) != piece and len(small) == len(piece) and "\u03a3" not in piece:
            return self[small]
        elif _LATIN.fullmatch(piece) and not (e.lower and piece != piece.lower()):  # one pre-token, nothing to normalise
            spelt = self.spelt + (piece if piece.isascii() else "".join(map(BYTES.__getitem__, piece.encode())))
            return np.array([t.id for t in e.tokenizer.model.tokenize(spelt)], "<u4").tobytes()
        return e.whole(self.before + piece)


class Encoder:
    """``encode`` gives the ids of a text as little-endian 32-bit integers."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.blank = self.whole("a b") != self.whole("a\nb")
        self.lower = self.whole("A") == self.whole("a")
        self.line = self.whole("\n")
        self.first = _Pieces(self, "")
        self.rest = _Pieces(self, " ") if self.blank else self.first

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return self.whole(text)
        pieces = text.split(" ")
        if self.blank and _BEFORE_SPACE.search(text):
            pieces = _CUT.split(text)
        return self.first[pieces[0]] + b"".join(map(self.rest.__getitem__, pieces[1:]))


_BEFORE_SPACE, _CUT = re.compile(r" (?:\s|\Z)"), re.compile(r" (?=\S)")


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder per worker and vocabulary file."""
    return Encoder(path)


def small(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Batches of few rows, so that a task's Python lists stay small whatever the texts weigh."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file on this machine; the same on every executor."""
    import public_tokenizers
    return public_tokenizers.path(name)
