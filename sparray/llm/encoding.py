"""Token ids of whole texts, with a bounded cache of the words already encoded.

Texts are cut at blanks and line ends, which no token of the supported vocabularies spans (white space is dropped before
words are matched), so the ids of a text are those of its pieces in order. In a text of Latin letters (up to U+00FF) a
piece is lower-cased and parted into words, digits and signs as those vocabularies do, and each of these is merged once;
the pieces of any other text are encoded by the tokenizer. A vocabulary that keeps white space must be read with
``whole=True``.
"""

from __future__ import annotations

import itertools
import operator
import re
import unicodedata
from array import array
from collections.abc import Iterable, Sequence

import numpy as np

from .common import claim

#: Entries of the caches of Latin pieces and of their matches (about 170 bytes each), and of the cache of other pieces; a
#: full cache starts anew.
CACHED = 600_000
PIECES = 100_000
WIDTH = 4

_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, whole: bool = False) -> Encoder:
    """The encoder of this process for a vocabulary file; caches live as long as the Python worker."""
    claim("encoding", _encoders.clear)
    if (path, whole) not in _encoders:
        _encoders[path, whole] = Encoder(path, whole)
    return _encoders[path, whole]


#: What a lower-cased Latin text is parted into: the vocabularies' own pattern with its classes up to U+00FF written out
#: (fixed values).
_LETTER, _NUMBER, _SPACE = "a-zªµºß-öø-ÿ", "0-9²³¹¼-¾", "\t-\r \x85\xa0"
MATCH = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^{_SPACE}{_LETTER}{_NUMBER}]+")
#: What special tokens begin with.
SPECIAL = "<|"
#: Bytes that byte-level vocabularies write as letters from U+0100 on, in order (fixed values).
BYTES = {b: 0x100 + i for i, b in enumerate([*range(0x21), *range(0x7F, 0xA1), 0xAD])}


class Words(dict):
    """The ids of single matches."""

    def __init__(self, tokenizer):
        super().__init__()
        self.merge = tokenizer.model.tokenize

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHED:
            self.clear()
        own = word if word.isascii() else word.encode().decode("latin-1")
        self[word] = ids = array("I", [t.id for t in self.merge(own.translate(BYTES) if not own.isalpha() or own is not word else own)]).tobytes()
        return ids


class Encoder:
    def __init__(self, path: str, whole: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.whole = whole
        self.words = Words(self.tokenizer)
        self.latin: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        #: Whether matches can go to the merges directly; a vocabulary that parts or spells otherwise takes the long way.
        self.plain = not whole and all(self._by_tokenizer([t])[0] == b"".join(self._parts(t)) for t in PROBES)

    def encode(self, texts: Sequence[str | None]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit numbers."""
        return [b"".join(parts) for parts in self._all_parts(texts)]

    def lengths(self, texts: Sequence[str | None]) -> list[int]:
        """Each text's number of ids."""
        return [sum(map(len, parts)) // WIDTH for parts in self._all_parts(texts)]

    def _all_parts(self, texts: Sequence[str | None]) -> Iterable[Iterable[bytes]]:
        if self.whole:
            return ((ids,) for ids in self._by_tokenizer([t or "" for t in texts]))
        return ((self._parts if self.plain and latin(t) else self._pieces)(t) for t in (t or "" for t in texts))

    def _by_tokenizer(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _parts(self, text: str) -> list[bytes]:
        """The ids of a Latin text's pieces."""
        parts = text.lower().replace("\n", " ").split(" ")
        found = list(map(self.latin.get, parts))
        if None not in found:
            return found
        new = set(itertools.compress(parts, map(operator.is_, found, itertools.repeat(None))))
        if len(self.latin) + len(new) > CACHED:
            self.latin.clear()
            new = set(parts)
        words, known = map(MATCH.findall, new), self.words.__getitem__
        self.latin.update([(p, known(w[0]) if len(w) == 1 else b"".join(map(known, w))) for p, w in zip(new, words, strict=True)])
        return list(map(self.latin.__getitem__, parts))

    def _pieces(self, text: str) -> list[bytes]:
        """The ids of any text's pieces."""
        parts = text.replace("\n", " ").split(" ")
        new = set(parts).difference(self.pieces)
        if len(self.pieces) + len(new) > PIECES:
            self.pieces.clear()
            new = set(parts)
        if new:
            bare = [p if latin(p) or not p.isalpha() else f"{p} " for p in new]
            self.pieces.update(zip(new, self._by_tokenizer(bare), strict=True))
        return list(map(self.pieces.__getitem__, parts))


def latin(text: str) -> bool:
    """Whether the text holds only letters and signs up to U+00FF and no special token."""
    if SPECIAL in text:
        return False
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


#: Texts that show whether a vocabulary parts and spells as MATCH does.
PROBES = ("Él said: it's 12 o'clock, ÿes... a\x1cb", "x²y ¼ «Straße»!?\t\xa0'll d'un", "")
