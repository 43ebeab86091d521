"""Whole texts through the tokenizers library, each distinct piece as a rule once per worker."""

from __future__ import annotations

import array
import functools
import os
import re
import unicodedata
from collections.abc import Callable, Iterator

import regex

#: Pieces in one generation of a worker's memory. A full generation becomes the old one; pieces used again move on.
REMEMBERED = 450_000
#: Longer pieces, in characters, are not remembered.
LONGEST = 64

#: Characters that byte-level tokenizers write bytes with: printable ones stand for themselves, the others come after U+0100.
SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
ALPHABET = {b: b for b in SHOWN} | {b: 0x100 + i for i, b in enumerate(b for b in range(0x100) if b not in SHOWN)}
#: White space to the pattern's reader here, but not to the library.
ODD_SPACE = "\x1c\x1d\x1e\x1f"
#: Letters whose lower case depends on what follows, or has several characters.
ODD_CASE = "\u0130\u03a3"


def _for_ascii(pattern: str) -> str:
    """``pattern`` for ``re``, with other characters in none of its classes; those of white space are left to the flags."""
    classes = {r"[^\s\p{L}\p{N}]": r"[^\sA-Za-z0-9\x80-\U0010ffff]", r"[\p{L}]": "[A-Za-z]", r"[\p{N}]": "[0-9]", r"\p{L}": "[A-Za-z]", r"\p{N}": "[0-9]"}
    return re.sub("|".join(map(re.escape, classes)), lambda m: classes[m[0]], pattern)


def pattern_cut(pattern: str, folds: bool = False) -> Callable[[str], list[str]]:
    """Pieces for a tokenizer that encodes each match of ``pattern`` on its own; texts that might be cut elsewhere stay whole.

    With ``folds``, for one that first composes characters, folds case, and drops white space. ASCII goes a faster way; what
    touches other characters stays together up to the next white space, where a piece ends in any case.
    """
    ascii_only = _for_ascii(pattern)
    plain = re.compile(ascii_only, re.ASCII).findall
    mixed = re.compile(rf"(?>{ascii_only})(?![^\x00-\x7f])|" + (r"\S+" if folds else r" ?\S+|\s+(?!\S)|\s+")).findall

    def cut(text: str) -> list[str]:
        if any(c in text for c in ODD_SPACE):
            return [text]
        if text.isascii():
            return plain(text.lower() if folds else text)
        if folds:
            if any(c in text for c in ODD_CASE) or not unicodedata.is_normalized("NFC", text):
                return [text]
            text = text.lower()
        return mixed(text)

    return cut


class Encoder(dict):
    """Ids of whole texts, equal to encoding them in one go as the cuts lie between tokens; a mapping from pieces to their ids.

    ``pattern`` is what the tokenizer splits text by.
    """

    def __init__(self, path: str, pattern: str, folds: bool = False):
        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallel work
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.merges = self.tokenizer.model.tokenize
        self.cut, self.within = pattern_cut(pattern, folds), regex.compile(pattern).findall
        self.old: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            inner = [piece] if piece.isascii() else self.within(piece)
            ids = self._merged(piece) if inner == [piece] else b"".join(map(self.__getitem__, inner))
        if len(piece) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.old = dict(self)
                self.clear()
            self[piece] = ids
        return ids

    def _merged(self, piece: str) -> bytes:
        """Straight from the library's merges, the piece's bytes written in the alphabet of the vocabulary."""
        return array.array("I", [t.id for t in self.merges(piece.encode().decode("latin-1").translate(ALPHABET))]).tobytes()

    def _whole(self, text: str) -> bytes:
        return array.array("I", self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes()

    def packed(self, texts: list[str]) -> Iterator[bytes]:
        """Per text, its ids as little-endian unsigned 32-bit integers."""
        for text in texts:
            cuts = self.cut(text)
            yield self._whole(text) if cuts == [text] else b"".join(map(self.__getitem__, cuts))


@functools.lru_cache(maxsize=2)
def load(path: str, pattern: str, folds: bool = False) -> Encoder:
    """One per Python worker."""
    return Encoder(path, pattern, folds)


def forget() -> None:
    """Free the encoders of this Python worker, which Spark hands on to the tasks of the next operator."""
    load.cache_clear()
