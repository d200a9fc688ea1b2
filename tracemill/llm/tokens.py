"""Token ids of whole texts by a public tokenizer, exact and without encoding a word twice.

A text is cut only where no token of the two vocabularies can span: before a space that
follows a visible character, between a Latin letter or digit and a full stop or comma, and
around a lone line break. The ids of a piece are then the same alone as in its text, and are
kept in a bounded memo of the worker. Texts with rarer white space or punctuation are cut at
plain spaces only.
"""

from __future__ import annotations

import os
import re
from array import array
from functools import lru_cache

#: Begins a piece that has no space before it.
BARE = "\x01"
_LATIN = r"A-Za-z0-9\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f"
_LOOSE = re.compile(f"(?<![{_LATIN}])[.,]")
_RARE = re.compile(r"[\x01\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_CUT = re.compile(r"(?<=\S)(?= )")
#: Latin letters, without the one whose lower case is two letters.
_WORD = re.compile(r"[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+")
LONGEST = 80


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


@lru_cache(maxsize=4)
def encoder(path: str, limit: int = 150_000) -> PieceEncoder:
    """The worker's encoder for a vocabulary and memo, kept from task to task."""
    return PieceEncoder(path, limit)


@lru_cache(maxsize=1)
def _byte_letters() -> dict[int, str]:
    """The letters that stand for bytes in the vocabularies: printable ones are themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class PieceEncoder(dict):
    """Ids of pieces, as little-endian unsigned 32-bit integers, made when first asked for.

    Two generations of about `limit` pieces each are remembered at most.
    """

    def __init__(self, path: str, limit: int):
        super().__init__()
        self.tokenizer, self.limit = tokenizer(path), limit
        self.merge = self.tokenizer.model.tokenize
        self.lower = self.tokenizer.normalizer is not None
        self.space = "" if self.lower else "\u0120"
        self.older: dict[str, bytes] = {}

    @staticmethod
    def pieces(text: str) -> list[str]:
        """Pieces of the text in order. `BARE` goes off; any other piece has a space before it."""
        odd = "  " in text or "\n\n" in text or " \n" in text or "\n " in text
        if odd or _RARE.search(text) or _LOOSE.search(text):
            return [BARE + p for p in _CUT.split(text)]
        text = text.replace(".", " \x01.").replace(",", " \x01,").replace("\n", " \x01\n \x01")
        return (BARE + text).split(" ")

    def __missing__(self, piece: str) -> bytes:
        found = self.older.get(piece)
        if found is None:
            found = array("I", self._made(piece)).tobytes()
        if len(piece) <= LONGEST:
            if len(self) >= self.limit:
                self.older = dict(self)
                self.clear()
            self[piece] = found
        return found

    def _made(self, piece: str) -> list[int]:
        bare = piece.startswith(BARE)
        word = piece[1:] if bare else piece
        if _WORD.fullmatch(word):  # straight from the merges
            letters = word.lower() if self.lower else word
            if not letters.isascii():
                letters = letters.encode().decode("latin-1").translate(_byte_letters())
            return [t.id for t in self.merge(letters if bare else self.space + letters)]
        return self.tokenizer.encode(word if bare else " " + word, add_special_tokens=False).ids

    def spelled(self, text: str) -> tuple[list[str], list[bytes]]:
        """Pieces of a text, and the ids of each."""
        pieces = self.pieces(text)
        return pieces, list(map(self.__getitem__, pieces))

    def ids(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.pieces(text)))
