"""Cached encoding of texts cut at lone spaces and line breaks.

The split pattern of the rank files never lets a pre-token cross a lone space or a lone line
break that stands between two non-space characters, apart from one leading space. A text is
therefore the sequence of its space-separated words, each encoded once and remembered; a text
with other or adjacent white space is cut only around that. Latin letters followed by marks
up to the word's end are two pre-tokens, so that a word is encoded once whatever marks follow it.
"""

from __future__ import annotations

import re
import string
import sys
from array import array
from collections.abc import Callable

# What only a text with adjacent white space, or with other than spaces and line breaks, contains.
_OTHER = ["  ", "\n\n", " \n", "\n ", *[c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]]
# Letters below this character are letters in every version of the character tables.
LATIN_END = "\u0250"
# A piece that no lone space or line break can cut further.
_PIECE = re.compile(r"(?:(?<=\S) (?=\S))|(?:(?<=\S)\n(?=\S))")


class PieceCache(dict):
    """Word -> its packed ids, filled by ``encode``.

    When ``limit`` words are held they become the older generation, whose words come back on use.
    ``letters`` encodes a single pre-token of Latin letters; ``marks`` holds what follows them (this
    cache itself where it is not given).
    """

    def __init__(
        self, encode: Callable[[str], bytes], letters: Callable[[str], bytes], prefix: str, limit: int, marks: PieceCache | None = None
    ) -> None:
        super().__init__()
        self.encode, self.letters, self.prefix, self.limit = encode, letters, prefix, limit
        self.marks = self if marks is None else marks
        self.older: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            core = word.rstrip(string.punctuation)
            if not core.isalpha() or not (core.isascii() or max(core) < LATIN_END):
                ids = self.encode(self.prefix + word)
            elif len(core) == len(word):
                ids = self.letters(self.prefix + word)
            else:
                ids = self[core] + self.marks[word[len(core) :]]
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        if len(word) <= 64:
            self[word] = ids
        return ids


class CachedEncoder:
    """Packed ids of whole texts; ``encode`` gives the ids of any piece between safe cuts, ``letters``
    those of a piece that is known to be one pre-token of Latin letters, with or without a space before."""

    def __init__(
        self, encode: Callable[[str], list[int]], dtype: str = "<u4", limit: int = 400_000, letters: Callable[[str], list[int]] | None = None
    ) -> None:
        code = {"<u2": "H", "<u4": "I"}[dtype]
        if sys.byteorder != "little":
            raise ValueError("ids are packed on little-endian machines")
        letters = letters or encode
        packed = lambda piece: array(code, encode(piece)).tobytes()
        packed_letters = lambda piece: array(code, letters(piece)).tobytes()
        self.first = PieceCache(packed, packed_letters, "", limit // 8)
        self.rest = PieceCache(packed, packed_letters, " ", limit, self.first)
        self.line_break = packed("\n")

    def pieces(self, text: str) -> list[bytes]:
        out: list[bytes] = []
        if not text:
            return out
        if text[0] in " \n" or text[-1] in " \n" or any(x in text for x in _OTHER):
            self._careful(text, out)
            return out
        first, rest = self.first, self.rest
        for k, line in enumerate(text.split("\n")):
            if k:
                out.append(self.line_break)
            words = line.split(" ")
            out.append(first[words[0]])
            out += [rest[w] for w in words[1:]]
        return out

    def _careful(self, text: str, out: list) -> None:
        """Cuts only at lone spaces and line breaks between two non-space characters."""
        start, cache = 0, self.first
        for cut in _PIECE.finditer(text):
            at = cut.start()
            out.append(cache[text[start:at]])
            cache = self.rest
            if text[at] == "\n":
                out.append(self.line_break)
                cache = self.first
            start = at + 1
        out.append(cache[text[start:]])

    def forget(self) -> None:
        """Empties the caches."""
        for cache in (self.first, self.rest):
            cache.clear()
            cache.older = {}

    def packed(self, text: str) -> bytes:
        """The ids of ``text`` as consecutive integers of ``dtype``, two or four bytes each."""
        return b"".join(self.pieces(text))
