"""Exact, fast encoding with the tokenizers library.

A byte-level BPE never merges across a pre-token border, and neither tokenizer's pre-tokens cross
from a non-space character to a space, tab or line break. So the ids of a text are the ids of its
pieces, and pieces recur. Two bounded caches hold the ids of pieces (a run of spaces with the word
after it) and of pre-tokens; what they miss goes to the library's BPE model, and every piece with
characters outside printable ASCII and Latin-1 letters, or with other white space, goes to the
library's whole encoder; so does every text that holds the string of an added token, such as an end
mark. ``tests/llm`` compares the result with whole-text encoding.
"""

from __future__ import annotations

import re
from array import array
from functools import lru_cache

from tokenizers import Tokenizer

_LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"
_PLAIN = re.compile(rf"[ \n\t\r]*[!-@\[-`{{-~{_LATIN}]*\Z")
_WORD = re.compile(rf"[!-@\[-`{{-~{_LATIN}]+\Z").match
_PIECE = re.compile(r"[ \t\n\r]*[^ \t\n\r]+|[ \t\n\r]+")
#: White space that Python's or the tokenizers' patterns know beside the four characters of _PIECE.
_OTHER_SPACE = re.compile(r"[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028\u2029\u202f\u205f\u2060\u3000\ufeff]")


def _is_latin(text: str) -> bool:
    """Whether lower-casing and NFC treat each character by itself, as in Latin-1."""
    try:
        text.encode("latin-1")
        return True
    except UnicodeEncodeError:
        return False


class _Cache(dict):
    """key -> make(key), of two generations: when the young one holds ``limit`` bytes it becomes the old one."""

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit, self.held, self.old = make, limit, 0, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self.held += 200 + len(key) + len(value)  # two objects and a place in the table
        if self.held >= self.limit:
            self.old, self.held = dict(self), 0
            self.clear()
        self[key] = value
        return value


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE's printable stand-in of each byte: itself if printable in Latin-1, else the next free one from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Encoder:
    """Encodes texts to little-endian unsigned 32-bit ids, as the library does with add_special_tokens=False.

    ``pieces`` and ``parts`` bound the bytes of a generation of each cache. ``lower``: the tokenizer lower-cases and drops white space.
    """

    def __init__(self, path: str, pieces: int = 50_000_000, parts: int = 30_000_000):
        self.tokenizer = Tokenizer.from_file(path)
        #: One more than the greatest id.
        self.size = 1 + max(self.tokenizer.get_vocab(with_added_tokens=True).values(), default=0)
        # texts that hold an added token's string, in any case, go to the whole encoder
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(added) or r"(?!)", re.IGNORECASE).search
        self.model = self.tokenizer.model
        self.lower = self.tokenizer.normalizer is not None
        # The pre-token patterns of the two vocabularies, over printable ASCII and Latin-1 letters.
        contractions = "'s|'t|'re|'ve|'m|'ll|'d"
        if self.lower:
            self.part = re.compile(rf"{contractions}|[{_LATIN}]+|[0-9]|[^\s{_LATIN}0-9]+")
        else:
            self.part = re.compile(rf"{contractions}| ?[{_LATIN}]+| ?[0-9]+| ?[^\s{_LATIN}0-9]+|\s+(?!\S)|\s+")
        self.letters = _byte_letters()
        self.space = self.letters[32]
        self.parts = _Cache(self._encode_part, parts)
        self.pieces = _Cache(self._encode_spaced, pieces)

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _encode_part(self, part: str) -> bytes:
        if part.isascii() and part.isprintable():
            shown = part.replace(" ", self.space)
        else:
            shown = "".join(map(self.letters.__getitem__, part.encode()))
        return array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()

    def _encode_piece(self, piece: str) -> bytes:
        if not _PLAIN.match(piece):
            return self._whole(piece)
        if self.lower:
            piece = piece.lower()
        return b"".join(map(self.parts.__getitem__, self.part.findall(piece)))

    def _encode_spaced(self, piece: str) -> bytes:
        """A piece that a space precedes; it may hold line breaks."""
        if piece.isalpha() and piece.isascii():  # one pre-token, by either pattern
            return self.parts[piece.lower() if self.lower else " " + piece]
        if _WORD(piece):
            found = self.part.findall(piece.lower() if self.lower else " " + piece)
            return self.parts[found[0]] if len(found) == 1 else b"".join([self.parts[x] for x in found])
        return b"".join(map(self._encode_piece, _PIECE.findall(" " + piece)))

    def encode(self, text: str | None) -> bytes:
        """The ids of a whole text; null: none."""
        if not text:
            return b""
        if _OTHER_SPACE.search(text) or self.added(text):
            return self._whole(text)
        if "  " in text or "\n " in text or "\t" in text or "\r" in text or text[-1] == " ":
            return b"".join(map(self._encode_piece, _PIECE.findall(text)))
        if self.lower and _is_latin(text):
            text = text.lower()
        first, *rest = text.split(" ")
        return b"".join(map(self._encode_piece, _PIECE.findall(first))) + b"".join(map(self.pieces.__getitem__, rest))


@lru_cache(maxsize=2)
def encoder(path: str, **bounds: int) -> Encoder:
    """One encoder of a file, with bounds of its caches, in each Python worker."""
    return Encoder(path, **bounds)
