"""Whole texts to token ids, as the tokenizers library gives them, word by word.

A text is cut only at places where the library's own splitting cuts too, whatever stands
around them; each distinct piece is encoded once in a Python worker and its ids remembered.
Ids are bytes: little-endian unsigned 32-bit integers.

* Byte-level vocabularies: their splitting pattern begins a new piece at every white space
  that follows a non-space, and a single space before a non-space belongs to what follows.
* Word vocabularies (white space dropped): pieces never reach over white space.

Texts that hold a special token or one of the separators U+001C to U+001F, whose class
differs between engines, go through the library whole.
"""

from __future__ import annotations

import json
import re
import sys
from array import array
from functools import lru_cache

#: Words after which a worker begins a new memory; it still looks into the one before, so what
#: is met again and again is never encoded anew and memory is bounded.
REMEMBERED = 600_000
TAIL = ".,;:!?"
SEPARATORS = re.compile("[\x1c-\x1f]")
PIECES = re.compile(r" ?[^\s]+|\s+(?!\S)|\s+")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {b: chr(b) for b in shown}
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + len(out) - len(shown))
    return [out[b] for b in range(256)]


class _Whole(Exception):
    """The text has white space that the quick splitting doesn't cover."""


class _Words(dict):
    """Word -> ids as bytes; encodes what it doesn't hold."""

    def __init__(self, encode):
        self.encode, self.before = encode, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.before.get(word)
        if ids is None:
            ids = self.encode(word)
        if len(self) >= REMEMBERED:
            self.before = dict(self)
            self.clear()
        self[word] = ids
        return ids


def _as_bytes(ids: list[int]) -> bytes:
    numbers = array("I", ids)
    if sys.byteorder == "big":
        numbers.byteswap()
    return numbers.tobytes()


class Encoder:
    """encode(text) -> ids as bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        self.model = self.library.model
        self.special = [t["content"] for t in spec["added_tokens"]]
        split = spec["pre_tokenizer"] or {}
        self.spaced = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not spec["normalizer"]
        self.dropped = (
            [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
            and [p["type"] for p in split.get("pretokenizers", [])] == ["Split", "ByteLevel"]
        )
        self.table = {b: s for b, s in enumerate(byte_symbols())}
        self.bare = _Words(lambda w: self._word(w, ""))
        self.led = _Words(lambda w: self._word(w, " "))
        self.pieces = _Words(self._library)

    def _library(self, text: str) -> bytes:
        return _as_bytes(self.library.encode(text, add_special_tokens=False).ids)

    def _letters(self, word: str, lead: str) -> bytes:
        """Ids of a word of common letters, straight from the model."""
        symbols = (lead + word).encode().decode("latin-1").translate(self.table)
        return _as_bytes([t.id for t in self.model.tokenize(symbols)])

    def _word(self, word: str, lead: str) -> bytes:
        if word.split() != [word]:
            raise _Whole
        core = word.rstrip(TAIL)
        if core.isalpha() and (core.isascii() or max(core) < "ɐ"):
            small = core.lower() if self.dropped else core
            if small == word:
                return self._letters(word, lead)
            if small.isalpha():  # letters and signs are encoded apart, and so the word may be known
                return (self.led if lead else self.bare)[small] + (self.bare[word[len(core) :]] if core != word else b"")
        return self._library(lead + word)

    def encode_piece(self, piece: str) -> bytes:
        """Ids of one piece of a text, with the space that it may begin with; nothing is remembered."""
        word = piece.removeprefix(" ")
        if any(s in piece for s in self.special) or len(word.split()) != 1 or word != word.strip():
            return self._library(piece)
        return self._word(word, " " if word != piece else "")

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if any(s in text for s in self.special) or not (self.spaced or self.dropped) or SEPARATORS.search(text):
            return self._library(text)
        if self.dropped:
            return b"".join(map(self.bare.__getitem__, text.split()))
        try:
            out, bare, led = [], self.bare, self.led.__getitem__
            for line in text.split("\n"):
                words = line.split(" ")
                out.append(bare[words[0]])
                out.extend(map(led, words[1:]))
                out.append(self.pieces["\n"])
            return b"".join(out[:-1])
        except _Whole:
            return b"".join(map(self.pieces.__getitem__, PIECES.findall(text)))


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """The encoder of a vocabulary file, one for each Python worker."""
    return Encoder(path)


def forget() -> None:
    """Free what this worker remembers of words; for work of another kind that needs the memory."""
    encoder.cache_clear()
