"""Byte-level encoding with the tokenizers library and a bounded cache of words.

Pre-tokens of the byte-level pattern never reach across the place where a word is followed by white
space, so a text's ids are those of its white-space-led words in order. Each worker encodes a word once
and then looks it up; texts whose white space is anything but single spaces and line ends go through
a pattern that keeps each run of white space with the word it leads.
"""

from __future__ import annotations

import re
import struct
from functools import lru_cache

from tokenizers import Tokenizer

#: The characters of the Unicode property White_Space besides space and line feed.
OTHER_SPACE = "\t\x0b\x0c\r\x85\xa0                　"
_PIECES = re.compile(f"[ \n{OTHER_SPACE}]*[^ \n{OTHER_SPACE}]+|[ \n{OTHER_SPACE}]+")
#: Words kept at once; the cache starts anew beyond it.
CACHE = 400_000


@lru_cache(1)
def byte_characters() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    out, extra = [""] * 256, 256
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b], extra = chr(extra), extra + 1
    return out


class _Words(dict):
    """Word to ids, packed as little-endian unsigned 32-bit integers; encodes what is missing."""

    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE:
            self.clear()
        ids = self[word] = self.encode(word)
        return ids


class CachedEncoder:
    """Ids as ``Tokenizer.encode(text, add_special_tokens=False)`` gives them, for byte-level files."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.model = self.tokenizer.model
        self.table = dict(enumerate(byte_characters()))
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.led = _Words(lambda w: self._encode(" " + w))
        self.bare = _Words(self._encode)
        self.line_end = self._encode("\n")

    def _piece(self, word: str) -> list[int]:
        return [t.id for t in self.model.tokenize(word.encode().decode("latin-1").translate(self.table))]

    def _encode(self, word: str) -> bytes:
        letters = word[1:] if word[:1] == " " else word
        if letters.isalpha():
            ids = self._piece(word)
        elif letters[-1:] in (".", ",") and letters[:-1].isalpha():
            ids = self._piece(word[:-1]) + self._piece(word[-1])
        else:
            ids = self.tokenizer.encode(word, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        for s in self.special:
            if s in text:
                ids = self.tokenizer.encode(text, add_special_tokens=False).ids
                return struct.pack(f"<{len(ids)}I", *ids)
        if text[-1:] in (" ", "\n") or "  " in text or " \n" in text or "\n " in text or "\n\n" in text or any(c in text for c in OTHER_SPACE):
            return b"".join(map(self.bare.__getitem__, _PIECES.findall(text)))
        led, bare, out = self.led.__getitem__, self.bare, []
        for line in text.split("\n"):
            words = line.split(" ")
            out.append(bare[words[0]] if words[0] else b"")
            out.append(b"".join(map(led, words[1:])))
        return self.line_end.join(a + b for a, b in zip(out[::2], out[1::2], strict=True))


@lru_cache(2)
def encoder(path: str) -> CachedEncoder:
    """One encoder per worker and file."""
    return CachedEncoder(path)
