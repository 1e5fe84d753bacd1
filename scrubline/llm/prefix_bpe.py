"""BPE encoding by dynamic programming over prefixes, and decoding, for word files with word ends.

For each prefix of a word the encoding's last token is unique: it is the vocabulary token that ends the
prefix and is compatible with the last token of the prefix before it. Two tokens are compatible if the
merges, run on both together, end with just these two. An automaton over the vocabulary yields the
tokens that are suffixes of each prefix, longest first; the accepted one is stored, and following the
back-pointers from the whole word emits the exact ids.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .cached_encoder import byte_characters
from .common import bounded_batches, text_of

#: One character that stands for the end of a word in the automaton.
END = "￿"
#: Chunks between white space kept at once, and pairs of tokens; each cache starts anew beyond it.
CACHE = 200_000
#: Python splits at these, the normaliser's white space doesn't include them.
_SEPARATORS = "\x1c\x1d\x1e\x1f"
#: Outside these ranges Python's Unicode tables may be of another version than the library's.
_ODD = re.compile("[^\x00-\u02ff\u2000-\u205f\u20a0-\u20bf]")


class PrefixBpe:
    """Encodes and decodes like the tokenizers library does with a word-end BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"]
        self.vocab: dict[str, int] = model["vocab"]
        self.table = dict(enumerate(byte_characters()))
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(model["merges"]):
            self.merges.setdefault((self.vocab[a], self.vocab[b]), (rank, self.vocab[a + b]))
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in self.vocab.items()} | {i: s for s, i in self.added.items()}
        self.split_added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.pretokens = regex.compile(next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"))
        self.automaton = ahocorasick.Automaton()
        self.symbols: dict[int, list[int]] = {}
        for s, i in self.vocab.items():
            word = s[: -len(self.suffix)] + END if s.endswith(self.suffix) and len(s) > len(self.suffix) else s
            parts = [self.vocab[c] for c in word[:-2]] + [self.vocab[word[-2] + self.suffix]] if word.endswith(END) else [self.vocab[c] for c in word]
            if self.merged(parts) == [i]:  # a token that its own merges don't reach is never emitted
                self.symbols[i] = parts
                self.automaton.add_word(word, (i, len(word)))
        self.automaton.make_automaton()
        self.pairs: dict[tuple[int, int], bool] = {}
        self.words: dict[str, tuple[int, bytes, bytes]] = {}
        self.chunks: dict[str, tuple[int, bytes, bytes]] = {}

    def merged(self, parts: list[int]) -> list[int]:
        """The merges run to their end on a list of symbols: lowest rank first, leftmost among equals."""
        parts = list(parts)
        while len(parts) > 1:
            rank, at, new = min(((*self.merges[p][:1], k, self.merges[p][1]) for k, p in enumerate(zip(parts, parts[1:])) if p in self.merges), default=(None, 0, 0))
            if rank is None:
                break
            parts[at : at + 2] = [new]
        return parts

    def compatible(self, a: int, b: int) -> bool:
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) >= CACHE:
                self.pairs.clear()
            known = self.pairs[a, b] = self.merged(self.symbols[a] + self.symbols[b]) == [a, b]
        return known

    def encode_word(self, word: str) -> list[int]:
        """The ids of one pre-token."""
        text = word.encode().decode("latin-1").translate(self.table) + END
        last: list[tuple[int, int] | None] = [None] * (len(text) + 1)
        known, compatible = self.pairs, self.compatible
        for end, (token, length) in self.automaton.iter(text):
            at, start = end + 1, end + 1 - length
            if last[at] is None:
                if start == 0:
                    last[at] = (token, 0)
                elif (before := last[start]) is not None:
                    pair = (before[0], token)
                    if known[pair] if pair in known else compatible(*pair):
                        last[at] = (token, start)
        ids, at = [], len(text)
        while at:
            token, at = last[at]
            ids.append(token)
        return ids[::-1]

    def _digest(self, ids: list[int]) -> tuple[int, bytes, bytes]:
        return len(ids), struct.pack(f"<{len(ids)}I", *ids), " ".join([self.strings[i] for i in ids]).encode()

    def _word(self, word: str) -> tuple[int, bytes, bytes]:
        kept = self.chunks if word.isalpha() else self.words  # a chunk of letters is one word
        found = kept.get(word)
        if found is None:
            if len(kept) >= CACHE:
                kept.clear()
            found = kept[word] = self._digest(self.encode_word(word))
        return found

    def _chunk(self, chunk: str) -> tuple[int, bytes, bytes]:
        if chunk.isalpha():
            return self._word(chunk)
        found = self.chunks.get(chunk)
        if found is None:
            if chunk[-1] in ".," and chunk[:-1].isalpha():
                parts = [self._word(chunk[:-1]), self._word(chunk[-1])]
            else:
                parts = [self._word(w) for w in self.pretokens.findall(chunk)]
            if len(self.chunks) >= CACHE:
                self.chunks.clear()
            found = self.chunks[chunk] = parts[0] if len(parts) == 1 else (sum(p[0] for p in parts), b"".join(p[1] for p in parts), b" ".join(p[2] for p in parts))
        return found

    def encode(self, text: str) -> tuple[int, bytes, bytes]:
        """Number of ids, the ids as little-endian unsigned 32-bit integers, and the decoded text in UTF-8."""
        out: list[tuple[int, bytes, bytes]] = []
        for piece in self.split_added.split(text) if self.split_added and any(a in text for a in self.added) else (text,):
            if piece in self.added:
                out.append(self._digest([self.added[piece]]))
                continue
            if not piece.isascii() and _ODD.search(piece):  # the library's own normaliser and splitter, then the same merges
                piece = self.library.normalizer.normalize_str(piece)
                out += [self._word(piece[a:b]) for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(piece)]
                continue
            piece = unicodedata.normalize("NFC", piece).lower()
            if any(c in piece for c in _SEPARATORS):
                out += [self._word(w) for w in self.pretokens.findall(piece)]
            else:
                chunk, known = self._chunk, self.chunks.get
                out += [known(c) or chunk(c) for c in piece.split()]
        return sum([o[0] for o in out]), b"".join([o[1] for o in out]), b" ".join([o[2] for o in out])

    def decode(self, ids: Iterable[int]) -> str:
        """As the library decodes without a decoder and with special tokens: token strings joined by spaces."""
        return " ".join(self.strings[i] for i in ids if i in self.strings)


@lru_cache(2)
def coder(path: str) -> PrefixBpe:
    """One coder per worker and file."""
    return PrefixBpe(path)


def _coded(path: str, with_ids: bool):
    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = coder(path)
        for batch in batches:
            out = []
            for text in batch.column("text"):
                n, ids, decoded = tool.encode(text.as_py())
                out.append((n, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest(), ids))
            columns = list(zip(*out, strict=True)) or [()] * 4
            arrays = [batch.column("doc_id"), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                arrays.append(pa.array(columns[3], pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)

    return rows


def encode_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Every whole text encoded and decoded.

    Columns: ``doc_id``, ``n_tokens``, ``ids_sha256`` (of the ids as little-endian unsigned 32-bit integers),
    ``decoded_sha256`` (of the decoded text in UTF-8) and, with ``with_ids``, ``ids`` (those bytes). Null and
    empty texts give no ids; null ids and repeated rows stay; no rows give no rows.
    """
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(_coded(tokenizer, with_ids), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids)
