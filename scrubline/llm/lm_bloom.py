"""Language-model scoring with a log-frequency Bloom filter.

A document is its words and one end; every token is scored after the one before it, the first after a start.
Word and bigram counts of the training documents are gathered by bucket: the first bits of the 64-bit hash of
the word, or of the bigram's first word. A first word that a sample shows to be frequent has its bigrams spread
over several buckets, so buckets stay near equal; where counts are added up changes no result.

Each bucket's bigrams, those seen once too, become a Bloom filter: a bigram of count c is inserted with every
level from 1 to ``level_of(c)``, and a query probes level after level until one is missing. A level stands for
one fixed count, the middle of its range. Words, which the base score needs with exact counts, are a sorted
table that also holds, for each word, the stored counts and the number of the bigrams it begins.

A bucket's task writes it to a file of the shared folder, and the driver sees its name and size only. Buckets are joined into
segments of about ``SEGMENT_BYTES``. A task reads its texts once and takes the segments from their files, one after the other, for
every batch of documents, so a larger corpus has more segments, never larger ones, and nothing is written back between them. Where
Python can't open the shared folder, a segment is a broadcast, and the driver holds one at a time.

The probabilities are absolute discounting, with Q the count that a bigram's level stands for and the sums over
all w taken from the stored counts themselves, so that they add up to one:

P(w | v) = max(Q(v w) - D2, 0) / Z(v) + D2 T(v) / Z(v) P(w),   Z(v) = sum of Q(v w) + E (V + 1 - T(v)) (1 - D2),
P(w) = max(c(w) - D1, 0) / N + D1 V / N / (V + 1),

T(v): bigrams that v begins; D = n1 / (n1 + 2 n2 + 1) of words and of bigrams. E is the chance that the filter affirms a
bigram it doesn't hold; a bucket probes its first level so often that E V is at most about 1/16, and what such answers
add on average is in Z. All unknown words together are one word of P.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, opened_folder, own_folder, remove_folder, text_of

BASE, LEVELS = 1.5, 64
#: Probes at the first level beyond the bits of the vocabulary's size, and at every further level.
MORE_PROBES, LEVEL_PROBES = 4, 8
SEGMENT_BYTES = 16 << 20
#: N-grams held in memory before they are sorted and sent on, tokens scored at once, and words whose hashes are kept.
CHUNK, BATCH, CACHE = 2_000_000, 500_000, 300_000
#: Bytes of text per bucket, of a piece of a long text, and of the sample that finds frequent words; most frequent words.
BUCKET_BYTES, PIECE_BYTES, SAMPLE_BYTES, MOST_HOT = 16 << 20, 4 << 20, 32 << 20, 1 << 16
END, START = (np.uint64(xxhash.xxh3_64_intdigest(x)) for x in (b"\n", b"\t"))
_SPACE = b" \t\n\v\f\r"


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = _Hashes()


def pieces(text: str, size: int | None = None) -> Iterator[np.ndarray]:
    """The hashes of a text's words (between ASCII white space, A-Z lower-cased) and of its end, some million at a time."""
    data, at, size = text.encode().lower(), 0, size or PIECE_BYTES
    while True:
        stop = at + size
        while stop < len(data) and data[stop] not in _SPACE:
            stop += 1
        words = data[at:stop].split()
        tokens = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
        at = stop
        if at >= len(data):
            yield np.append(tokens, END)
            return
        if len(tokens):
            yield tokens


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit integers (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bigram_hash(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return _mixed(before * np.uint64(0x9E3779B97F4A7C15) + word)


#: The least count of each level; level 0 is for 0.
EDGES = np.ceil(BASE ** np.arange(LEVELS - 1) - 1e-9)


def level_of(counts: np.ndarray) -> np.ndarray:
    """The stored level of each count: 1 for 1, growing with the logarithm; 0 for 0."""
    return np.searchsorted(EDGES, counts, side="right")


#: Twice the count that each level stands for: the least and the greatest count of the level together.
TWICE = np.concatenate([[0], EDGES[:-1] + EDGES[1:] - 1, [2 * EDGES[-1]]]).astype(np.int64)


@dataclass
class Deal:
    """Which bucket holds a word or a bigram."""

    bits: int
    hot: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint64))
    spread: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))

    def of_words(self, words: np.ndarray) -> np.ndarray:
        return (words >> np.uint64(64 - self.bits)).astype(np.int64)

    def is_hot(self, words: np.ndarray) -> np.ndarray:
        if not len(self.hot):
            return np.zeros(len(words), bool)
        return self.hot[np.minimum(np.searchsorted(self.hot, words), len(self.hot) - 1)] == words

    def of_bigrams(self, before: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        out = self.of_words(before)
        many = np.flatnonzero(self.is_hot(before))
        if len(many):
            spread = self.spread[np.searchsorted(self.hot, before[many])]
            out[many] = (out[many] + (hashes[many] >> np.uint64(32)).astype(np.int64) % spread) % (1 << self.bits)
        return out


def _small(counts: np.ndarray) -> bytes:
    few = np.minimum(counts, 255).astype(np.uint8)
    return few.tobytes() + counts[few == 255].astype("<u8").tobytes()


def _unsmall(data: bytes, n: int, at: int) -> tuple[np.ndarray, int]:
    counts = np.frombuffer(data, np.uint8, n, at).astype(np.int64)
    large = int((counts == 255).sum())
    counts[counts == 255] = np.frombuffer(data, "<u8", large, at + n)
    return counts, at + n + 8 * large


def _packed(words: np.ndarray, counts: np.ndarray, before: np.ndarray, after: np.ndarray, times: np.ndarray) -> bytes:
    """Word counts and bigram counts of one bucket; ``before`` is sorted and stored once for each run."""
    first = np.flatnonzero(np.concatenate([[True], before[1:] != before[:-1]])) if len(before) else np.empty(0, np.int64)
    runs = np.diff(np.append(first, len(before)))
    head = np.array([len(words), len(first), len(before)], "<u8").tobytes()
    return b"".join([head, words.astype("<u8").tobytes(), _small(counts), before[first].astype("<u8").tobytes(), runs.astype("<u4").tobytes(), after.astype("<u8").tobytes(), _small(times)])


def _unpacked(data: bytes) -> tuple[np.ndarray, ...]:
    n_words, n_first, n = (int(x) for x in np.frombuffer(data, "<u8", 3))
    at = 24
    words = np.frombuffer(data[at : at + 8 * n_words], "<u8")
    counts, at = _unsmall(data, n_words, at + 8 * n_words)
    first, runs = np.frombuffer(data[at : at + 8 * n_first], "<u8"), np.frombuffer(data[at + 8 * n_first : at + 12 * n_first], "<u4")
    at += 12 * n_first
    after = np.frombuffer(data[at : at + 8 * n], "<u8")
    times, _ = _unsmall(data, n, at + 8 * n)
    return words, counts, np.repeat(first, runs), after, times


def _summed(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes in order, their summed counts, and where each first stood."""
    order = np.argsort(hashes, kind="stable")
    hashes = hashes[order]
    first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])) if len(hashes) else np.empty(0, np.int64)
    return hashes[first], np.add.reduceat(counts[order], first) if len(first) else counts, order[first]


def _local(parts: list[np.ndarray], opens: list[np.uint64]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes of the tokens of ``parts`` and of the ``opens`` before them, and among these the places of each token and of
    the one before it."""
    n, starts = sum(map(len, parts)), np.concatenate([[0], np.cumsum([len(p) for p in parts])[:-1]]).astype(np.int64)
    kinds, back = np.unique(np.concatenate([*parts, np.array(opens, np.uint64)]), return_inverse=True)
    at = back[:n].astype(np.uint32)
    before = np.empty(n, np.uint32)
    before[1:] = at[:-1]
    before[starts] = back[n:]
    return kinds, at, before


def _pairs(at: np.ndarray, before: np.ndarray) -> np.ndarray:
    return before.astype(np.uint64) << np.uint64(32) | at


def _counted(deal: Deal):
    """N-gram counts of a task's documents, by bucket."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[np.ndarray] = []
        opens: list[np.uint64] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            kinds, at, at_before = _local(parts, opens)
            parts.clear()
            counts = np.bincount(at, minlength=len(kinds))
            pairs, times = np.unique(_pairs(at, at_before), return_counts=True)
            before, after = kinds[pairs >> np.uint64(32)], kinds[pairs & np.uint64(0xFFFFFFFF)]
            where = deal.of_bigrams(before, bigram_hash(before, after))
            order = np.argsort(where, kind="stable")
            before, after, times = before[order], after[order], times[order]
            edges = np.arange((1 << deal.bits) + 1)
            pair_cuts = np.searchsorted(where[order], edges)
            seen = counts > 0  # a start is no word
            words, counts = kinds[seen], counts[seen]
            word_cuts = np.searchsorted(deal.of_words(words), edges)
            filled = np.flatnonzero((pair_cuts[1:] > pair_cuts[:-1]) | (word_cuts[1:] > word_cuts[:-1])).tolist()
            for k in range(0, len(filled), 256):
                own = filled[k : k + 256]
                data = []
                for b in own:
                    w, p = slice(word_cuts[b], word_cuts[b + 1]), slice(pair_cuts[b], pair_cuts[b + 1])
                    data.append(_packed(words[w], counts[w], before[p], after[p], times[p]))
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(data, pa.binary())], ["bucket", "data"])

        for batch in batches:
            for text in batch.column("text"):
                last = START
                for tokens in pieces(text.as_py()):
                    parts.append(tokens)
                    opens.append(last)
                    last = tokens[-1]
                    size += len(tokens)
                    if size >= CHUNK:
                        yield from flush()
                        parts, opens, size = [], [], 0
        if size:
            yield from flush()

    return rows


def _places(hashes: np.ndarray, level: int, m: np.ndarray, probes: int) -> Iterator[np.ndarray]:
    a = _mixed(hashes + np.uint64(level * 0x632BE59BD9B4E019 & (1 << 64) - 1))
    b = _mixed(a) | np.uint64(1)
    for _ in range(probes):
        yield (a >> np.uint64(32)) * m >> np.uint64(32)
        a = a + b


def _filter(hashes: np.ndarray, levels: np.ndarray, probes: tuple[int, int]) -> tuple[int, bytes]:
    """Bits, half of them set, in which each hash is found at every level up to its own."""
    above = int(levels.sum()) - len(levels)
    m = max(64, int((len(levels) * probes[0] + above * probes[1]) / np.log(2) / 8 + 1) * 8)
    bits = np.zeros(m, bool)
    for level in range(1, int(levels.max(initial=0)) + 1):
        for at in _places(hashes[levels >= level], level, np.uint64(m), probes[level > 1]):
            bits[at] = True
    return m, np.packbits(bits, bitorder="little").tobytes()


def _bucket(deal: Deal, fixed: tuple[int, int] | None, uri: str | None):
    """One bucket: its words with exact counts and sums, its bigrams' filter, and its share of frequent words' sums. Filter and words
    go to a file in ``uri``, of another name for each attempt of a task; without it they stay in the row."""

    def made(table: pa.Table) -> pa.Table:
        parts = [_unpacked(d.as_py()) for d in table.column("data")]
        words, counts, _ = _summed(*(np.concatenate([p[k] for p in parts]) for k in (0, 1)))
        before, after, times = (np.concatenate([p[k] for p in parts]) for k in (2, 3, 4))
        parts.clear()
        hashes, times, at = _summed(bigram_hash(before, after), times)
        before = before[at]
        levels = level_of(times)
        kinds, back = np.unique(before, return_inverse=True)
        of, sums = np.bincount(back, minlength=len(kinds)), np.bincount(back, TWICE[levels], len(kinds)).astype(np.int64)
        hot = deal.is_hot(kinds)
        names = np.union1d(words, kinds[~hot])
        columns = [np.zeros(len(names), np.int64) for _ in range(3)]
        columns[0][np.searchsorted(names, words)] = counts
        for column, values in zip(columns[1:], (of, sums), strict=True):
            column[np.searchsorted(names, kinds[~hot])] = values[~hot]
        # a bucket has an even share of the vocabulary, since words are dealt by their hashes
        probes = fixed or (max(8, (len(words) << deal.bits).bit_length() + MORE_PROBES), LEVEL_PROBES)
        m, bits = _filter(hashes, levels, probes)
        stats = [len(words), int(counts.sum()), *(int((x == k).sum()) for x in (counts, times) for k in (1, 2))]
        packed = b"".join([names.astype("<u8").tobytes(), *(_small(c) for c in columns)])
        shares = [{"word": w, "followers": f, "sum": s} for w, f, s in zip(kinds[hot].view(np.int64).tolist(), of[hot].tolist(), sums[hot].tolist(), strict=True)]
        file = f"{table.column('bucket')[0].as_py()}-{uuid.uuid4().hex}"
        if uri:
            system, inside = fs.FileSystem.from_uri(uri)
            with system.open_output_stream(f"{inside}/{file}") as f:
                f.write(bits)
                f.write(packed)
        row = {"bucket": table.column("bucket")[0].as_py(), "m": m, "probes": probes, "n": len(names), "cut": len(bits), "size": len(bits) + len(packed), "file": file, "data": None if uri else bits + packed, "stats": stats, "shares": shares}
        return pa.table({k: pa.array([row[k]], kind) for k, kind in _BUCKET.items()})

    return made


_BUCKET = {"bucket": pa.int32(), "m": pa.int64(), "probes": pa.list_(pa.int32()), "n": pa.int64(), "cut": pa.int64(), "size": pa.int64(), "file": pa.string(), "data": pa.binary(), "stats": pa.list_(pa.int64()), "shares": pa.list_(pa.struct([("word", pa.int64()), ("followers", pa.int64()), ("sum", pa.int64())]))}
_BUCKET_SCHEMA = "bucket int, m long, probes array<int>, n long, cut long, size long, file string, data binary, stats array<long>, shares array<struct<word: long, followers: long, sum: long>>"


class Segment:
    """The word tables and filters of some buckets."""

    def __init__(self, rows: list[dict], deal: Deal):
        rows = sorted(rows, key=lambda r: r["bucket"])  # so names ascend
        self.deal, self.buckets = deal, np.array([r["bucket"] for r in rows], np.int64)
        self.m, self.probes = np.array([r["m"] for r in rows], np.uint64), np.array([r["probes"] for r in rows], np.int64).reshape(-1, 2).T
        sizes = np.array([len(r["bits"]) for r in rows], np.int64)
        self.start = np.cumsum(sizes) - sizes
        self.bits = np.frombuffer(b"".join(r["bits"] for r in rows), np.uint8)
        names, columns = [], []
        for r in rows:
            n, data = r["n"], bytes(r["words"])
            names.append(np.frombuffer(data[: 8 * n], "<u8"))
            at, own = 8 * n, []
            for _ in range(3):
                values, at = _unsmall(data, n, at)
                own.append(values.astype(np.uint32) if values.max(initial=0) < 1 << 32 else values)
            columns.append(own)
        self.names = np.concatenate(names)
        self.columns = [np.concatenate([c[k] for c in columns]) for k in range(3)]

    def words(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where hashes stand that this segment's table holds, and their columns: count, bigrams begun, twice the sum of their
        stored counts, and their bucket's probes."""
        if not len(self.names):
            return np.empty(0, np.int64), np.empty((4, 0), np.int64)
        at = np.minimum(np.searchsorted(self.names, hashes), len(self.names) - 1)
        found = np.flatnonzero(self.names[at] == hashes)
        return found, np.array([*(c[at[found]] for c in self.columns), self.probes[0, np.searchsorted(self.buckets, self.deal.of_words(hashes[found]))]], np.int64)

    def levels(self, buckets: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """For each bigram of these buckets the last level that is found; 0 if none is."""
        own = np.minimum(np.searchsorted(self.buckets, buckets), len(self.buckets) - 1)
        out, left = np.zeros(len(hashes), np.uint8), np.flatnonzero(self.buckets[own] == buckets)
        for level in range(1, LEVELS):
            if not len(left):
                break
            needed = self.probes[int(level > 1), own[left]]
            m, start = self.m[own[left]], self.start[own[left]]
            a = _mixed(hashes[left] + np.uint64(level * 0x632BE59BD9B4E019 & (1 << 64) - 1))
            b = _mixed(a) | np.uint64(1)
            found = np.ones(len(left), bool)
            for k in range(int(needed.max())):  # as in _places
                at = ((a >> np.uint64(32)) * m >> np.uint64(32)).astype(np.int64)
                found &= (self.bits[start + (at >> 3)] >> (at & 7).astype(np.uint8) & 1 == 1) | (needed <= k)
                if np.count_nonzero(found) < 0.9 * len(found):  # those missing a probe drop out, many at once
                    left, needed, m, start, a, b = (x[found] for x in (left, needed, m, start, a, b))
                    found = np.ones(len(left), bool)
                    if not len(left):
                        break
                a = a + b
            left = left[found]
            out[left] = level
        return out


def _loaded(rows: list[dict], uri: str | None, deal: Deal) -> Segment:
    """The segment of buckets that ``_bucket`` made."""

    def whole(r: dict) -> dict:
        if uri:
            with system.open_input_file(f"{inside}/{r['file']}") as f:
                data = memoryview(f.read_buffer())
        else:
            data = memoryview(r["data"])
        return r | {"bits": data[: r["cut"]], "words": data[r["cut"] :]}

    system, inside = fs.FileSystem.from_uri(uri) if uri else (None, None)
    return Segment([whole(r) for r in rows], deal)


@dataclass
class Model:
    """Totals of the training documents, and what they make of counts and levels."""

    n: int = 0
    v: int = 0
    discounts: tuple[float, float] = (0.5, 0.5)
    deal: Deal = field(default_factory=lambda: Deal(4))
    homes: np.ndarray = field(default_factory=lambda: np.zeros(16, np.int32))  # the segment of each bucket
    sums: dict[int, tuple[int, int]] = field(default_factory=dict)  # of frequent words

    def single(self, counts: np.ndarray) -> np.ndarray:
        """P(w) of words with these counts, 0 for unknown ones."""
        d = self.discounts[0]
        return np.maximum(counts - d, 0) / self.n + d * self.v / self.n / (self.v + 1)

    def after(self, single: np.ndarray, levels: np.ndarray, followers: np.ndarray, sums: np.ndarray, probes: np.ndarray) -> np.ndarray:
        """P(w | v) from P(w), the bigram's level, the bigrams that v begins: how many, and twice their stored counts, and the probes of
        v's bucket at the first level."""
        d = self.discounts[1]
        whole = sums / 2 + 0.5**probes * np.maximum(self.v + 1 - followers, 0) * (1 - d)
        with np.errstate(divide="ignore", invalid="ignore"):
            out = (np.maximum(TWICE[levels] / 2 - d, 0) + d * followers * single) / whole
        return np.where(followers > 0, out, single)


class Stored:
    """A segment in files; ``value`` reads it, as that of a broadcast does."""

    def __init__(self, rows: list[dict], uri: str, model: Broadcast):
        self.rows, self.uri, self.model = rows, uri, model

    @property
    def value(self) -> Segment:
        if "_value" not in self.__dict__:
            self._value = _loaded(self.rows, self.uri, self.model.value.deal)
        return self._value


def _scored(sent: Broadcast, segments: list[Broadcast] | list[Stored]):
    """Scores of documents; every batch of about ``BATCH`` tokens meets one segment after the other."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = sent.value

        def segment(k: int) -> Segment:
            for other in range(len(segments)):
                if other != k:  # one segment in memory
                    segments[other].__dict__.pop("_value", None)
            return segments[k].value

        turn = [range(len(segments)), range(len(segments) - 1, -1, -1)]

        def totals(parts: list[np.ndarray], opens: list[np.uint64]) -> list[np.ndarray]:
            """For each part: tokens, known tokens, and the sums of both logarithms."""
            kinds, at, at_before = _local(parts, opens)
            pairs, back = np.unique(_pairs(at, at_before), return_inverse=True)
            word, first = (pairs & np.uint64(0xFFFFFFFF)).astype(np.int64), (pairs >> np.uint64(32)).astype(np.int64)
            hashes = bigram_hash(kinds[first], kinds[word])
            buckets, own = model.deal.of_bigrams(kinds[first], hashes), np.zeros((4, len(kinds)), np.int64)
            levels, homes = np.zeros(len(pairs), np.uint8), model.homes[buckets]
            order = np.argsort(homes, kind="stable")
            for k in turn[0]:
                s = segment(k)
                found, columns = s.words(kinds)
                own[:, found] = columns
                mine = order[slice(*np.searchsorted(homes, (k, k + 1), sorter=order))]
                levels[mine] = s.levels(buckets[mine], hashes[mine])
            turn.reverse()
            for k in np.flatnonzero(model.deal.is_hot(kinds)):
                own[1:3, k] = model.sums.get(int(kinds[k]), (0, 0))
            counts = own[0]
            p = model.after(model.single(counts)[word], levels, *own[1:, first]) if model.n else np.ones(len(pairs))
            base = np.log10((counts + 1.0) / (model.n + model.v + 1))
            ends = np.cumsum([len(x) for x in parts])[:-1]
            starts = np.concatenate([[0], ends]).astype(np.int64)
            return [np.array([len(x) for x in parts]), *(np.add.reduceat(x, starts) for x in ((counts > 0).astype(np.int64)[at], base[at], np.log10(p)[back]))]

        for batch in batches:
            out = [np.zeros(batch.num_rows, kind) for kind in (np.int64, np.int64, float, float)]
            parts, opens, whose, size = [], [], [], 0

            def add() -> None:
                for total, values in zip(out, totals(parts, opens), strict=True):  # noqa: B023
                    np.add.at(total, whose, values)  # noqa: B023

            for k, text in enumerate(batch.column("text")):
                last = START
                for tokens in pieces(text.as_py()):
                    parts.append(tokens)
                    opens.append(last)
                    whose.append(k)
                    last = tokens[-1]
                    size += len(tokens)
                    if size >= BATCH:
                        add()
                        parts, opens, whose, size = [], [], [], 0
            if size:
                add()
            known = pa.array(np.full(batch.num_rows, model.n), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(out[0]), pa.array(out[1]), known, pa.array(out[2]), pa.array(out[3])], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return rows


def _frequent(texts: DataFrame, volume: int, bits: int) -> Deal:
    """Words that begin more than a quarter bucket of the bigrams in a sample, and over how many buckets theirs are spread."""

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column("text"):
                for tokens in pieces(text.as_py()):
                    kinds, n = np.unique(tokens, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(kinds.view(np.int64)), pa.array(n)], ["word", "n"])

    each = max(1, volume // SAMPLE_BYTES)
    found = checkpoint(texts.where(F.pmod(F.xxhash64("text"), F.lit(each)) == 0).mapInArrow(counted, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")))
    total = found.agg(F.sum("n")).first()[0] or 0
    parts = 4 << bits
    many = found.where((F.col("n") * parts >= total) & (F.col("n") > 1)).orderBy(F.desc("n"), "word").limit(MOST_HOT).collect()
    if not many:
        return Deal(bits)
    hot, n = np.array([r["word"] for r in many], np.int64).view(np.uint64), np.array([r["n"] for r in many])
    order = np.argsort(hot)
    return Deal(bits, hot[order], np.minimum(np.ceil(n[order] / total * parts).astype(np.int64), 1 << bits))


def _trained(texts: DataFrame, volume: int, probes: tuple[int, int] | None, bucket_bytes: int, segment_bytes: int, uri: str | None) -> tuple[Model, Iterator[list[dict]]]:
    """The model, and the buckets of its segments, for ``_loaded``; the model's homes are filled in as they come."""
    bits = max(4, int(np.ceil(np.log2(max(1, volume / bucket_bytes)))))
    deal = _frequent(texts, volume, bits)
    counted = texts.mapInArrow(_counted(deal), "bucket int, data binary")
    buckets = checkpoint(counted.groupBy("bucket").applyInArrow(_bucket(deal, probes, uri), _BUCKET_SCHEMA))
    stats = buckets.select(*(F.sum(F.get("stats", F.lit(k))).alias(f"s{k}") for k in range(6))).first()
    v, n, *times = (stats[k] or 0 for k in range(6))
    discount = lambda once, twice: once / (once + 2 * twice + 1) if once else 0.5
    shares = buckets.select(F.explode("shares").alias("s")).groupBy("s.word").agg(F.sum("s.followers").alias("f"), F.sum("s.sum").alias("q")).collect()  # at most MOST_HOT rows
    sums = {int(np.int64(r["word"]).view(np.uint64)): (r["f"], r["q"]) for r in shares}
    model = Model(n, v, (discount(*times[:2]), discount(*times[2:])), deal, sums=sums)
    model.homes = np.full(1 << bits, -1, np.int32)  # no segment: an empty bucket

    def groups() -> Iterator[list[dict]]:
        held, size, number = [], 0, 0
        found = buckets.drop("stats", "shares")
        # names and sizes, a row for some 16 MB of text; whole buckets come one partition at a time
        for r in found.drop("data").collect() if uri else found.toLocalIterator():
            model.homes[r["bucket"]] = number
            held.append(r.asDict())
            size += r["size"]
            if size >= segment_bytes:
                done, held, size, number = held, [], 0, number + 1
                yield done
                del done
        if held:
            yield held

    return model, groups()


def train(texts: DataFrame, volume: int, probes: tuple[int, int] | None = None, bucket_bytes: int = BUCKET_BYTES, segment_bytes: int = SEGMENT_BYTES) -> tuple[Model, Iterator[Segment]]:
    """The model of the training texts ``texts(text)`` of about ``volume`` bytes, and its segments, one at a time."""
    folder = own_folder(texts.sparkSession, "lm-bloom")
    uri = opened_folder(texts.sparkSession, folder)
    model, groups = _trained(texts, volume, probes, bucket_bytes, segment_bytes, uri)

    def segments() -> Iterator[Segment]:
        for rows in groups:
            yield _loaded(rows, uri, model.deal)
        remove_folder(texts.sparkSession, folder)

    return model, segments()


def score_documents(docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text", probes: tuple[int, int] | None = None, bucket_bytes: int = BUCKET_BYTES, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """Base and model scores of every whole text, trained on the documents where ``held_out`` (a column) is false.

    Columns: ``doc_id``, ``held_out``, ``n_tokens`` (words and one end), ``n_known`` (of them, seen in training),
    ``train_tokens``, ``base_score`` (log10, add-one word model) and ``score`` (log10 of the model's probability). A null
    ``held_out`` counts as false. Null and empty texts are an end alone. Repeated rows count and are scored as
    often as they occur; an empty table gives no rows; without training documents both scores are zero logs.
    Counts are kept by 64-bit word hash. ``probes`` (first level, further levels) is otherwise set by the vocabulary.
    """
    spark, context = docs.sparkSession, docs.sparkSession.sparkContext
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), text_of(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    texts = rows.where(~F.col("held_out")).select("text")
    volume = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    folder = own_folder(spark, "lm-bloom")
    uri = opened_folder(spark, folder)
    try:
        model, groups = _trained(texts, volume, probes, bucket_bytes, segment_bytes, uri)
        # either fills in the model's homes
        parts = list(groups) if uri else [context.broadcast(_loaded(g, uri, model.deal)) for g in groups]
        whole = context.broadcast(model)
        segments = [Stored(g, uri, whole) for g in parts] if uri else parts
        scores = checkpoint(rows.mapInArrow(_scored(whole, segments), f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"))
        for b in [whole, *(() if uri else parts)]:  # the scores are written, some 60 bytes a document
            b.destroy()
    finally:
        remove_folder(spark, folder)
    return scores
