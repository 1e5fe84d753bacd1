"""Pairs of texts that share most of their word shingles, found exactly by prefix filtering.

Shingles are put into one order, rare ones first. Two sets that share at least ``share`` of each can't differ in
all of their first ``n - ceil(share * n) + 1`` shingles, so texts that meet under none of these are no pair;
those that meet are candidates, to be verified. Any order is lossless: it is taken from a sample, so that
common shingles seldom count among the first.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import checkpoint

#: Texts whose shingles are counted for the order, and the most shingles that it holds.
SAMPLE, COMMON = 8192, 200_000


def shingles(text: str | None, width: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles: words between ASCII white space, A-Z lower-cased (fewer
    words than ``width``: the whole sequence; none: an empty array)."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    starts, ends = [0], [len(joined)]
    if len(words) > width:
        spaces = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
        starts += (spaces[: len(words) - width] + 1).tolist()
        ends = [*spaces[width - 1 :].tolist(), len(joined)]
    return np.unique(np.array([xxhash.xxh64_intdigest(joined[i:j], 42) for i, j in zip(starts, ends, strict=True)], np.uint64))


def set_id(items: np.ndarray) -> int:
    """A signed 64-bit hash of a set of shingles."""
    return int(np.uint64(xxhash.xxh64_intdigest(items.tobytes())).view(np.int64))


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """How many shingles two arrays of :func:`shingles` have in common."""
    return len(np.intersect1d(a, b, assume_unique=True))


def prefix_length(n: int, share: float) -> int:
    return n - int(np.ceil(share * n - 1e-9)) + 1 if n else 0


def common_shingles(texts: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that occur in more than one text of a sample of ``texts(text)``, sorted, and how often."""

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):
                found = [shingles(t, width) for t in b.column("text").slice(at, 64).to_pylist()]
                keys, counts = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts.astype(np.int64))], ["key", "n"])

    each = max(1, texts.count() // SAMPLE)
    sample = texts.where(F.pmod(F.xxhash64("text"), F.lit(each)) == 0)
    rows = sample.mapInArrow(counted, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where("n > 1").orderBy(F.desc("n"), "key").limit(COMMON).toArrow()
    keys = rows["key"].to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return keys[order], rows["n"].to_numpy()[order]


def rare_first(items: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Shingles in the order that :func:`common_shingles` gives."""
    weight = np.zeros(len(items), np.int64)
    if len(keys) and len(items):
        at = np.minimum(np.searchsorted(keys, items), len(keys) - 1)
        weight = np.where(keys[at] == items, counts[at], 0)
    return items[np.lexsort((items, weight))]


def meetings(texts: DataFrame, width: int, share: float) -> DataFrame:
    """``key``, ``id``, ``n``, ``pos`` and ``hub`` wherever texts of ``texts(id, text)`` with different ids meet under one of
    their first shingles; the hub is the text of that shingle that has it foremost. Equal ids are one text; without the
    column, :func:`set_id` is the id."""
    own = "id" in texts.columns
    keys, counts = common_shingles(texts.select("text"), width)

    def described(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):
                found = [shingles(t, width) for t in b.column("text").slice(at, 64).to_pylist()]
                ids = b.column("id").slice(at, 64) if own else pa.array([set_id(x) for x in found], pa.int64())
                first = pa.array([rare_first(x, keys, counts)[: prefix_length(len(x), share)].tobytes() for x in found], pa.binary())
                yield pa.RecordBatch.from_arrays([ids, pa.array([len(x) for x in found], pa.int64()), first], ["id", "n", "first"])

    def spread(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                parts = [np.frombuffer(x, np.int64) for x in b.column("first").slice(at, 256).to_pylist()]
                sizes = [len(x) for x in parts]
                of = lambda c: np.repeat(b.column(c).slice(at, 256).to_numpy(), sizes)  # noqa: B023, E731
                columns = [np.concatenate(parts), of("id"), of("n"), np.concatenate([np.arange(k) for k in sizes])]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "id", "n", "pos"])

    def met(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches):
            key = table[0]
            new = np.r_[True, key[1:] != key[:-1]]
            group = np.cumsum(new) - 1
            many = np.bincount(group)[group] > 1
            hub = table[1][np.flatnonzero(new)][group]  # rows of a key come by position
            yield pa.RecordBatch.from_arrays([pa.array(c[many]) for c in (*table, hub)], ["key", "id", "n", "pos", "hub"])

    one = texts.mapInArrow(described, "id long, n long, first binary").dropDuplicates(["id"])
    rows = one.mapInArrow(spread, "key long, id long, n long, pos long")
    dealt = rows.repartition("key").sortWithinPartitions("key", "pos", "id")
    return checkpoint(dealt.mapInArrow(met, "key long, id long, n long, pos long, hub long"))


def groups(batches: Iterable[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Rows sorted by their first column, as arrays that hold whole groups of it."""
    held: list[list[np.ndarray]] = []
    for b in batches:
        if not b.num_rows:
            continue
        now = [c.to_numpy() for c in b.columns]
        cut = int(np.searchsorted(now[0], now[0][-1]))  # the last group may go on
        if cut or (held and held[-1][0][-1] != now[0][0]):
            done = [*held, [c[:cut] for c in now]]
            yield [np.concatenate(c) for c in zip(*done, strict=True)]
            held = []
        held.append([c[cut:] for c in now])
    if held:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def candidates(rows: DataFrame, share: float, jaccard: bool) -> DataFrame:
    """Distinct ``(a, b)``, ``a < b``, of the rows ``(key, id, n, pos, part)`` of :func:`meetings` whose parts differ and whose sizes and
    positions allow a Jaccard similarity of ``share``, or else ``share`` of the larger set in common."""

    def pairs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[np.ndarray] = []
        waiting = 0

        def batch() -> pa.RecordBatch:
            both = np.unique(np.concatenate(out or [np.empty((0, 2), np.int64)]), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(both[:, k]) for k in (0, 1)], ["a", "b"])

        for key, ids, n, pos, part in groups(batches):
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            for low, high in zip(starts, np.r_[starts[1:], len(key)], strict=True):
                for i in range(low, high - 1):
                    j = slice(i + 1, high)
                    least = share / (1 + share) * (n[i] + n[j]) if jaccard else share * np.maximum(n[i], n[j])
                    # what precedes the first shingle that both have is not shared
                    good = (part[j] != part[i]) & (np.minimum(n[i] - pos[i], n[j] - pos[j]) >= least - 1e-9)
                    if good.any():
                        other = ids[j][good]
                        out.append(np.stack([np.minimum(other, ids[i]), np.maximum(other, ids[i])], 1))
                        waiting += len(other)
                        if waiting > 500_000:
                            yield batch()
                            out, waiting = [], 0
        yield batch()

    dealt = rows.select("key", "id", "n", "pos", "part").repartition("key").sortWithinPartitions("key", "id")
    return dealt.mapInArrow(pairs, "a long, b long").distinct()
