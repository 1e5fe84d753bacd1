"""SimHash near-duplicates: fingerprints, and a binary-trie self-join for those a few bits apart.

Fingerprints within ``bits`` differing bits agree on at least one of ``bits + 1`` blocks, so each
distinct fingerprint goes to one group per block; the agreed block is the path from the root to the
trie node where the traversal starts. In a group the trie is implicit in the sorted fingerprints: a
node is a range, and node pairs are walked down together, adding a differing bit where the two turn
apart and stopping where the budget is spent. A group above ``HOT`` fingerprints is divided again by
blocks of its remaining bits, level by level, until no group is above it (after four levels at most
``2 ** 14`` fingerprints can share a group). Equal fingerprints are one node, so copies make no pairs,
and a group emits a spanning forest of its links.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import similar
from ..operators.graph import components
from .common import bounded_batches, checkpoint, small_enough, unused

HOT, LEVELS = 4096, 4


def fingerprint(text: bytes, width: int = 3) -> int:
    """The unsigned 64-bit fingerprint of a text: words between ASCII white space, A-Z lower-cased,
    shingles of ``width`` words with repeats (fewer words: the whole sequence; none: zero)."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return digest(joined, 42)
    spaces = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = [0, *(spaces[: len(words) - width] + 1).tolist()]
    ends = [*spaces[width - 1 :].tolist(), len(joined)]
    votes = np.zeros(64, np.int64)
    for k in range(0, len(starts), 65536):  # bounded memory for very long texts
        hashes = np.array([digest(joined[i:j], 42) for i, j in zip(starts[k : k + 65536], ends[k : k + 65536], strict=True)], np.uint64)
        votes += np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(starts), bitorder="little").view("<u8")[0])


def fingerprint_column(text: Column, width: int = 3) -> Column:
    """The fingerprint as a signed long, computed in Arrow batches; null counts as empty."""

    @F.arrow_udf("long")
    def udf(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint((t.as_py() or "").encode(), width) for t in texts], np.uint64).view(np.int64))

    return udf(text)


def linked(values: list[int], masks: int, bits: int) -> Iterator[tuple[int, int]]:
    """All pairs of the sorted distinct ``values`` that differ in at most ``bits`` of the bits in ``masks``."""
    order = [b for b in range(masks.bit_length() - 1, -1, -1) if masks >> b & 1]
    stack = [(0, len(values), 0, len(values), 0, 0)]
    while stack:
        a, b, c, d, depth, differ = stack.pop()
        if (b - a) * (d - c) <= 64 or depth == len(order):
            for i in range(a, b):
                x = values[i]
                for j in range(max(c, i + 1), d):
                    if (x ^ values[j]).bit_count() <= bits:
                        yield x, values[j]
            continue
        bit = 1 << order[depth]
        turn = lambda lo, hi: _first_set(values, lo, hi, bit)
        m = turn(a, b)
        n = m if (a, b) == (c, d) else turn(c, d)
        pairs = [(a, m, c, n, differ), (m, b, n, d, differ), (a, m, n, d, differ + 1)]
        if (a, b) != (c, d):
            pairs.append((m, b, c, n, differ + 1))
        stack += [(p, q, r, s, depth + 1, e) for p, q, r, s, e in pairs if p < q and r < s and e <= bits]


def _first_set(values: list[int], lo: int, hi: int, bit: int) -> int:
    """In a node's range: the first value with this bit set (higher free bits are equal, so those without come first)."""
    while lo < hi:
        middle = (lo + hi) // 2
        if values[middle] & bit:
            hi = middle
        else:
            lo = middle + 1
    return lo


def _blocks(free: int, parts: int) -> list[int]:
    """The set bits of ``free``, cut into ``parts`` masks of near equal size."""
    bits = [b for b in range(64) if free >> b & 1]
    return [sum(1 << b for b in bits[len(bits) * k // parts : len(bits) * (k + 1) // parts]) for k in range(parts)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _traversed(bits: int):
    full = (1 << 64) - 1

    def forest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, group = None, []

        def edges() -> list[tuple[int, int]]:
            if len(group) < 2:
                return []
            parent: dict[int, int] = {}

            def top(x: int) -> int:
                while parent.get(x, x) != x:
                    parent[x] = parent.get(parent[x], parent[x])
                    x = parent[x]
                return x

            out = []
            for x, y in linked(sorted(group), full & ~(at[0] & full), bits):
                p, q = top(x), top(y)
                if p != q:
                    parent[max(p, q)] = min(p, q)
                    out.append((x, y))
            return out

        out: list[tuple[int, int]] = []
        batch = lambda: pa.RecordBatch.from_arrays([pa.array([_signed(e[k]) for e in out], pa.int64()) for k in (0, 1)], ["a", "b"])
        for b in batches:
            for mask, key, value in zip(*(b.column(n).to_pylist() for n in ("mask", "key", "value")), strict=True):
                if (mask, key) != at:
                    out += edges()
                    at, group = (mask, key), []
                group.append(value & full)
            if len(out) > 20_000:
                yield batch()
                out = []
        out += edges()
        yield batch()

    return forest


def links(fingerprints: DataFrame, bits: int = 2, hot: int = HOT) -> DataFrame:
    """A spanning set of links ``(a, b)`` between the distinct values of ``fingerprints(value)`` that
    differ in 1 to ``bits`` bits; with the same connected components as all such links."""
    full, parts = (1 << 64) - 1, bits + 1
    children = {_signed(m): [_signed(m)] for m in _blocks(full, parts)}
    rows = fingerprints.select("value", F.explode(F.array(*(F.lit(m) for m in children))).alias("mask"))
    rows = rows.withColumn("key", F.col("value").bitwiseAND(F.col("mask")))
    cold: list[DataFrame] = []
    for level in range(LEVELS):
        heavy = checkpoint(rows.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot).select("mask", "key"), narrow=True)
        if level == LEVELS - 1 or heavy.isEmpty():
            break
        cold.append(rows.join(heavy, ["mask", "key"], "left_anti"))
        rows = rows.join(heavy, ["mask", "key"], "left_semi")
        children = {m: [_signed(m & full | x) for x in _blocks(full & ~(m & full), parts)] for ms in children.values() for m in ms}
        finer = F.create_map(*(x for m, ms in children.items() for x in (F.lit(m), F.array(*(F.lit(y) for y in ms)))))
        rows = rows.select("value", F.explode(F.element_at(finer, F.col("mask"))).alias("mask"))
        rows = rows.withColumn("key", F.col("value").bitwiseAND(F.col("mask")))
    for c in cold:
        rows = rows.unionByName(c.select("value", "mask", "key"))
    dealt = rows.repartition("mask", "key").sortWithinPartitions("mask", "key")
    return dealt.mapInArrow(_traversed(bits), "a long, b long")


def classes(prints: DataFrame, bits: int = 2) -> DataFrame:
    """``(value, component)`` for the distinct values of ``prints(value)``; the component is named by its smallest value."""
    values = checkpoint(prints.select("value").distinct(), narrow=True)
    joined = components(links(values, bits))
    return values.join(joined.withColumnRenamed("node", "value"), "value", "left").select("value", F.coalesce("component", "value").alias("component"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 2, width: int = 3) -> DataFrame:
    """Every document with its fingerprint and component.

    Columns: ``doc_id``, ``fingerprint`` (16 lowercase hex digits), ``component_id`` (the smallest id
    reachable over links of at most ``bits`` bits, the document's own included). Null and empty texts
    have fingerprint zero and link like others; null ids are kept and never name a component unless it
    has no other id; repeated rows come out as often as they came in; an empty table gives no rows.
    """
    prints = checkpoint(docs.select(F.col(id_col).alias("doc_id"), fingerprint_column(F.col(text_col).cast("string"), width).alias("value")))
    least = prints.groupBy("value").agg(F.min("doc_id").alias("doc_id"))
    named = classes(prints, bits).join(least, "value")
    ids = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    labels = named.select("value", "component").join(ids, "component").select("value", "component_id")
    return prints.join(labels, "value").select("doc_id", F.lower(F.lpad(F.hex("value"), 16, "0")).alias("fingerprint"), "component_id")


#: Jaccard similarity of word-shingle sets from which documents are near-duplicates.
SIMILAR = 0.8
#: Bits by which the first half of two fingerprints may differ for the trie to link them, at once whatever their size.
TRIE_BITS = 3
#: Sets whose 128 bits differ by more than this are not compared. Over all numbers of common and own shingles that make a similarity of 0.8,
#: a bit differs with a probability of 0.1875 at most (4 common, 1 own), and mostly of 0.152, so more than 50 of 128 differ in less
#: than one of ten million such pairs; a test adds up the chances.
BUDGET = 50
#: Texts that are sent to every worker by their hashes alone when their shingles are wanted.
BROADCAST = 500_000


def wide_fingerprint(items: np.ndarray) -> tuple[int, int]:
    """A set of shingles as 128 bits, in two signed halves: the bits that more than half of the shingles' hashes have."""
    votes = np.zeros(128, np.int64)
    for k in range(0, len(items), 65536):
        own = items[k : k + 65536]
        both = np.stack([own, (own ^ (own >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)], 1)
        votes += np.unpackbits(both.astype("<u8").view(np.uint8).reshape(-1, 16), axis=1, bitorder="little").sum(0, dtype=np.int64)
    a, b = np.packbits(votes * 2 > len(items), bitorder="little").view("<i8")
    return int(a), int(b)


def _described(width: int, keys: np.ndarray, counts: np.ndarray):
    """Each document's set of shingles: its name, size, fingerprint and, rare ones first, those of its prefix."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                found = [similar.shingles(t, width) for t in part.column("text").to_pylist()]
                prints = [wide_fingerprint(x) for x in found]
                first = [similar.rare_first(x, keys, counts)[: similar.prefix_length(len(x), SIMILAR)].tobytes() for x in found]
                columns = [pa.array([similar.set_id(x) for x in found], pa.int64()), pa.array([len(x) for x in found], pa.int64()), *(pa.array([p[k] for p in prints], pa.int64()) for k in (0, 1)), pa.array(first, pa.binary())]
                yield pa.RecordBatch.from_arrays([part.column("own"), part.column("hash"), *columns], ["own", "hash", "id", "n", "high", "low", "first"])

    return rows


def _spread(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, 256):
            parts = [np.frombuffer(x, np.int64) for x in b.column("first").slice(at, 256).to_pylist()]
            sizes = [len(x) for x in parts]
            of = lambda c: np.repeat(b.column(c).slice(at, 256).to_numpy(), sizes)  # noqa: B023, E731
            columns = [np.concatenate(parts), of("id"), of("n").astype(np.int32), np.concatenate([np.arange(k, dtype=np.int32) for k in sizes])]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "id", "n", "pos"])


def _met(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of keys that more than one set has, with the set that has the key foremost."""
    for key, *rest in similar.groups(batches):
        new = np.r_[True, key[1:] != key[:-1]]
        group = np.cumsum(new) - 1
        many = np.bincount(group)[group] > 1
        hub = rest[0][np.flatnonzero(new)][group]  # rows of a key come by position
        yield pa.RecordBatch.from_arrays([pa.array(c[many]) for c in (key, *rest, hub)], ["key", "id", "n", "pos", "hub"])


def _pairs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of sets of different parts under a key whose sizes, positions and fingerprints allow ``SIMILAR``."""
    out: list[np.ndarray] = []
    waiting = 0

    def batch() -> pa.RecordBatch:
        both = np.unique(np.concatenate(out or [np.empty((0, 2), np.int64)]), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(both[:, k]) for k in (0, 1)], ["a", "b"])

    for key, ids, n, pos, part, high, low in similar.groups(batches):
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        for start, end in zip(starts, np.r_[starts[1:], len(key)], strict=True):
            if (part[start:end] == part[start]).all():
                continue
            for i in range(start, end - 1):
                j = slice(i + 1, end)
                # what precedes the first shingle that both have is not shared
                good = (part[j] != part[i]) & (np.minimum(n[i] - pos[i], n[j] - pos[j]) >= SIMILAR / (1 + SIMILAR) * (n[i] + n[j]) - 1e-9)
                at = np.flatnonzero(good) + i + 1
                if len(at):
                    apart = np.bitwise_count(high[at] ^ high[i]).astype(np.int64) + np.bitwise_count(low[at] ^ low[i])
                    at = at[apart <= BUDGET]
                if len(at):
                    out.append(np.stack([np.minimum(ids[at], ids[i]), np.maximum(ids[at], ids[i])], 1))
                    waiting += len(at)
                    if waiting > 200_000:
                        yield batch()
                        out, waiting = [], 0
    yield batch()


def verified(pairs: DataFrame, texts: DataFrame, names: DataFrame, width: int) -> DataFrame:
    """The ``pairs(a, b)`` of sets that have a Jaccard similarity of ``SIMILAR``, from their shingles. ``names(id, hash)`` tells a
    set's text by its hash, ``texts(hash, text)`` has the texts."""
    pairs = checkpoint(pairs, narrow=True)
    ids = pairs.select(F.col("a").alias("id")).unionAll(pairs.select(F.col("b").alias("id"))).distinct()
    wanted = checkpoint(names.join(ids, "id", "left_semi"), joined=True)
    side = F.broadcast(wanted) if small_enough(wanted.count(), BROADCAST) else wanted

    @F.arrow_udf("binary")
    def items(found: pa.Array) -> pa.Array:
        return pa.array([similar.shingles(t.as_py(), width).tobytes() for t in found], pa.binary())

    @F.arrow_udf("boolean")
    def near(a: pa.Array, b: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(a, b, strict=True):
            p, q = (np.frombuffer(v.as_py(), np.uint64) for v in (x, y))
            both = similar.shared(p, q)
            out.append(both >= SIMILAR * (len(p) + len(q) - both) - 1e-9)
        return pa.array(out, pa.bool_())

    sets = checkpoint(texts.join(side, "hash").dropDuplicates(["id"]).select("id", items("text").alias("items")))
    rows = pairs.join(sets.select(F.col("id").alias("a"), F.col("items").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("items").alias("y")), "b")
    return rows.where(near("x", "y")).select("a", "b")


def similar_classes(sets: DataFrame, prefixes: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """``(id, component)`` for the ``sets(id, hash, n, high, low)`` with the prefixes ``prefixes(id, n, first)`` that have a similar one.

    Candidates are the links of the trie over the fingerprints' first halves, equal ones, and for every set the one that it meets
    most often under the shingles of its prefix. Verified, they join most of each large group by about as many comparisons as it
    has members. Then all sets that meet, are in different components and whose fingerprints are within the budget are compared.
    """
    value = F.col("high").alias("value")
    first = checkpoint(sets.groupBy("high").agg(F.min("id").alias("id")), narrow=True)
    close = links(first.select(value), TRIE_BITS)
    a, b = (first.select(F.col("high").alias(x), F.col("id").alias(f"{x}_id")) for x in "ab")
    edges = close.join(a, "a").join(b, "b").select(F.least("a_id", "b_id").alias("a"), F.greatest("a_id", "b_id").alias("b"))
    equal = sets.join(first.withColumnRenamed("id", "least"), "high").where("id <> least").select(F.col("least").alias("a"), F.col("id").alias("b"))
    spread = prefixes.mapInArrow(_spread, "key long, id long, n int, pos int")
    met = checkpoint(spread.repartition("key").sortWithinPartitions("key", "pos", "id").mapInArrow(_met, "key long, id long, n int, pos int, hub long"), narrow=True)
    prints = sets.select("id", "n", "high", "low")
    other = prints.select(*(F.col(c).alias(f"hub_{c}" if c != "id" else "hub") for c in prints.columns))
    often = met.where("id <> hub").groupBy("id", "hub").agg(F.count(F.lit(1)).alias("times")).join(prints, "id").join(other, "hub")
    apart = F.bit_count(F.col("high").bitwiseXOR(F.col("hub_high"))) + F.bit_count(F.col("low").bitwiseXOR(F.col("hub_low")))
    few, many = F.least("n", "hub_n"), F.greatest("n", "hub_n")
    often = often.where((few >= SIMILAR * many - 1e-9) & (apart <= BUDGET))
    most = often.groupBy("id").agg(F.max_by("hub", F.struct("times", "hub")).alias("hub")).select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b"))
    edges = checkpoint(verified(edges.unionAll(equal).unionAll(most).distinct(), texts, sets.select("id", "hash"), width), joined=True)
    parts = components(edges).withColumnRenamed("node", "id")
    rows = met.drop("hub").join(prints.drop("n"), "id").join(parts, "id", "left").select("key", "id", "n", "pos", F.coalesce("component", "id").alias("part"), "high", "low")
    more = rows.repartition("key").sortWithinPartitions("key", "id").mapInArrow(_pairs, "a long, b long").distinct()
    return components(edges.unionAll(verified(more, texts, sets.select("id", "hash"), width))).withColumnRenamed("node", "id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5) -> DataFrame:
    """``docs`` with one row of every group of documents whose sets of ``width``-word shingles are linked by Jaccard similarities
    of ``SIMILAR`` or more; all columns stay. Kept is the row with the smallest id (null last), then the smallest
    text hash; equal repeated rows of it are one row. Null and empty texts are one group."""
    bounded_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    texts = docs.select(F.xxhash64(text).alias("hash"), text.alias("text"))
    common = similar.common_shingles(texts.select("text"), width)
    kind = docs.schema[id_col].dataType.simpleString()
    described = docs.select(F.col(id_col).alias("own"), F.xxhash64(text).alias("hash"), text.alias("text")).mapInArrow(_described(width, *common), f"own {kind}, hash long, id long, n long, high long, low long, first binary")
    prints = checkpoint(described)
    best = F.min(F.struct(F.col("own").isNull().alias("no_id"), F.col("own").alias("id"), F.col("hash").alias("hash"))).alias("best")
    sets = checkpoint(prints.groupBy("id").agg(best, *(F.min(c).alias(c) for c in ("n", "high", "low"))), narrow=True)
    prefixes = prints.select("id", "n", "first").dropDuplicates(["id"])
    classes_of = similar_classes(sets.withColumn("hash", F.col("best.hash")), prefixes, texts, width)
    named = sets.select("id", "best").join(classes_of, "id", "left")
    kept = named.groupBy(F.coalesce("component", "id").alias("component")).agg(F.min("best").alias("best"))
    kept_id, kept_hash, own_hash = unused(docs, "kept_id"), unused(docs, "kept_hash"), unused(docs, "text_hash")
    kept = checkpoint(kept.select(F.col("best.id").alias(kept_id), F.col("best.hash").alias(kept_hash)), joined=True)
    copies = prints.groupBy(F.col("own").alias(kept_id), F.col("hash").alias(kept_hash)).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    same = lambda a, b: F.col(f"{a}.{kept_id}").eqNullSafe(F.col(f"{b}.{kept_id}")) & (F.col(f"{a}.{kept_hash}") == F.col(f"{b}.{kept_hash}"))
    repeated = checkpoint(kept.alias("k").join(copies.alias("c"), same("k", "c"), "left_semi"), joined=True)

    def matching(side: DataFrame) -> DataFrame:
        rows = docs.withColumn(own_hash, F.xxhash64(text))
        return rows.join(side, rows[id_col].eqNullSafe(side[kept_id]) & (rows[own_hash] == side[kept_hash]), "left_semi")

    if repeated.isEmpty():
        return matching(kept).drop(own_hash)
    # equal rows are reduced where they are read, so their number doesn't matter
    others = kept.alias("k").join(repeated.alias("r"), same("k", "r"), "left_anti")
    return matching(others).unionAll(matching(repeated).dropDuplicates([id_col, own_hash])).drop(own_hash)
