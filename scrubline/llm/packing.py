"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Groups (equal texts) are the items. Best-fit-decreasing cares for sizes only, and equal sizes are interchangeable, so
the driver packs the histogram of group sizes: a bin that is the tightest for one group stays the tightest for the
next ones of the same size until it is full, so they enter in one step, with the same result as one by one. What the
driver holds are the distinct sizes and the bins, not the groups. Every group then finds its rank among the groups of
its size, and the range of ranks that entered a bin names its shard. No group is split, bundled or left out.

For a fixed number of shards the capacity is raised from an even share until best-fit-decreasing needs no more bins,
then narrowed by bisection. A group larger than an even share gets a shard of its own first, since
no packing can make that shard smaller; the rest share the remaining shards evenly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpoint, small_enough

#: Groups of one size, or rows of one shard, that are numbered by one task.
RANKED = 250_000
#: Groups with at least this share of all rows are joined by broadcast; there are at most as many as its inverse.
HOT = 1 / 1000
#: Ranges of ranks that are broadcast, at most.
BROADCAST_RANGES = 500_000

#: Groups of ``size`` with ranks from ``first`` to before ``end`` are in ``bin``.
Range = tuple[int, int, int, int]


class _Node:
    __slots__ = ("key", "left", "right", "height")

    def __init__(self, key: tuple[int, int]):
        self.key, self.left, self.right, self.height = key, None, None, 1


class BinTree:
    """A height-balanced search tree over ``(remaining capacity, bin)``."""

    def __init__(self) -> None:
        self.root: _Node | None = None

    @staticmethod
    def _height(n: _Node | None) -> int:
        return n.height if n else 0

    def _rotated(self, n: _Node, left: bool) -> _Node:
        up = n.right if left else n.left
        if left:
            n.right, up.left = up.left, n
        else:
            n.left, up.right = up.right, n
        n.height = 1 + max(self._height(n.left), self._height(n.right))
        up.height = 1 + max(self._height(up.left), self._height(up.right))
        return up

    def _balanced(self, n: _Node) -> _Node:
        n.height = 1 + max(self._height(n.left), self._height(n.right))
        lean = self._height(n.left) - self._height(n.right)
        if lean > 1:
            if self._height(n.left.left) < self._height(n.left.right):
                n.left = self._rotated(n.left, True)
            return self._rotated(n, False)
        if lean < -1:
            if self._height(n.right.right) < self._height(n.right.left):
                n.right = self._rotated(n.right, False)
            return self._rotated(n, True)
        return n

    def insert(self, key: tuple[int, int]) -> None:
        def put(n: _Node | None) -> _Node:
            if n is None:
                return _Node(key)
            if key < n.key:
                n.left = put(n.left)
            else:
                n.right = put(n.right)
            return self._balanced(n)

        self.root = put(self.root)

    def take_tightest(self, size: int) -> tuple[int, int] | None:
        """Remove and return the bin with the least remaining capacity that is at least ``size``."""
        found, n = None, self.root
        while n:
            if n.key[0] >= size:
                found, n = n.key, n.left
            else:
                n = n.right
        if found is not None:
            self._remove(found)
        return found

    def _remove(self, key: tuple[int, int]) -> None:
        def cut(n: _Node, key: tuple[int, int]) -> _Node | None:
            if key < n.key:
                n.left = cut(n.left, key)
            elif key > n.key:
                n.right = cut(n.right, key)
            elif n.left and n.right:
                low = n.right
                while low.left:
                    low = low.left
                n.key = low.key
                n.right = cut(n.right, low.key)
            else:
                return n.left or n.right
            return self._balanced(n)

        self.root = cut(self.root, key)


def best_fit_decreasing(histogram: list[tuple[int, int]], capacity: int, most: int | None = None) -> list[Range] | None:
    """Pack ``histogram`` of sizes and counts: items go in by falling size, each enters the tightest bin that holds it, the
    lowest-numbered among equals, or opens a new bin. An item larger than the capacity gets a bin that takes nothing
    else. None if more than ``most`` bins are needed."""
    out: list[Range] = []
    tree, opened = BinTree(), 0
    for size, count in sorted(histogram, reverse=True):
        placed = 0
        while placed < count:
            at = tree.take_tightest(size)
            if at is None:
                if opened == most:
                    return None
                at = (max(capacity, size), opened)
                opened += 1
            n = min(count - placed, at[0] // size) if size else count - placed
            out.append((size, placed, placed + n, at[1]))
            placed += n
            tree.insert((at[0] - n * size, at[1]))
    return out


def pack_into(histogram: list[tuple[int, int]], shards: int) -> list[Range]:
    """The shards of the items so that sizes are near equal: own shards for items over an even share,
    then best-fit-decreasing with a least capacity that suffices for the others."""
    rest, left, total = sorted(([s, n] for s, n in histogram if n), reverse=True), shards, sum(s * n for s, n in histogram)
    out: list[Range] = []
    gone = dict.fromkeys((s for s, _ in rest), 0)
    while left > 1 and rest and rest[0][0] * left >= total and total:
        size = rest[0][0]
        left -= 1
        out.append((size, gone[size], gone[size] + 1, left))
        gone[size] += 1
        total -= size
        rest[0][1] -= 1
        if not rest[0][1]:
            rest.pop(0)
    if not rest:
        return out
    low = high = max(rest[0][0], -(-total // left))
    step = 1
    while (found := best_fit_decreasing(rest, high, left)) is None:
        low, high, step = high + 1, high + step, 2 * step
    while low < high:
        middle = (low + high) // 2
        tried = best_fit_decreasing(rest, middle, left)
        if tried is None:
            low = middle + 1
        else:
            found, high = tried, middle
    return out + [(s, a + gone[s], b + gone[s], k) for s, a, b, k in found]


def _numbered(rows: DataFrame, group: str, order: list[str], spread: str) -> DataFrame:
    """``rows`` with ``rank``, from 0 without gaps in each ``group``. A group of more than ``RANKED`` rows is cut into parts by the hash
    of ``spread``, which are numbered by themselves and put one after the other."""
    sizes = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > RANKED)
    large = checkpoint(sizes.select(F.col(group).alias("large"), F.ceil(F.col("n") / RANKED).cast("long").alias("parts")))  # at most the rows / RANKED
    cut = rows.join(F.broadcast(large), F.col(group) == F.col("large"), "left").withColumn("part", F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64(spread), F.col("parts"))).otherwise(F.lit(0).cast("long"))).drop("large")
    counts = cut.where("parts is not null").groupBy(group, "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = checkpoint(counts.select(F.col(group).alias("large"), F.col("part").alias("large_part"), before.alias("before")))
    cut = cut.join(F.broadcast(starts), (F.col(group) == F.col("large")) & (F.col("part") == F.col("large_part")), "left")
    own = F.row_number().over(Window.partitionBy(group, "part").orderBy(*order)) - 1
    return cut.withColumn("rank", F.coalesce("before", F.lit(0)) + own).drop("parts", "part", "large", "large_part", "before")


def shard_documents(docs: DataFrame, shards: int | None = 24, capacity: int | None = None, id_col: str = "doc_id", text_col: str = "text", overhead: int = 8) -> DataFrame:
    """Every document with its shard; documents with equal texts stay together.

    Give ``shards`` for a fixed number with near equal bytes, or ``capacity`` in bytes for as few shards
    as best-fit-decreasing finds. Columns: ``doc_id``, ``size`` (UTF-8 bytes plus ``overhead``),
    ``text_crc32`` (unsigned), ``shard``, ``slot`` (from 0 without gaps in each shard). A null text has
    size ``overhead``, the crc of the empty text and, with the other null texts, a group of its own; null ids, ties
    and repeated rows are placed like others; an empty table gives no rows.
    """
    spark = docs.sparkSession
    text = F.col(text_col).cast("string")
    base = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + overhead).alias("size"),
        F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"),
        F.coalesce(F.unhex(F.sha2(text, 256)), F.lit(b"")).alias("key"),
        F.monotonically_increasing_id().alias("row"),  # spreads rows that are equal in all else
    )
    base = checkpoint(base, narrow=True)  # one pass over the texts; what follows moves about 60 bytes a document
    groups = checkpoint(base.groupBy("key").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")), narrow=True)
    histogram = [tuple(r) for r in groups.groupBy("bytes").agg(F.count(F.lit(1)).alias("n")).collect()]  # distinct sizes
    placed = (pack_into(histogram, shards) if shards else best_fit_decreasing(histogram, capacity)) if histogram else []
    ranges = spark.createDataFrame(placed, "in_size long, first long, end long, shard int")
    side = F.broadcast(ranges) if small_enough(len(placed), BROADCAST_RANGES) else ranges
    ranked = _numbered(groups, "bytes", ["key"], "key")
    homes = ranked.join(side, (F.col("bytes") == F.col("in_size")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("end")))
    homes = checkpoint(homes.select("key", "shard", "rows"), joined=True)
    n_rows = homes.agg(F.sum("rows")).first()[0] or 0
    hot = F.broadcast(homes.where(F.col("rows") >= max(2, HOT * n_rows)).select("key", "shard"))
    cold = homes.where(F.col("rows") < max(2, HOT * n_rows)).select("key", "shard")
    rows = base.join(hot, "key").unionByName(base.join(hot, "key", "left_anti").join(cold, "key")).drop("key")
    return _numbered(rows, "shard", ["doc_id", "text_crc32", "row"], "row").select("doc_id", "size", "text_crc32", "shard", F.col("rank").alias("slot"))
