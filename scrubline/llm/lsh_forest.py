"""Nearest neighbours by a hash-prefix forest (cosine).

Each tree hashes a vector to a long bit string of random-hyperplane signs; a tree is the sorted array of its strings, cut
into groups by their first bits so that a group has about ``GROUP`` rows. Queries are shuffled to the groups of their own
strings; no query and no row meets more of a tree than that.

Descent: in every tree a query goes to its longest matching prefixes, which stand next to its place in the sorted
array. The rows found there are scored, and the k-th best cosine c gives the level to which all trees then ascend
together: a row of cosine c shares the first x bits of a tree with probability p^x, p = 1 - acos(c) / pi, so it is missed by
all T trees with probability (1 - p^x)^T; x is the longest prefix for which that is at most ``MISS``. Better neighbours
share longer prefixes and are missed less. All rows under the prefixes at that level are then scored in double precision.

On vectors with near neighbours few rows are looked at; on vectors without structure the level falls, at 0 to all
rows, which is the exact way. The column ``candidates`` tells how many rows were scored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpoint, small_enough

TREES, BITS, MISS = 128, 32, 0.1
#: Rows of a group of a tree, rows on each side of a query's place that the descent looks at, and rows and queries scored together.
GROUP, BESIDE, BLOCK, QUERIES = 4096, 4, 16384, 512
#: Groups above twice GROUP that are broadcast, at most.
BROADCAST_GROUPS = 100_000


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Unit vectors; scaled first so that squares neither overflow nor vanish."""
    scaled = vectors / np.abs(vectors).max(1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(1, keepdims=True))


def _planes(size: int, trees: int, bits: int) -> np.ndarray:
    return np.random.default_rng([7, size]).standard_normal((size, trees * bits))


def codes(vectors: np.ndarray, trees: int = TREES, bits: int = BITS) -> np.ndarray:
    """The bit strings of unit vectors, one column for each tree, the first bit the highest."""
    signs = (vectors @ _planes(vectors.shape[1], trees, bits) > 0).reshape(len(vectors), trees, bits)
    return signs @ (1 << np.arange(bits - 1, -1, -1, dtype=np.int64))


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as a matrix."""
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)


def _hashed(trees: int, bits: int):
    def rows(batches):
        for batch in batches:
            sizes = np.asarray(batch.column("size"))
            for size in np.unique(sizes):
                own = batch.filter(pa.array(sizes == size))
                for at in range(0, own.num_rows, 1024):
                    part = own.slice(at, 1024)
                    found = codes(_unit(_matrix(part.column("v"))), trees, bits)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * trees, pa.int32()), pa.array(found.ravel()))
                    yield pa.RecordBatch.from_arrays([*part.columns, lists], [*part.schema.names, "codes"])

    return rows


#: Rows found for a query in one group of a tree, by the block in which they are scored.
_LISTS = "query long, block long, ids binary"


def _lists(found: list[tuple[int, int, bytes]]) -> pa.Table:
    columns = list(zip(*found, strict=True)) or [()] * 3
    return pa.table({n: pa.array(c, t) for n, c, t in zip(("query", "block", "ids"), columns, (pa.int64(), pa.int64(), pa.binary()), strict=True)})


def _descended(blocks: int, beside: int):
    """For each query of a group the rows next to its place."""

    def group(index: pa.Table, asked: pa.Table) -> pa.Table:
        code, ids = np.asarray(index.column("code")), np.asarray(index.column("id"))
        order = np.argsort(code, kind="stable")
        at = np.searchsorted(code[order], np.asarray(asked.column("code")))
        found = []
        for query, place in zip(asked.column("query").to_pylist(), at.tolist(), strict=True):
            own = ids[order[max(0, place - beside) : place + beside]]
            homes = own % blocks
            found += [(query, int(b), own[homes == b].tobytes()) for b in np.unique(homes)]
        return _lists(found)

    return group


def _ascended(blocks: int, bits: int):
    """For each query of a group all rows that share its prefix at its level."""

    def group(index: pa.Table, asked: pa.Table) -> pa.Table:
        code, ids = np.asarray(index.column("code")), np.asarray(index.column("id"))
        own, rest, queries = np.asarray(asked.column("code")), bits - np.asarray(asked.column("level")), asked.column("query").to_pylist()
        homes, found = ids % blocks, []
        for b in np.unique(homes):
            mine = np.flatnonzero(homes == b)
            mine = mine[np.argsort(code[mine], kind="stable")]
            low, high = np.searchsorted(code[mine], own >> rest << rest), np.searchsorted(code[mine], (own >> rest) + 1 << rest)
            found += [(query, int(b), ids[mine[x:y]].tobytes()) for query, x, y in zip(queries, low.tolist(), high.tolist(), strict=True) if x < y]
        return _lists(found)

    return group


def _scored(k: int):
    """The k best of a block's rows for each query that has candidates in it, and how many were scored."""

    def block(rows: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[list] = [[] for _ in range(4)]
        if rows.num_rows and asked.num_rows:
            rows = rows.sort_by("id").combine_chunks()
            ids, sizes = np.asarray(rows.column("id")), np.asarray(rows.column("size"))
            units, place = {}, np.empty(len(ids), np.int64)
            for s in np.unique(sizes):
                mine = np.flatnonzero(sizes == s)
                units[s], place[mine] = _unit(_matrix(rows.column("v").combine_chunks().take(pa.array(mine)))), np.arange(len(mine))
            for query, v, found in zip(asked.column("query").to_pylist(), asked.column("v"), asked.column("ids"), strict=True):
                vector = np.asarray(v.values, dtype=np.float64)[None]
                at = np.searchsorted(ids, np.unique(np.concatenate([np.frombuffer(x.as_py(), np.int64) for x in found])))
                values = np.einsum("ij,j->i", units[vector.shape[1]][place[at]], _unit(vector)[0])
                for i in np.lexsort((ids[at], -values))[:k]:
                    for column, x in zip(out, (query, int(ids[at[i]]), float(values[i]), 0), strict=True):
                        column.append(x)
                out[3][-1] = len(at)
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("query", "id", "score", "n"), out, (pa.int64(), pa.int64(), pa.float64(), pa.int64()), strict=True)})

    return block


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", trees: int = TREES, bits: int = BITS, miss: float = MISS, group: int = GROUP, block: int = BLOCK) -> DataFrame:
    """The ``k`` nearest rows of ``vectors`` for each row of ``queries``, as found by the forest.

    Columns: ``query_id``, ``rank`` (from 1), ``vec_id``, ``score`` (cosine in double precision of the
    original vectors), nearest first, ties to the smaller id; all candidates where there are fewer; and ``candidates``,
    the number of distinct vectors scored. Rows with the query's own id are no candidates. Null vectors, zero
    vectors, vectors that hold null or non-finite components, and null ids take no part; a vector's candidates are the
    vectors of its length, since a cosine needs two of the same.
    A repeated query id is asked once, with the vector of the smallest hash; repeated rows of
    ``vectors`` are separate candidates. Empty tables give no rows.
    """

    def sound(df: DataFrame) -> DataFrame:
        v = F.col(vector_col).cast("array<double>")
        rows = df.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where("id is not null and v is not null")
        finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        return rows.where(finite & F.exists("v", lambda x: x != 0))

    # equal vectors are one row of the index, whose k + 1 smallest ids are all that a result can name; a hot one is salted first
    few = lambda c: F.slice(F.sort_array(c), 1, k + 1)
    salted = sound(vectors).groupBy("v", F.pmod(F.xxhash64("id"), F.lit(64)).alias("salt"), F.floor(F.monotonically_increasing_id() / (1 << 33)).alias("task"))
    distinct = salted.agg(F.slice(F.sort_array(F.collect_list("id")), 1, k + 1).alias("ids")).groupBy("v").agg(few(F.flatten(F.collect_list("ids"))).alias("ids"))
    named = distinct.select(F.monotonically_increasing_id().alias("id"), F.size("v").alias("size"), "v", "ids")
    index = checkpoint(named.mapInArrow(_hashed(trees, bits), "id long, size int, v array<double>, ids array<long>, codes array<long>"))
    asked = sound(queries).groupBy("id").agg(F.min_by("v", F.struct(F.xxhash64("v"), F.col("v"))).alias("v")).select("id", F.size("v").alias("size"), "v")
    asked = checkpoint(asked.mapInArrow(_hashed(trees, bits), "id long, size int, v array<double>, codes array<long>"))
    total, n_asked = index.count(), asked.count()
    fixed = min(bits, max(0, int(np.ceil(np.log2(max(1, total / group))))))  # first bits that name a group
    prefix = lambda code: F.shiftright(code, bits - fixed)
    strings = lambda df, *more: df.select("id", "size", *more, F.posexplode("codes").alias("tree", "code")).withColumn("prefix", prefix(F.col("code")))
    rows = strings(index)
    # groups of very similar vectors are dealt into parts, and their queries go to every part
    sizes = rows.groupBy("size", "tree", "prefix").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 2 * group)
    large = checkpoint(sizes.select("size", "tree", "prefix", F.ceil(F.col("n") / group).cast("int").alias("parts")))
    side = F.broadcast(large) if small_enough(large.count(), BROADCAST_GROUPS) else large
    place = ["size", "tree", "prefix"]
    dealt = rows.join(side, place, "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("id"), F.col("parts")), F.lit(0).cast("long"))).select("id", "code", *place, "part")

    def met(questions: DataFrame, work) -> DataFrame:
        """Lists of index rows that ``work`` finds in the groups of ``questions(query, code, level, size, tree, prefix)``."""
        everywhere = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("parts"), F.lit(1)).cast("long") - 1))
        sent = questions.join(side, place, "left").select("query", "code", "level", *place, everywhere.alias("part"))
        keys = [*place, "part"]
        return dealt.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInArrow(work, _LISTS)

    n_blocks, n_sets = max(1, -(-total // block)), max(1, -(-n_asked // QUERIES))
    team = F.pmod(F.xxhash64("query"), F.lit(n_sets))

    def scores(found: DataFrame, best: int) -> DataFrame:
        """The ``best`` rows of every block and the number scored there, for each query."""
        lists = found.groupBy("query", "block").agg(F.collect_list("ids").alias("ids"))  # at most a list a tree, of a block's rows
        wanted = lists.join(asked.select(F.col("id").alias("query"), "v"), "query").withColumn("team", team)
        stored = index.select("id", "size", "v", F.pmod("id", F.lit(n_blocks).cast("long")).alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_sets - 1).cast("long"))).alias("team"))
        return stored.groupBy("block", "team").cogroup(wanted.groupBy("block", "team")).applyInArrow(_scored(best), "query long, id long, score double, n long")

    questions = strings(asked, F.col("id").alias("query"), F.lit(bits).alias("level")).drop("id")
    # k + 1 vectors hold k others besides the query's own
    first = scores(met(questions, _descended(n_blocks, BESIDE)), k + 1)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k + 1)
    reached = ranked.groupBy("query").agg(F.when(F.count(F.lit(1)) > k, F.min("score")).otherwise(F.lit(-1.0)).alias("c"))
    levels = checkpoint(asked.select(F.col("id").alias("query")).join(reached, "query", "left").select("query", _level(F.coalesce("c", F.lit(-1.0)), trees, bits, miss).alias("level")))
    questions = strings(asked, F.col("id").alias("query")).drop("id").join(levels, "query").where((F.col("level") > 0) | (F.col("tree") == 0))  # every tree holds all rows
    above = F.greatest(F.lit(fixed) - F.col("level"), F.lit(0))  # bits of the group's name that may differ
    under = F.expr("shiftleft(1L, above) - 1")
    questions = questions.withColumn("above", above.cast("int")).withColumn("start", F.expr("shiftleft(shiftright(prefix, above), above)"))
    questions = questions.select("query", "code", "level", "size", "tree", F.explode(F.sequence(F.col("start"), F.col("start") + under)).alias("prefix"))
    found = scores(met(questions, _ascended(n_blocks, bits)), k + 1)
    found = found.withColumn("candidates", F.sum("n").over(Window.partitionBy("query")))
    found = found.join(index.select("id", F.explode("ids").alias("vec_id")), "id").where("vec_id <> query")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    out = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return out.select(F.col("query").alias("query_id"), "rank", "vec_id", "score", "candidates")


def _level(c: Column, trees: int, bits: int, miss: float) -> Column:
    """The longest prefix at which a row of cosine ``c`` is missed by all trees with probability ``miss`` at most."""
    p = 1 - F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c))) / np.pi
    limit = float(np.log(1 - miss ** (1 / trees)))
    level = F.floor(F.lit(limit) / F.log(p)).cast("int")
    return F.when(p >= 1, bits).when(p <= 0, 0).otherwise(F.least(F.lit(bits), F.greatest(F.lit(0), level)))
