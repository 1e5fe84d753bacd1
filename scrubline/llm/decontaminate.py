"""Benchmark decontamination with spaced seeds, in DataFrame functions only.

A seed is a fixed mask over consecutive tokens; tokens under a zero of the mask are ignored. The two
masks are lossless for the verified overlap: every run of 13 aligned tokens with at most 2
substitutions holds a hit of one of them (all 78 placements are covered; a test enumerates them). Shorter items
have masks of ones, one for each of as many equal parts as one more than the substitutions they allow. So
the join on seed hashes finds every overlap that the verification accepts, and the result does not
depend on the masks.

Token hashes are made in one pass over the text. One code-generated stage then makes a row per token
position and mask and looks its seed up in the benchmark's seeds. The benchmark's places are grouped by their seed and
the seed one token earlier. A hit whose earlier seeds agree as well continues another hit of the same alignment, so
a whole group is passed over by one comparison; only the first hit of every run leaves the stage. Without this, a text of n equal words
would make n * m hits with an item of m of them; with it there are n + m. A first hit is verified on the tokens around
it, or to the end of the alignment where the run is longer than ``RUN``.

The benchmark is broadcast in blocks of items with about ``BROADCAST_TOKENS`` tokens and their seeds, so a seed that many items
share is spread over blocks; a larger benchmark takes more passes over the documents, never a larger broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, text_of

#: Tokens of a verified overlap and how many of them may differ (at least 0.8 are equal).
WINDOW, SUBSTITUTIONS = 13, 2
#: Ones are compared, zeros ignored.
MASKS = ("11010111", "101100001011")
#: Tokens of the items in a broadcast, places of a seed in one row, and equal tokens from which a run is followed to its end.
BROADCAST_TOKENS, PLACES, RUN = 250_000, 1024, 32


def allowed(width: int) -> int:
    """How many of ``width`` tokens may differ: a fifth, and at most ``SUBSTITUTIONS``."""
    return min(SUBSTITUTIONS, width // 5)


def parts_of(size: int) -> list[tuple[int, int]]:
    """Start and length of the equal parts of an item shorter than ``WINDOW``, one of which is unchanged in every accepted overlap."""
    n = allowed(size) + 1
    cuts = [size * k // n for k in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def token_hashes(text: Column) -> Column:
    """64-bit hashes of the lower-cased runs of letters and digits."""
    words = F.split(F.lower(text), r"[^\p{L}\p{N}]+")
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


def _seed(at: Column, mask: str, k: int) -> Column:
    """The hash of the tokens under a mask that begins at ``at``; null if they aren't all there."""
    picked = [F.get(F.col("tokens"), at + i) for i, bit in enumerate(mask) if bit == "1"]
    return F.when((at >= 0) & (at + len(mask) <= F.size("tokens")), F.xxhash64(F.lit(k), *picked))


def _item_seeds(items: DataFrame, masks: list[str]) -> DataFrame:
    """``mask``, ``seed``, ``before`` (the seed one token earlier) and ``places`` (item and position) of the items' seeds."""
    whole = F.when(F.size("tokens") >= WINDOW, F.sequence(F.lit(0), F.size("tokens") - 1))
    rows = items.select("block", "item", "tokens", F.explode(whole).alias("at"))
    spaced = [F.struct(F.lit(k).alias("mask"), _seed(F.col("at"), m, k).alias("seed"), _seed(F.col("at") - 1, m, k).alias("before")) for k, m in enumerate(MASKS)]
    found = rows.select("block", "item", "at", F.explode(F.array(*spaced)).alias("s")).select("block", "item", "at", "s.*")
    for size in range(1, WINDOW):
        for at, length in parts_of(size):
            if "1" * length not in masks:
                continue
            k = masks.index("1" * length)
            short = items.where(F.size("tokens") == size).select("block", "item", F.lit(at).alias("at"), F.lit(k).alias("mask"), _seed(F.lit(at), masks[k], k).alias("seed"), F.lit(None).cast("long").alias("before"))
            found = found.unionByName(short)
    found = found.where("seed is not null").withColumn("part", F.pmod(F.xxhash64("item", "at"), F.lit(1 << 20)))
    sizes = found.groupBy("block", "mask", "seed", "before").agg((F.floor(F.count(F.lit(1)) / PLACES) + 1).alias("parts"))
    f, z = found.alias("f"), sizes.alias("z")
    key = ("block", "mask", "seed", "before")
    same = [F.col(f"f.{c}").eqNullSafe(F.col(f"z.{c}")) for c in key]
    dealt = f.join(z, same[0] & same[1] & same[2] & same[3]).select(*(F.col(f"f.{c}") for c in key), F.pmod("part", "parts").alias("part"), F.struct("item", "at").alias("place"))
    return dealt.groupBy("block", "mask", "seed", "before", "part").agg(F.collect_list("place").alias("places")).drop("part")


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block: int = BROADCAST_TOKENS) -> DataFrame:
    """Documents that hold a benchmark passage, with the place of the overlap.

    Columns: ``doc_id``, ``text_hash`` (xxhash64 of the text; with the id it names the row), ``item_id``,
    ``doc_start`` and ``doc_end`` (token positions from the first accepted window to the end of the last)
    and ``item_start`` (of the first). One row per document, item and alignment that has ``WINDOW`` aligned
    tokens of which at most ``SUBSTITUTIONS`` differ. An item with fewer tokens is one window, of which at most a fifth
    may differ. Null and empty texts or items overlap with nothing; repeated rows give one row; a null id
    is kept. Names of the input columns are parameters. ``block`` is the number of item tokens in a broadcast.
    """
    items = benchmark.select(F.col(item_col).alias("item_id"), token_hashes(text_of(item_text)).alias("tokens")).where(F.size("tokens") > 0).distinct()
    items = checkpoint(items.withColumn("item", F.monotonically_increasing_id()))
    total = items.agg(F.sum(F.size("tokens"))).first()[0] or 0
    blocks = max(1, -(-total // block))
    items = items.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)))
    sizes = [r[0] for r in items.where(F.size("tokens") < WINDOW).select(F.size("tokens")).distinct().collect()]  # at most WINDOW - 1
    masks = [*MASKS, *("1" * n for n in sorted({n for size in sizes for _, n in parts_of(size)}))]
    seeds = checkpoint(_item_seeds(items, masks))
    texts = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    texts = texts.select("doc_id", F.xxhash64("text").alias("text_hash"), token_hashes(F.col("text")).alias("tokens"))
    places = F.when(F.size("tokens") > 0, F.sequence(F.lit(0), F.size("tokens") - 1))
    rows = texts.select("doc_id", "text_hash", "tokens", F.explode(places).alias("at"))
    found = None
    each = [F.struct(F.lit(k).alias("mask"), _seed(F.col("at"), m, k).alias("seed")) for k, m in enumerate(masks)]
    rows = rows.select("doc_id", "text_hash", "tokens", "at", F.explode(F.array(*each)).alias("s")).where("s.seed is not null").select("doc_id", "text_hash", "tokens", "at", F.col("s.mask").alias("mask"), F.col("s.seed").alias("seed"))
    # the seed one token earlier, looked at only where a seed is found; parts of short items have no runs
    earlier = F.when(F.col("mask") == 0, _seed(F.col("at") - 1, MASKS[0], 0)).when(F.col("mask") == 1, _seed(F.col("at") - 1, MASKS[1], 1)).otherwise(F.lit(0).cast("long"))
    starts = lambda before: before.isNull() | earlier.isNull() | (before != earlier)
    for k in range(blocks):
        own = seeds.where(F.col("block") == k).select(F.col("mask").alias("i_mask"), F.col("seed").alias("i_seed"), F.col("before"), "places")
        met = rows.join(F.broadcast(own), (F.col("mask") == F.col("i_mask")) & (F.col("seed") == F.col("i_seed")) & starts(F.col("before")))
        met = met.select("doc_id", "text_hash", "tokens", "at", F.explode("places").alias("p")).select("doc_id", "text_hash", "tokens", "at", F.col("p.item").alias("item"), F.col("p.at").alias("item_at"))
        passages = items.where(F.col("block") == k).select("item", "item_id", F.col("tokens").alias("passage"))
        hits = _verified(met.join(F.broadcast(passages), "item"))
        found = hits if found is None else found.unionAll(hits)
    out = found.groupBy("doc_id", "text_hash", "item_id", "shift").agg(F.min("low").alias("doc_start"), F.max("high").alias("doc_end"))
    return out.select("doc_id", "text_hash", "item_id", "doc_start", "doc_end", (F.col("doc_start") - F.col("shift")).alias("item_start"))


def _verified(hits: DataFrame) -> DataFrame:
    """Hits in an accepted window: ``low`` and ``high``, where the accepted windows at or after a run's first hit begin and end."""
    shift = F.col("at") - F.col("item_at")
    start = F.greatest(F.lit(0), shift, F.col("at") - (WINDOW - 1))
    end = F.least(F.size("tokens"), F.size("passage") + shift)
    # every token of a run is equal, so a run that is no longer than RUN ends within the tokens looked at
    going = F.slice("tokens", F.col("at") + 1, RUN) == F.slice("passage", F.col("item_at") + 1, RUN)
    size = F.when(going, end).otherwise(F.least(end, F.col("at") + RUN + 2 * WINDOW)) - start
    width, skip = F.least(F.lit(WINDOW), F.size("passage")), start - shift
    # the aligned tokens are cut by a generator, which keeps the lambdas below out of the code-generated stage
    both = F.struct(F.slice("tokens", start + 1, size).alias("a"), F.slice("passage", skip + 1, size).alias("b"))
    cut = hits.select("doc_id", "text_hash", "item_id", shift.alias("shift"), start.alias("start"), width.alias("width"), F.explode(F.array(both)).alias("part"))
    # differing tokens up to each place; a window's are the difference of two of these sums
    places = F.filter(F.transform(F.arrays_zip("part.a", "part.b"), lambda t, i: F.when(t["a"] != t["b"], i)), lambda i: i.isNotNull())
    wrong = F.when(F.col("part.a") == F.col("part.b"), F.array().cast("array<int>")).otherwise(places)
    few = F.least(F.lit(SUBSTITUTIONS), F.floor(F.col("width") / 5).cast("int"))
    counted = cut.select("doc_id", "text_hash", "item_id", "shift", "start", "width", few.alias("few"), F.size("part.a").alias("size"), wrong.alias("wrong")).where(F.col("size") >= F.col("width"))
    # between one differing token and the one after the allowed number of further ones lies a stretch whose windows are all accepted
    bounds = F.concat(F.array(F.lit(-1)), F.col("wrong"), F.array(F.col("size")))
    last = F.size("bounds") - 1
    stretches = F.transform(
        F.sequence(F.lit(0), F.greatest(F.lit(0), last - F.col("few") - 1)),
        lambda i: F.struct((F.get("bounds", i) + 1).alias("from"), F.get("bounds", F.least(last, i + F.col("few") + 1)).alias("to")),
    )
    good = F.filter(stretches, lambda s: s["to"] - s["from"] >= F.col("width"))
    out = counted.withColumn("bounds", bounds).withColumn("good", good).where(F.size("good") > 0)
    at = lambda x: F.col("start") + x
    return out.select("doc_id", "text_hash", "item_id", "shift", at(F.element_at("good", 1)["from"]).alias("low"), at(F.element_at("good", -1)["to"]).alias("high"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` without the rows that hold a benchmark passage (see :func:`overlaps`); all columns stay.

    An empty benchmark or no overlap leaves every row. The anti-join's right side has one row per
    contaminated document; Spark broadcasts it only when its size in bytes is under the session's limit.
    """
    bad = overlaps(docs, benchmark, id_col, text_col, item_col, item_text).select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct()
    same = docs[id_col].eqNullSafe(bad["__id"]) & (F.xxhash64(F.coalesce(docs[text_col].cast("string"), F.lit(""))) == bad["__hash"])
    return docs.join(bad, same, "left_anti")
