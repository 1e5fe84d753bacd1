"""Lines, paragraphs and their neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LEAST = 50


def lines(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``line_idx`` (from 0), ``line`` and ``offset`` of the line in the text."""
    rows = docs.select("doc_id", F.split(F.coalesce("text", F.lit("")), "\n").alias("l"))
    ends = F.aggregate("l", F.array(F.lit(0)), lambda a, x: F.array_append(a, F.element_at(a, -1) + F.length(x) + 1))
    one = rows.where(F.size("l") <= 256).select("doc_id", F.arrays_zip("l", F.slice(ends, 1, F.size("l")).alias("o")).alias("z"))
    short = one.select("doc_id", F.posexplode("z").alias("line_idx", "z")).select("doc_id", "line_idx", F.col("z.l").alias("line"), F.col("z.o").alias("offset"))
    # a long document's running sum is a window's work; the array above would be copied for each line
    before = Window.partitionBy("doc_id", "h").orderBy("line_idx").rowsBetween(Window.unboundedPreceding, -1)
    many = rows.where(F.size("l") > 256).select("doc_id", F.xxhash64("l").alias("h"), F.posexplode("l").alias("line_idx", "line"))
    long = many.select("doc_id", "line_idx", "line", F.coalesce(F.sum(F.length("line") + 1).over(before), F.lit(0)).cast("int").alias("offset"))
    return short.unionAll(long)


def merge_small(paragraphs: DataFrame, least: int = LEAST) -> DataFrame:
    """Paragraphs shorter than ``least`` characters join the chunk before them; the first stays alone at the start.

    ``paragraphs(doc_id, line_idx, line)`` to ``doc_id``, ``chunk_idx``, ``text`` (lines joined by line ends)
    and ``n_lines``."""
    order = Window.partitionBy("doc_id").orderBy("line_idx")
    opens = (F.length("line") >= least) | (F.row_number().over(order) == 1)
    numbered = paragraphs.withColumn("opens", opens.cast("int")).withColumn("chunk_idx", F.sum("opens").over(order) - 1)
    joined = numbered.groupBy("doc_id", "chunk_idx").agg(F.array_sort(F.collect_list(F.struct("line_idx", "line"))).alias("s"))
    return joined.select("doc_id", "chunk_idx", F.array_join("s.line", "\n").alias("text"), F.size("s").alias("n_lines"))


def context(chunks: DataFrame) -> DataFrame:
    """Each chunk with the text before and after it in its document, empty at the ends."""
    order = Window.partitionBy("doc_id").orderBy("chunk_idx")
    return chunks.select("*", F.lag("text", 1, "").over(order).alias("previous"), F.lead("text", 1, "").over(order).alias("next"))


def body_text(paragraphs: DataFrame) -> DataFrame:
    """``doc_id`` and ``body``: paragraphs that are no page header, page footer or footnote, joined by line ends; the
    document's whole text where none is left. Needs ``role`` beside the columns of :func:`lines`."""
    kept = F.coalesce(~F.lower("role").isin("pageheader", "pagefooter", "footnote"), F.lit(True))
    parts = paragraphs.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line_idx", "line", kept.alias("kept")))).alias("s"))
    own = F.filter("s", lambda x: x["kept"])
    chosen = F.when(F.size(own) > 0, own).otherwise(F.col("s"))
    return parts.select("doc_id", F.array_join(F.transform(chosen, lambda x: x["line"]), "\n").alias("body"))
