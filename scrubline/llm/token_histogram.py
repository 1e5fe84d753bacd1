"""Exact token-length histogram, and what every context limit would keep.

Each document is encoded once and only its length goes on. Lengths are counted (with map-side partial
counts) and suffix sums over the distinct lengths answer totals, quantiles and truncated totals for any
limit. The suffix sums run in two steps, over buckets of ``STEP`` lengths and within each bucket, so no
task sorts more than a bucket or the list of buckets.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .cached_encoder import encoder
from .common import checkpoint, text_of

STEP = 128


def length_column(text: Column, tokenizer: str) -> Column:
    """The encoded length of a text column; null counts as empty."""

    @F.arrow_udf("long")
    def udf(texts: pa.Array) -> pa.Array:
        tool = encoder(tokenizer)
        return pa.array([len(tool.encode(t.as_py() or "")) >> 2 for t in texts], pa.int64())

    return udf(text)


def length_histogram(docs: DataFrame, tokenizer: str, text_col: str = "text") -> DataFrame:
    """``(n_tokens, n_docs)`` for each encoded length of whole texts; null and empty texts have length 0."""
    return docs.select(length_column(text_of(text_col), tokenizer).alias("n_tokens")).groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))


def context_limits(histogram: DataFrame) -> DataFrame:
    """For each length that occurs, taken as a context limit:

    ``context_limit``, ``n_docs`` (documents of exactly that length), ``docs_within``, ``docs_over`` (longer
    ones), ``tokens_within`` (tokens of the documents within), ``truncated_tokens`` (all tokens left if every
    document is cut at the limit), ``total_docs``, ``total_tokens`` and ``quantile`` (share of documents within).
    Between two such limits L < M, a limit x keeps the L row's documents within and its truncated tokens plus
    ``(x - L) * docs_over``. An empty histogram gives no rows.
    """
    rows = checkpoint(histogram.withColumn("tokens", F.col("n_tokens") * F.col("n_docs")).withColumn("bucket", F.floor(F.col("n_tokens") / STEP)))
    buckets = rows.groupBy("bucket").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    above = Window.orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)  # longest text / STEP rows
    whole = Window.orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    buckets = buckets.select("bucket", F.coalesce(F.sum("d").over(above), F.lit(0)).alias("d_above"), F.coalesce(F.sum("t").over(above), F.lit(0)).alias("t_above"), F.sum("d").over(whole).alias("total_docs"), F.sum("t").over(whole).alias("total_tokens"))
    longer = Window.partitionBy("bucket").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumn("d_in", F.coalesce(F.sum("n_docs").over(longer), F.lit(0))).withColumn("t_in", F.coalesce(F.sum("tokens").over(longer), F.lit(0))).join(buckets, "bucket")
    over, over_tokens = F.col("d_above") + F.col("d_in"), F.col("t_above") + F.col("t_in")
    return out.select(
        F.col("n_tokens").alias("context_limit"), "n_docs", (F.col("total_docs") - over).alias("docs_within"), over.alias("docs_over"),
        (F.col("total_tokens") - over_tokens).alias("tokens_within"), (F.col("total_tokens") - over_tokens + F.col("n_tokens") * over).alias("truncated_tokens"),
        "total_docs", "total_tokens", ((F.col("total_docs") - over) / F.col("total_docs")).alias("quantile"),
    )
