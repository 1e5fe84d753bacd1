"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from . import decontaminate, html_density, lm_bloom, lsh_forest, packing, prefix_bpe, quality, simhash, token_histogram, token_table
from .common import checkpoint, own_folder, remove_folder


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage, with the passage and the best overlap."""
    return decontaminate.overlaps(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("text_hash")


def op2_token_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as written to sorted string tables and read back: start, token count and checksum of each."""
    folder = own_folder(spark, "token-table")
    token_table.write_tables(_table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"), end_id=2, manifest=False)
    entries = checkpoint(token_table.read_tables(spark, folder))
    remove_folder(spark, folder)
    return token_table.starts(entries)


def op3_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and model scores of every document; those whose id hashes to 2 modulo 7 are held out of training."""
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2
    return lm_bloom.score_documents(_table(spark, sf_dir, "documents"), held_out)


def op4_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest rows found for every row whose id is divisible by 50."""
    rows = _table(spark, sf_dir, "embeddings")
    return lsh_forest.search(rows, rows.where(F.col("vec_id") % 50 == 0), 5)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals, quantiles and truncated totals at every length that occurs."""
    lengths = token_histogram.length_histogram(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return token_histogram.context_limits(lengths)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in one of 24 shards of near equal bytes; equal texts stay together."""
    placed = packing.shard_documents(_table(spark, sf_dir, "documents"), 24)
    return placed.withColumn("law", F.lit("bytes")).withColumn("grown_shard", F.lit(None).cast("int"))


def op8_html_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html_density.extract(_table(spark, sf_dir, "pages"))


def op9_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded."""
    return prefix_bpe.encode_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's evidence, site shares and posterior, and whether it is kept."""
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_token_table": op2_token_table,
    "op3_lm_scores": op3_lm_scores,
    "op4_forest": op4_forest,
    "op5_token_counts": op5_token_counts,
    "op6_simhash": op6_simhash,
    "op7_sharding": op7_sharding,
    "op8_html_density": op8_html_density,
    "op9_prefix_bpe": op9_prefix_bpe,
    "op10_quality": op10_quality,
}

#: Words are maximal runs of letters and digits. Of 13 aligned words with 2 different ones, a run of 4 is equal; items of fewer words are met word by word.
OP1_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT DISTINCT item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
dp AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
bp AS (SELECT item_id, w AS item, unnest(range(1, len(w) + 1)) AS j FROM b),
hit AS (SELECT DISTINCT doc_id, item_id, w, item, i - j AS shift FROM dp JOIN bp ON w[i] = item[j] AND w[i+1] = item[j+1] AND w[i+2] = item[j+2] AND w[i+3] = item[j+3] WHERE len(item) >= 13
UNION SELECT DISTINCT doc_id, item_id, w, item, i - j AS shift FROM dp JOIN (SELECT * FROM bp WHERE len(item) < 13) AS short ON w[i] = item[j]),
al AS (SELECT doc_id, item_id, shift, least(13, len(item)) AS width, list_transform(range(greatest(1, shift + 1), least(len(w), shift + len(item)) + 1), lambda i: CASE WHEN w[i] = item[i - shift] THEN 1 ELSE 0 END) AS eq, greatest(0, shift) AS f FROM hit),
win AS (SELECT *, list_filter(range(1, len(eq) - width + 2), lambda k: list_sum(eq[k:k + width - 1]) >= width - least(2, width // 5)) AS good FROM al WHERE len(eq) >= width)
SELECT DISTINCT doc_id, item_id, CAST(f + good[1] - 1 AS INT) AS doc_start, CAST(f + good[-1] + width - 1 AS INT) AS doc_end, CAST(f + good[1] - 1 - shift AS INT) AS item_start
FROM win WHERE len(good) > 0
"""

ORACLES: dict[str, str] = {"op1_decontaminate": OP1_SQL}
