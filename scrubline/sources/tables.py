"""Tables and derived inputs: parquet tables, layout JSON, recogniser logs, and e-mail threads made of conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The columns of a recogniser's log.
LOG_SCHEMA = "text string, category string, confidence_score double, offset int, length int"
LAYOUT_SCHEMA = """content string,
 paragraphs array<struct<content: string, role: string, spans: array<struct<offset: int, length: int>>, bounding_regions: array<struct<page_number: int, polygon: array<double>>>>>,
 pages array<struct<page_number: int, width: double, height: double, unit: string,
  lines: array<struct<content: string, polygon: array<double>, spans: array<struct<offset: int, length: int>>>>,
  words: array<struct<content: string, polygon: array<double>, span: struct<offset: int, length: int>>>>>"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def layout(spark: SparkSession, path: str) -> DataFrame:
    """Layout results, one JSON object per file."""
    return spark.read.schema(LAYOUT_SCHEMA).json(path, multiLine=True).withColumn("source", F.input_file_name())


def layout_blocks(results: DataFrame) -> DataFrame:
    """Paragraphs by region: ``source``, ``paragraph_index``, ``text``, ``page`` (from 0, null without a region) and ``polygon``,
    with the page's size or 1 where it is unknown."""
    rows = results.select("source", "pages", F.posexplode("paragraphs").alias("paragraph_index", "p"))
    rows = rows.select("source", "pages", "paragraph_index", F.col("p.content").alias("text"), F.explode_outer("p.bounding_regions").alias("r"))
    own = F.get(F.filter("pages", lambda x: x["page_number"] == F.col("r.page_number")), F.lit(0))
    return rows.select("source", "paragraph_index", "text", (F.col("r.page_number") - 1).alias("page"), F.col("r.polygon").alias("polygon"), F.coalesce(own["width"], F.lit(1.0)).alias("width"), F.coalesce(own["height"], F.lit(1.0)).alias("height"))


def recogniser_log(spark: SparkSession, path: str) -> DataFrame:
    """Entities from recogniser logs (CSV with a header), with the file each came from."""
    return spark.read.csv(path, header=True, schema=LOG_SCHEMA, multiLine=True, escape='"').withColumn("source", F.input_file_name())


def threads(conversations: DataFrame) -> DataFrame:
    """One thread per conversation, in order; every second message quotes the one before it in full.

    ``doc_id`` (the conversation) and ``text``: messages of a ``From:``, ``To:`` and ``Subject:`` line, an empty line and
    the body, joined by line ends."""
    rows = conversations.select("conv_id", "turn", "role", F.regexp_replace("text", r"[\r]", " ").alias("text"))
    turns = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    other = lambda m: F.when(m["role"] == "user", F.lit("assistant")).otherwise(F.lit("user"))

    def message(m, i):
        before = F.get(F.col("m"), i - 1)
        quoted = F.when(i % 2 == 1, F.concat(F.lit("\n"), before["text"])).otherwise(F.lit(""))
        return F.concat(F.lit("From: "), m["role"], F.lit("@example.org\nTo: "), other(m), F.lit("@example.org\nSubject: conv "), F.col("conv_id").cast("string"), F.lit("\n\n"), m["text"], quoted)

    return turns.select(F.col("conv_id").alias("doc_id"), F.array_join(F.transform("m", message), "\n").alias("text"))
