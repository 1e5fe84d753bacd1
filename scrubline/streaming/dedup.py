"""Incremental exact deduplication of a stream of texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_text


def first_texts(stream: DataFrame, time_col: str = "ts", text_col: str = "text", delay: str = "10 minutes") -> DataFrame:
    """Rows of a stream whose normalised text did not occur within the watermark; state older than ``delay`` is dropped."""
    hashed = stream.withColumn("hash", F.sha2(normalize_text(F.col(text_col)), 256))
    return hashed.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(["hash"])
