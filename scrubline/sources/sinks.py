"""Outputs: entity logs, result files and annotation tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def append_log(entities: DataFrame, path: str) -> None:
    """Append entities to a CSV log with headers."""
    entities.select("text", "category", "confidence_score", "offset", "length").write.csv(path, header=True, mode="append", escape='"')


def write_result(result: DataFrame, path: str) -> None:
    """Write a result as JSON lines."""
    result.write.json(path, mode="overwrite")


def annotations(boxes: DataFrame, pages: DataFrame) -> DataFrame:
    """Labelled absolute rectangles of duplicates: ``boxes(doc_id, page, kind, number, similarity, rx0, ry0, rx1, ry1)`` relative
    to ``pages(doc_id, page, width, height)``; boxes on pages that don't exist are skipped."""
    label = F.when(F.col("kind") == "exact", F.format_string("EXACT #%d", "number")).otherwise(F.format_string("NEAR #%d sim=%.3f", "number", "similarity"))
    rows = boxes.join(pages, ["doc_id", "page"])
    return rows.select("doc_id", "page", label.alias("label"), (F.col("rx0") * F.col("width")).alias("x0"), (F.col("ry0") * F.col("height")).alias("y0"), (F.col("rx1") * F.col("width")).alias("x1"), (F.col("ry1") * F.col("height")).alias("y1"))
