"""Review of suggestions: grouping, approval, spreading one redaction to all occurrences, undo, and areas to apply."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import occurrence_key


def grouped(suggestions: DataFrame, approvals: DataFrame) -> DataFrame:
    """By text: number of instances, the least category, whether all are approved. ``approvals(id, approved)``."""
    rows = suggestions.join(approvals, "id", "left").withColumn("approved", F.coalesce("approved", F.lit(False)))
    return rows.groupBy("text").agg(F.count(F.lit(1)).alias("n_instances"), F.min("category").alias("category"), F.every("approved").alias("all_approved"))


def areas(suggestions: DataFrame, approvals: DataFrame, others: list[DataFrame]) -> DataFrame:
    """Rectangles to apply, by page: approved suggestions and all others (duplicate e-mails, hand-drawn), each once, in order.
    All inputs have ``doc_id, page, x0, y0, x1, y1``; suggestions have ``id`` too."""
    columns = ["doc_id", "page", "x0", "y0", "x1", "y1"]
    rows = suggestions.join(approvals.where("approved"), "id", "left_semi").select(*columns)
    for o in others:
        rows = rows.unionByName(o.select(*columns))
    return rows.groupBy("doc_id", "page").agg(F.array_sort(F.collect_set(F.struct("y0", "x0", "y1", "x1"))).alias("rects"))


def applied(areas: DataFrame, pages: DataFrame) -> DataFrame:
    """Areas with ``is_applied``: whether their page is one of their document's ``pages(doc_id, n_pages)``, counted from 0. Those of
    other pages, of unknown documents and without a page are skipped by whoever draws them."""
    inside = F.col("page").between(F.lit(0), F.col("n_pages") - 1)
    return areas.join(pages, "doc_id", "left").withColumn("is_applied", F.coalesce(inside, F.lit(False))).drop("n_pages")


def occurrences(words: DataFrame, needles: DataFrame) -> DataFrame:
    """Every word that equals a needle: ``id`` (``promo_text_page_line_word``), each once. ``needles(doc_id, text)``;
    only the words lose their closing marks, so a needle of several words finds nothing."""
    keyed = words.withColumn("key", occurrence_key(F.col("word")))
    asked = needles.select("doc_id", F.lower("text").alias("key")).distinct()
    found = keyed.join(asked, ["doc_id", "key"])
    name = F.concat_ws("_", F.lit("promo"), "key", "page", "line_idx", "word_idx")
    return found.select("doc_id", name.alias("id"), "page", "line_idx", "word_idx", "word").dropDuplicates(["doc_id", "id"])


def undo(suggestions: DataFrame, promoted: DataFrame) -> DataFrame:
    """Suggestions without the promoted ids."""
    return suggestions.join(promoted.select("doc_id", "id"), ["doc_id", "id"], "left_anti")
