"""Text spans on page geometry: words under spans, boxes, merged rectangles, located findings."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import NEEDLE_MARKS, QUOTE_MARKS

LEAST_SCORE, GAP = 90, 0.75
#: The fixed-pitch layout that stands in for extracted geometry: points per column and line, and lines per page.
COLUMN, LINE, HEIGHT, PAGE_LINES = 6.0, 12.0, 10.0, 60


def words(lines: DataFrame) -> DataFrame:
    """Words of ``lines(doc_id, line_idx, line, offset)`` laid out at fixed pitch: ``page``, ``word_idx`` in the line,
    ``word``, ``offset`` in the text and the rectangle in points."""
    pieces = F.split("line", " ")
    rows = lines.select("doc_id", "line_idx", "line", F.col("offset").alias("line_offset"), F.posexplode(pieces).alias("word_idx", "word"))
    before = Window.partitionBy("doc_id", "line_idx").orderBy("word_idx").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("column", F.coalesce(F.sum(F.length("word") + 1).over(before), F.lit(0)).cast("int")).where("word <> ''")
    top = (F.col("line_idx") % PAGE_LINES) * LINE
    return rows.select(
        "doc_id", F.floor(F.col("line_idx") / PAGE_LINES).cast("int").alias("page"), "line_idx", "word_idx", "word", (F.col("line_offset") + F.col("column")).alias("offset"),
        (F.col("column") * COLUMN).alias("x0"), top.alias("y0"), ((F.col("column") + F.length("word")) * COLUMN).alias("x1"), (top + HEIGHT).alias("y1"),
    )


def span_words(words: DataFrame, spans: DataFrame) -> DataFrame:
    """Words that overlap a span of the same document: ``spans(doc_id, span_id, offset, length)``. The range join runs
    inside the equality on the document."""
    s = spans.select("doc_id", "span_id", F.col("offset").alias("low"), (F.col("offset") + F.col("length")).alias("high"))
    return words.join(s, "doc_id").where((F.col("offset") < F.col("high")) & (F.col("offset") + F.length("word") > F.col("low"))).drop("low", "high")


def boxes(found: DataFrame, keys: list[str]) -> DataFrame:
    """The union box of the rectangles of each group, with their number."""
    return found.groupBy(*keys).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.count(F.lit(1)).alias("n_words"))


def merge_rectangles(rects: DataFrame, keys: list[str]) -> DataFrame:
    """Neighbours on a line become one: lines are tops rounded half to even; a run breaks where the gap to the rectangle
    just before is over ``GAP`` of its height."""
    order = Window.partitionBy(*keys, "bucket").orderBy("x0", "x1", "y0", "y1")
    rows = rects.withColumn("bucket", F.bround("y0", 0))
    gap = F.col("x0") - F.lag("x1").over(order)
    rows = rows.withColumn("breaks", (F.coalesce(gap > GAP * (F.lag("y1").over(order) - F.lag("y0").over(order)), F.lit(False))).cast("int"))
    rows = rows.withColumn("run", F.sum("breaks").over(order))
    return boxes(rows, [*keys, "bucket", "run"]).drop("bucket", "run")


def intersecting(rects: DataFrame, bands: DataFrame, keys: list[str], slack: float = 0.5) -> DataFrame:
    """``rects`` that overlap one of ``bands(keys, left, top, right, bottom)`` on both axes by more than ``slack``."""
    both = rects.join(bands, keys)
    return both.where((F.col("x0") < F.col("right") - slack) & (F.col("x1") > F.col("left") + slack) & (F.col("y0") < F.col("bottom") - slack) & (F.col("y1") > F.col("top") + slack)).select(*rects.columns)


def line_rectangles(words: DataFrame, least_height: float = 2.0) -> DataFrame:
    """Lines of words with their text and union rectangle; blank and flat ones are left out."""
    parts = words.groupBy("doc_id", "page", "line_idx").agg(F.array_sort(F.collect_list(F.struct("word_idx", "word"))).alias("w"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    rows = parts.select("doc_id", "page", "line_idx", F.array_join("w.word", " ").alias("line"), "x0", "y0", "x1", "y1")
    return rows.where((F.trim("line") != "") & (F.col("y1") - F.col("y0") >= least_height))


def next_gap(rects: DataFrame) -> DataFrame:
    """Each rectangle's distance to the next one below it on the page, null for the last."""
    order = Window.partitionBy("doc_id", "page").orderBy("y0")
    return rects.withColumn("gap", F.lead("y0").over(order) - F.col("y1"))


def _key(text: str, marks: Iterable[str]) -> str:
    text = text.lower()
    for mark in marks:
        text = text.replace(mark, "")
    return text


def similarity(a: str, b: str) -> int:
    """0 to 100: twice the longest common subsequence over both lengths, rounded half to even."""
    if not a or not b:
        return 0
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    row = full = (1 << len(a)) - 1
    for c in b:
        same = row & masks.get(c, 0)
        row = (row + same | row - same) & full
    return round(200 * (len(a) - row.bit_count()) / (len(a) + len(b)))


def best_window(needle: str, keys: list[str], used: list[bool], least: int = LEAST_SCORE) -> tuple[int, int, int] | None:
    """The window of unused neighbouring words that is most like the needle, as score, first and last word. The first of
    equal ones wins; windows whose length rules the score out are not compared."""
    best, size = (least - 1, 0, 0), len(needle)
    for i in range(len(keys)):
        joined = ""
        for j in range(i, len(keys)):
            if used[j]:
                break
            joined += keys[j]
            if 200 * min(size, len(joined)) < (best[0] - 0.5) * (size + len(joined)):
                if len(joined) > size:
                    break
                continue
            score = similarity(needle, joined)
            if score > best[0]:
                best = (score, i, j)
                if score == 100:
                    return best
    return best if best[0] >= least else None


def locate(words: DataFrame, findings: DataFrame) -> DataFrame:
    """Place findings on their page: ``words`` as from :func:`words`, ``findings(doc_id, page, finding_id, text)``.

    Longer findings choose first, and a word is used once. Columns: ``doc_id``, ``page``, ``finding_id``,
    ``score``, ``first_word``, ``last_word`` (positions on the page) and the union rectangle. Pages are
    independent, so each is one group of bounded size.
    """

    def page(key, found: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["line_idx", "word_idx"]).reset_index(drop=True)
        keys, used, rows = [_key(w, NEEDLE_MARKS + QUOTE_MARKS) for w in own["word"]], [False] * len(own), []
        found = found.sort_values("finding_id")
        for r in sorted(found.itertuples(), key=lambda r: -len(r.text)):
            best = best_window(_key(r.text, NEEDLE_MARKS), keys, used)
            if best:
                score, i, j = best
                used[i : j + 1] = [True] * (j + 1 - i)
                w = own.iloc[i : j + 1]
                rows.append((key[0], key[1], r.finding_id, score, i, j, w["x0"].min(), w["y0"].min(), w["x1"].max(), w["y1"].max()))
        return pd.DataFrame(rows, columns=["doc_id", "page", "finding_id", "score", "first_word", "last_word", "x0", "y0", "x1", "y1"])

    shape = "doc_id long, page int, finding_id long, score int, first_word int, last_word int, x0 double, y0 double, x1 double, y1 double"
    return findings.groupBy("doc_id", "page").cogroup(words.groupBy("doc_id", "page")).applyInPandas(page, shape)
