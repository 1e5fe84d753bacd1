"""Removing bands of lines and closing the gaps."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PAD, LEAST_HEIGHT = 1.5, 0.5
#: Lines that start a header band.
HEADER_LINES = r"(?i)^(?:From:|To:|Subject:|Date:)"


def reflow(lines: DataFrame, rects: DataFrame) -> DataFrame:
    """Lines left after one band per page is cut out: those it touches (within ``PAD``) go, those below move up by the
    removed height, or by the band's own where that is under ``LEAST_HEIGHT``. ``lines(doc_id, page, line_idx, y0, y1)``,
    ``rects(doc_id, page, top, bottom)`` with one row per page."""
    rows = lines.join(rects, ["doc_id", "page"], "left")
    rows = rows.withColumn("hit", F.coalesce(~((F.col("y1") < F.col("top") - PAD) | (F.col("y0") > F.col("bottom") + PAD)), F.lit(False)))
    cut = rows.where("hit").groupBy("doc_id", "page").agg((F.max("y1") - F.min("y0")).alias("h"), F.min("y0").alias("first"), F.first("bottom").alias("b"), F.first("top").alias("t"))
    cut = cut.select("doc_id", "page", "first", F.when(F.col("h") < LEAST_HEIGHT, F.col("b") - F.col("t")).otherwise(F.col("h")).alias("h"))
    left = rows.where("not hit").join(cut, ["doc_id", "page"], "left")
    shift = F.when(F.col("y0") > F.col("first"), F.col("h")).otherwise(F.lit(0.0))
    return left.select("doc_id", "page", "line_idx", (F.col("y0") - shift).alias("y0"), (F.col("y1") - shift).alias("y1"))


def reflow_all(lines: DataFrame, rects: DataFrame, rebase: bool = False) -> DataFrame:
    """As :func:`reflow` for any number of bands per page, one after the other from the top. With ``rebase`` later bands
    move up with the lines; without, they stay where they were given."""

    def page(key, own: pd.DataFrame, bands: pd.DataFrame) -> pd.DataFrame:
        y0, y1, keep = own["y0"].to_numpy().copy(), own["y1"].to_numpy().copy(), own["y0"].notna().to_numpy()
        moved = 0.0
        for r in bands.sort_values(["top", "bottom"]).itertuples():
            top, bottom = (r.top - moved, r.bottom - moved) if rebase else (r.top, r.bottom)
            hit = keep & ~((y1 < top - PAD) | (y0 > bottom + PAD))
            if hit.any():
                first, height = y0[hit].min(), y1[hit].max() - y0[hit].min()
                height = bottom - top if height < LEAST_HEIGHT else height
                keep &= ~hit
                below = keep & (y0 > first)
                y0[below] -= height
                y1[below] -= height
                moved += height
        return own.assign(y0=y0, y1=y1)[keep][["doc_id", "page", "line_idx", "y0", "y1"]]

    rows = lines.select("doc_id", "page", "line_idx", "y0", "y1")
    return rows.groupBy("doc_id", "page").cogroup(rects.groupBy("doc_id", "page")).applyInPandas(page, rows.schema)


def header_bands(lines: DataFrame) -> DataFrame:
    """Runs of consecutive header lines: ``doc_id``, ``page``, ``first_line``, ``last_line``, ``top`` and ``bottom``, which
    reaches to the next line's top. ``lines(doc_id, page, line_idx, line, y0, y1)``."""
    order = Window.partitionBy("doc_id", "page").orderBy("line_idx")
    rows = lines.withColumn("next_top", F.lead("y0").over(order)).where(F.trim("line").rlike(HEADER_LINES))
    rows = rows.withColumn("run", F.col("line_idx") - F.row_number().over(order))
    bands = rows.groupBy("doc_id", "page", "run").agg(F.min("line_idx").alias("first_line"), F.max("line_idx").alias("last_line"), F.min("y0").alias("top"), F.max("y1").alias("bottom"), F.max("next_top").alias("next_top"))
    return bands.select("doc_id", "page", "first_line", "last_line", "top", F.greatest("bottom", "next_top").alias("bottom"))


def collapse(lines: DataFrame, bands: DataFrame) -> DataFrame:
    """Lines outside the bands, moved up by the heights of all bands above them on the page."""
    order = Window.partitionBy("doc_id", "page").orderBy("y", "kind").rowsBetween(Window.unboundedPreceding, 0)
    kept = lines.alias("l").join(bands.alias("b"), (F.col("l.doc_id") == F.col("b.doc_id")) & (F.col("l.page") == F.col("b.page")) & F.col("l.line_idx").between(F.col("b.first_line"), F.col("b.last_line")), "left_anti")
    both = kept.select("doc_id", "page", F.col("line_idx"), F.col("y0").alias("y"), F.col("y1"), F.lit(0.0).alias("removed"), F.lit(1).alias("kind")).unionAll(bands.select("doc_id", "page", F.lit(None).cast("int"), F.col("top"), F.lit(None).cast("double"), F.col("bottom") - F.col("top"), F.lit(0)))
    shifted = both.withColumn("shift", F.sum("removed").over(order)).where("kind = 1")
    return shifted.select("doc_id", "page", "line_idx", (F.col("y") - F.col("shift")).alias("y0"), (F.col("y1") - F.col("shift")).alias("y1"))
