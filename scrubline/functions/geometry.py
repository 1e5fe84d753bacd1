"""Boxes, unit scaling, fonts and colours as column expressions. Rectangles are x0, y0, x1, y1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The base fonts a page may keep.
BASE_FONTS = ("Courier", "Courier-Bold", "Courier-BoldOblique", "Courier-Oblique", "Helvetica", "Helvetica-Bold", "Helvetica-BoldOblique", "Helvetica-Oblique", "Symbol", "Times-Bold", "Times-BoldItalic", "Times-Italic", "Times-Roman", "ZapfDingbats")
POINTS_PER_INCH, DPI, CANVAS = 72.0, 150.0, 800.0


def polygon_bounds(polygon: Column) -> tuple[Column, Column, Column, Column]:
    """Bounds of a flat polygon x1, y1, x2, y2, ...; zeros where there are no points."""
    xs, ys = F.filter(polygon, lambda _, i: i % 2 == 0), F.filter(polygon, lambda _, i: i % 2 == 1)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return zero(F.array_min(xs)), zero(F.array_min(ys)), zero(F.array_max(xs)), zero(F.array_max(ys))


def extent(low: Column, high: Column) -> Column:
    """A side's length, not below zero."""
    return F.greatest(F.lit(0.0), high - low)


def relative(value: Column, side: Column) -> Column:
    """A coordinate as a share of the page's side; zero on a page without size."""
    return F.when(side > 0, value / side).otherwise(F.lit(0.0))


def inches_to_points(value: Column) -> Column:
    return value * POINTS_PER_INCH


def canvas_to_points(value: Column, image_width: Column) -> Column:
    """Preview pixels (scaled to the canvas) to page points."""
    return value * (POINTS_PER_INCH / DPI) * (image_width / CANVAS)


def is_valid(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Whether a rectangle is finite and has an area."""
    finite = F.lit(True)
    for c in (x0, y0, x1, y1):
        finite = finite & c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return F.coalesce(finite & (x0 < x1) & (y0 < y1), F.lit(False))


def base_font(name: Column, mode: Column) -> Column:
    """The font to write with: base fonts stay unless the mode forces one, others become Helvetica."""
    return F.when((mode != "helvetica") & name.isin(*BASE_FONTS), name).otherwise(F.lit("Helvetica"))


def rgb(color: Column) -> Column:
    """A packed colour as red, green and blue."""
    part = lambda shift: F.shiftright(color, shift).bitwiseAND(F.lit(255))
    return F.array(part(16), part(8), part(0))
