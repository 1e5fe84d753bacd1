"""Row profiles of grey page images and safe places to cut them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

WHITE, RUN = 245.0, 3


def row_profile(rows: DataFrame) -> DataFrame:
    """``image_id``, ``row``, ``mean`` and ``is_white`` from ``rows(image_id, row, pixels array<int>)``."""
    mean = F.aggregate("pixels", F.lit(0.0), lambda a, x: a + x) / F.greatest(F.size("pixels"), F.lit(1))
    return rows.select("image_id", "row", mean.alias("mean"), (mean >= WHITE).alias("is_white"))


def content_extent(profile: DataFrame) -> DataFrame:
    """The first and last row that is not white."""
    return profile.where("not is_white").groupBy("image_id").agg(F.min("row").alias("first_row"), F.max("row").alias("last_row"))


def white_cuts(profile: DataFrame, targets: DataFrame) -> DataFrame:
    """For each ``targets(image_id, target)`` the middle of the nearest run of at least ``RUN`` white rows; ties upward."""
    order = Window.partitionBy("image_id").orderBy("row")
    runs = profile.where("is_white").withColumn("g", F.col("row") - F.row_number().over(order))
    runs = runs.groupBy("image_id", "g").agg(F.min("row").alias("a"), F.max("row").alias("b")).where(F.col("b") - F.col("a") + 1 >= RUN)
    middle = F.floor((F.col("a") + F.col("b")) / 2).cast("int")
    both = targets.join(runs, "image_id").withColumn("cut", middle)
    return both.groupBy("image_id", "target").agg(F.min(F.struct(F.abs(F.col("cut") - F.col("target")), "cut"))["cut"].alias("cut"))
