"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import checkpoint, opened_folder, own_folder, remove_folder

__all__ = ["bounded_batches", "checkpoint", "opened_folder", "own_folder", "remove_folder", "small_enough", "text_of", "unused"]


#: The setting that bounds an Arrow batch in bytes, Spark's own value, and the one that whole texts are sent with.
BATCH_SETTING, BATCH_DEFAULT, BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", f"{8 << 20}b"


def bounded_batches(spark: SparkSession) -> None:
    """Texts go to Python in batches of 8 MB, for this session, unless it sets another bound: a batch is held several times over, by
    the executor and by each of its workers. Rows stay whole; a longer text is a batch of its own."""
    if spark.conf.get(BATCH_SETTING, BATCH_DEFAULT) == BATCH_DEFAULT:
        spark.conf.set(BATCH_SETTING, BATCH)


def text_of(column: str) -> Column:
    """A text column with null as the empty string."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def small_enough(rows: int, limit: int) -> bool:
    """Whether a measured row count is within a broadcast bound."""
    return rows <= limit


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have: ``name``, or that with underscores in front."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
