"""Sorted reports that carry their order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chainlake.session import ensure_checkpoint_dir


def numbered(df: DataFrame, order, name: str = "row_no") -> DataFrame:
    """``df`` sorted by ``order`` (ascending, NULLs last; then by all other
    columns), each row with its number in that order, from 1.

    The sort deals ranges to tasks, and each task numbers its own range; a
    table of one row per range says how many rows stand before it.  No task
    sees more than a range.  The sorted rows are checkpointed, so that numbers
    and ranges are of the same sort, also when a task is repeated."""
    ensure_checkpoint_dir(df.sparkSession)
    by = [*order, *[c for c in df.columns if c not in order]]
    ranged = (df.orderBy(*[F.col(c).asc_nulls_last() for c in by])
              .select("*", F.spark_partition_id().alias("_range"), F.monotonically_increasing_id().alias("_at"))
              .withColumn("_at", F.col("_at") - F.shiftleft(F.col("_range").cast("long"), 33)).checkpoint(eager=True))
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")
    offsets = sizes.select(F.col("_range").alias("_r"), before.alias("_before"))
    return (ranged.join(offsets, F.col("_range") == F.col("_r"))
            .select(*df.columns, (F.col("_before") + F.col("_at") + 1).alias(name)))
