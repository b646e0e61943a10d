"""Helpers shared by the training-data operators."""

from __future__ import annotations

import sys
import uuid

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chainlake.session import checkpoint_path

WORD = r"[^\x20\x09-\x0D]+"
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ship_by_value(module_name: str) -> None:
    """Pickle a module's functions by value, so that Python workers need no
    installed copy of this package."""
    cloudpickle.register_pickle_by_value(sys.modules[module_name])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new folder below the shared ``spark.checkpoint.dir``."""
    return checkpoint_path(spark, f"llm-{label}-{uuid.uuid4().hex[:12]}")


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage,
    and a lost executor costs only the tasks that it ran."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def trimmed(c: Column) -> Column:
    """Without blanks of any kind at both ends."""
    return F.trim(c, F.lit(BLANKS))


def text_hash(c: Column) -> Column:
    """64-bit hash that tells apart rows of one id with different texts."""
    return F.xxhash64(F.coalesce(c, F.lit("\u0000")))


def inline_table(spark: SparkSession, rows_json: str, schema: str) -> DataFrame:
    """A small literal table, given as a JSON array of objects."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(rows_json), f"array<struct<{schema}>>")))


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder of ``fresh_path`` that no later step reads."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
