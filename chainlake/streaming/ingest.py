"""Incremental Bronze ingestion and Silver merge with Structured Streaming.

Landing folders of CSV snapshots are read as lines by the file stream source:
its checkpoint keeps the log of files already processed, and a large file is
split over many tasks.  ``trigger(availableNow=True)`` processes everything
present and stops, which suits a scheduled job; the same code runs
continuously with a processing-time trigger.

A Bronze table is three folders, each with one sub-folder per batch:
``data`` (Parquet, by snapshot_date; a ticker x day layout would mean millions
of folders at scale), ``quarantine`` (lines that could not be taken as they
were, with file and reasons) and ``manifest`` (a row per file read: path,
length, time, rows).  The manifest is renamed into place last and commits the
batch: a batch that is replayed after a failure overwrites what it had written,
and files in the manifest are never read again, even with a new checkpoint.

Silver is merged from batches into copy-on-write buckets (see ``buckets``).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chainlake.functions.util import count_if
from chainlake.operators import silver
from chainlake.session import ensure_checkpoint_dir
from chainlake.sources import files, ingest, schemas
from chainlake.streaming import buckets

TS_FORMAT = "yyyy-MM-dd HH:mm:ss.SSSSSS"
# Key of each Silver table.  Silver is dealt by a hash of the key alone, so a
# row and its later corrections, of whatever column, meet in one bucket.
SILVER_KEYS = {"options": ("contractSymbol",), "price": ("ticker", "Date")}
# Most files of a micro-batch by default: bounds its header table.
BATCH_FILES = 10_000


def _bronze_schema(kind: str) -> T.StructType:
    return schemas.BRONZE_OPTIONS if kind == "options" else schemas.BRONZE_PRICE


def _silver_schema(kind: str) -> T.StructType:
    names = silver.SILVER_OPTION_COLS if kind == "options" else [*silver.SILVER_PRICE_COLS, "_source_file"]
    return T.StructType([_bronze_schema(kind)[n] for n in names])


def _newest(kind: str) -> Callable[[DataFrame], DataFrame]:
    return silver.silver_options if kind == "options" else lambda d: silver.silver_price(d, keep=("_source_file",))


def write_landing(df: DataFrame, landing_dir: str, by: tuple[str, ...] = ()) -> None:
    """Append snapshot rows to a landing folder as headed CSV files (what the
    collector produces; used by tests and the registered ingest queries), one
    sub-folder per value of ``by``.  The rows of a folder are dealt together
    first, a large folder's over several tasks; else each task would write a
    file into each folder."""
    dealt = df.hint("rebalance", *by) if by else df
    (dealt.write.mode("append").option("header", True).option("timestampNTZFormat", TS_FORMAT)
     .partitionBy(*by).csv(landing_dir))


def read_landing_stream(spark: SparkSession, landing_dir: str, max_files: int | None = None) -> DataFrame:
    """Lines of landing files as a stream; ``max_files`` bounds a micro-batch,
    so that a backlog is worked off in several."""
    reader = (spark.readStream.option("recursiveFileLookup", True)
              .option("maxFilesPerTrigger", max_files or BATCH_FILES))
    return ingest.with_lines(reader.text(landing_dir))


def commit_batch(lines: DataFrame, kind: str, bronze_dir: str) -> None:
    """Append the files of a batch that Bronze does not know yet."""
    spark = lines.sparkSession
    heads = ingest.headers(lines, kind)
    known = read_manifest(spark, bronze_dir)
    if known is not None:
        heads = ingest.new_files_only(heads, known).checkpoint(eager=True)
    if heads.isEmpty():
        return
    number = (_batches(spark, bronze_dir) or [-1])[-1] + 1
    data, bad, manifest = (f"{bronze_dir}/{x}/batch={number}" for x in ("data", "quarantine", "manifest"))
    parsed, seen = ingest.by_header(lines, heads, kind), Observation()
    rows = ingest.typed_bronze(parsed.observe(seen, count_if(F.size("reasons") > 0).alias("bad")), kind)
    (rows.withColumn("snapshot_date", F.to_date("snapshot_time"))
     .write.mode("overwrite").partitionBy("snapshot_date").parquet(data))
    n_bad = seen.get["bad"]
    if n_bad:
        ingest.quarantine(parsed).write.mode("overwrite").parquet(bad)

    def per_file(df: DataFrame | None, name: str) -> DataFrame:
        df = spark.createDataFrame([], "_source_file string") if df is None else df
        return df.groupBy("_source_file").agg(F.count(F.lit(1)).alias(name))
    taken = per_file(_read_batches(spark, bronze_dir, kind, [number]), "n_rows")
    kept_out = per_file(spark.read.schema(schemas.QUARANTINE).parquet(bad) if n_bad else None, "n_bad")
    said = (heads.join(taken, "_source_file", "left").join(kept_out, "_source_file", "left")
            .select(F.col("_source_file").alias("path"), F.col("_length").alias("length"), F.col("_modified").alias("modified"),
                    F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.coalesce("n_bad", F.lit(0)).alias("n_bad")))
    _commit_manifest(spark, said, manifest)


def _commit_manifest(spark: SparkSession, said: DataFrame, target: str) -> None:
    folder, _, name = target.rpartition("/")
    draft = f"{folder}/_draft-{uuid.uuid4().hex[:12]}"
    said.write.parquet(draft)
    files.rename(spark, draft, f"{folder}/{name}")


def _batches(spark: SparkSession, bronze_dir: str) -> list[int]:
    """Numbers of the committed batches, ascending."""
    return sorted(int(n.split("=")[1]) for n in files.names(spark, f"{bronze_dir}/manifest") if n.startswith("batch="))


def batches_after(spark: SparkSession, bronze_dir: str, number: int) -> list[int]:
    return [n for n in _batches(spark, bronze_dir) if n > number]


def read_manifest(spark: SparkSession, bronze_dir: str) -> DataFrame | None:
    """One row per file read, with its batch; None before the first batch."""
    if not _batches(spark, bronze_dir):
        return None
    schema = T.StructType([*schemas.MANIFEST.fields, T.StructField("batch", T.LongType())])
    return spark.read.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{bronze_dir}/manifest")


def record_empty_files(spark: SparkSession, landing_dir: str, bronze_dir: str) -> None:
    """Enter landing files of no bytes into the manifest: no line of them ever
    reaches a batch.  Only the listing is read."""
    listed = spark.createDataFrame(files.empty_files(spark, landing_dir), "_source_file string, ms long")
    new = ingest.new_files_only(listed, read_manifest(spark, bronze_dir)).select(
        F.col("_source_file").alias("path"), F.lit(0).cast("long").alias("length"), F.timestamp_millis("ms").alias("modified"),
        F.lit(0).cast("long").alias("n_rows"), F.lit(0).cast("long").alias("n_bad"))
    if not new.isEmpty():
        number = (_batches(spark, bronze_dir) or [-1])[-1] + 1
        _commit_manifest(spark, new, f"{bronze_dir}/manifest/batch={number}")


def ingest_to_bronze(spark: SparkSession, landing_dir: str, kind: str, bronze_dir: str,
                     checkpoint: str, processing_time: str | None = None, max_files: int | None = None):
    """Append every landing file not yet seen to Bronze.  By default the
    query processes what is there and stops (``availableNow``); with
    ``processing_time`` (e.g. ``"5 minutes"``) it keeps running and the
    started query is returned."""
    ensure_checkpoint_dir(spark)
    w = (read_landing_stream(spark, landing_dir, max_files).writeStream.option("checkpointLocation", checkpoint)
         .foreachBatch(lambda lines, _id: commit_batch(lines, kind, bronze_dir)))
    if processing_time:
        return w.trigger(processingTime=processing_time).start()
    w.trigger(availableNow=True).start().awaitTermination()
    record_empty_files(spark, landing_dir, bronze_dir)
    return None


def _read_batches(spark: SparkSession, bronze_dir: str, kind: str | None, numbers: list[int]) -> DataFrame:
    found = set(files.names(spark, f"{bronze_dir}/data"))
    paths = [f"{bronze_dir}/data/batch={n}" for n in numbers if f"batch={n}" in found]
    if not paths:
        return spark.createDataFrame([], _bronze_schema(kind or "options"))
    reader = spark.read.option("basePath", f"{bronze_dir}/data")
    if kind:
        parts = [T.StructField("batch", T.LongType()), T.StructField("snapshot_date", T.DateType())]
        reader = reader.schema(T.StructType([*_bronze_schema(kind).fields, *parts]))
    return reader.parquet(*paths).drop("batch", "snapshot_date")


def read_bronze(spark: SparkSession, bronze_dir: str, kind: str | None = None, after: int | None = None) -> DataFrame:
    """The committed rows; ``after``: only batches above that number.  Without
    ``kind`` the schema is that of the files."""
    return _read_batches(spark, bronze_dir, kind, batches_after(spark, bronze_dir, -1 if after is None else after))


def read_quarantine(spark: SparkSession, bronze_dir: str) -> DataFrame:
    """Lines that Bronze could not take as they were: file, reasons, line."""
    there = set(files.names(spark, f"{bronze_dir}/quarantine"))
    paths = [f"{bronze_dir}/quarantine/batch={n}" for n in _batches(spark, bronze_dir) if f"batch={n}" in there]
    return spark.read.schema(schemas.QUARANTINE).parquet(*paths) if paths else spark.createDataFrame([], schemas.QUARANTINE)


def merge_into_silver(batch: DataFrame, silver_dir: str, kind: str, checks=None, batch_no: int = -1) -> list[str]:
    """Newest-row merge of a batch into a Silver table: the rows of the
    touched buckets and the batch go through the same selection as a full
    rebuild.  Returns failed checks; then Silver is as it was."""
    return buckets.merge(batch.sparkSession, silver_dir, batch, SILVER_KEYS[kind], _newest(kind), _silver_schema(kind), checks, batch_no)


def stream_silver_merge(spark: SparkSession, landing_dir: str, kind: str, silver_dir: str,
                        checkpoint: str, max_files: int | None = None, checks=None) -> None:
    """Landing CSV -> (stream) -> newest-row merge into Silver, then stop.  A
    failed check ends the stream with an error; the files stay unread."""
    ensure_checkpoint_dir(spark)

    def one(lines: DataFrame, _id: int) -> None:
        heads = ingest.headers(lines, kind)
        if heads.isEmpty():
            return
        rows = ingest.typed_bronze(ingest.by_header(lines, heads, kind), kind)
        bad = merge_into_silver(rows, silver_dir, kind, checks)
        if bad:
            raise ValueError(f"{silver_dir} failed checks: {bad}")
    q = (read_landing_stream(spark, landing_dir, max_files).writeStream.foreachBatch(one)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


def silver_from_bronze(spark: SparkSession, bronze_dir: str, kind: str, silver_dir: str, checks=None) -> list[str]:
    """Merge the Bronze batches that Silver does not hold yet.  Silver's own
    commit says how far it has come, so a batch counts once and a batch whose
    merge failed its checks is tried again with what came later."""
    new = batches_after(spark, bronze_dir, buckets.through(spark, silver_dir))
    if not new:
        return []
    return merge_into_silver(_read_batches(spark, bronze_dir, kind, new), silver_dir, kind, checks, new[-1])


def read_silver(spark: SparkSession, silver_dir: str, kind: str) -> DataFrame | None:
    """The published Silver table; None before the first merge."""
    df = buckets.read(spark, silver_dir, _silver_schema(kind))
    return df.drop("_source_file") if df is not None and kind == "price" else df
