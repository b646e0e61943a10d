"""Copy-on-write tables of one row per key, in buckets by key hash.

A merge reads the buckets that a batch touches, writes them anew into a folder
of its own, checks that folder, and only then adds a commit that names the
folder of every bucket.  Readers see the table before or after, never between;
a failed check or a crash leaves the old one.  Untouched buckets keep their
folders.  The number of buckets follows the size of the table.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chainlake.operators import quality
from chainlake.sources import files

LEAST_BUCKETS = 8
BUCKET_BYTES = 128 * 1024 * 1024


def _bucket_count(n_bytes: int, bucket_bytes: int) -> int:
    """The power of two that keeps buckets at ``bucket_bytes`` or less."""
    n = LEAST_BUCKETS
    while n * bucket_bytes < n_bytes:
        n *= 2
    return n


def read(spark: SparkSession, root: str, schema: T.StructType, buckets: list[int] | None = None) -> DataFrame | None:
    """The committed table, or some of its buckets; None before the first
    commit."""
    said = files.read_commit(spark, root)
    if said is None:
        return None
    paths = [f"{root}/{folder}/_bucket={b}" for b, folder in said["folders"].items() if buckets is None or int(b) in buckets]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def through(spark: SparkSession, root: str) -> int:
    """Number of the newest source batch that the table holds, -1 for none."""
    return (files.read_commit(spark, root) or {"through": -1})["through"]


def merge(spark: SparkSession, root: str, batch: DataFrame, keys: tuple[str, ...], newest: Callable[[DataFrame], DataFrame],
          schema: T.StructType, checks: Callable[[DataFrame], DataFrame] | None = None, batch_no: int = -1,
          bucket_bytes: int = BUCKET_BYTES) -> list[str]:
    """Merge a batch; returns the failed checks (then nothing has changed).

    ``newest`` selects one row per key under a total order, so the batch is
    reduced first and its ties are settled by the same rule as all others."""
    said = files.read_commit(spark, root) or {"buckets": LEAST_BUCKETS, "folders": {}, "through": -1, "bytes": 0}
    n = max(said["buckets"], _bucket_count(said["bytes"], bucket_bytes))
    bucket = F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int")
    fresh = newest(batch).select(*schema.names).withColumn("_bucket", bucket).checkpoint(eager=True)
    if n == said["buckets"]:
        touched = [r[0] for r in fresh.select("_bucket").distinct().collect()]  # at most n numbers
        old = read(spark, root, schema, touched)
    else:  # grown: all buckets are dealt anew
        touched, old = list(range(n)), read(spark, root, schema)
    rows = fresh.drop("_bucket")
    rows = newest(rows.unionByName(old)).select(*schema.names) if old is not None else rows
    folder = f"m-{uuid.uuid4().hex[:12]}"
    (rows.withColumn("_bucket", bucket).hint("rebalance", "_bucket")
     .write.partitionBy("_bucket").parquet(f"{root}/{folder}"))
    made = {int(x.split("=")[1]) for x in files.names(spark, f"{root}/{folder}") if x.startswith("_bucket=")}
    if checks is not None and made:
        new = spark.read.schema(schema).parquet(*[f"{root}/{folder}/_bucket={b}" for b in sorted(made)])
        bad = sorted(r.check for r in quality.failed(checks(new)).select("check").collect())
        if bad:
            files.delete(spark, f"{root}/{folder}")
            return bad
    kept = {} if n != said["buckets"] else {b: f for b, f in said["folders"].items() if int(b) not in touched}
    folders = kept | {str(b): folder for b in sorted(made)}
    n_bytes = sum(files.size(spark, f"{root}/{f}/_bucket={b}") for b, f in folders.items())
    number = files.write_commit(spark, root, {"buckets": n, "folders": folders, "through": max(batch_no, said["through"]), "bytes": n_bytes})
    _clean(spark, root, number)
    return []


def _clean(spark: SparkSession, root: str, number: int) -> None:
    """Drop folders that neither this commit nor the one before names: readers
    that began before this merge still find theirs."""
    live = {f for k in (number, number - 1) if k >= 0 for f in files.read_commit(spark, root, k)["folders"].values()}
    for name in files.names(spark, root):
        if name.startswith("m-") and name not in live:
            files.delete(spark, f"{root}/{name}")
    for k in files.commits(spark, root):
        if k < number - 1:
            files.delete(spark, f"{root}/_log/{k:012d}")
