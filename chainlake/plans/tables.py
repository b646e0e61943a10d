"""Named Bronze/Silver/Gold DataFrames over a data folder.

Bronze is the stored input layer (the reference keeps it as a database
table): the Bronze views derived from the driver's tables are written once
per data folder as Parquet under the shared ``spark.checkpoint.dir``,
partitioned by snapshot_date like the streaming ingest writes them (rows
sorted by ticker and contract inside the files), and every query reads
that table.  Silver and Gold are computed by
each query from Bronze.  Set ``CHAINLAKE_MATERIALIZE_BRONZE=0`` to derive
Bronze inline instead.
"""

from __future__ import annotations

import hashlib
import os
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainlake.operators import gold, silver
from chainlake.session import checkpoint_path, ensure_checkpoint_dir
from chainlake.sources import fixtures

_LOCK = threading.Lock()
_SOURCES = {"options": ("events",), "price": ("events",), "history": ("orders",)}


def _code_version() -> str:
    """Hash of the modules that define the derived Bronze tables, so a code
    change never reads a stale materialisation."""
    from chainlake.functions import pricing
    from chainlake.sources import ingest

    h = hashlib.sha1()
    for mod in (fixtures, pricing, ingest):
        with open(mod.__file__, "rb") as fh:
            h.update(fh.read())
    return h.hexdigest()[:8]


def _signature(spark: SparkSession, sf_dir: str, names) -> str:
    """Path, length and modification time of every file of the tables, read
    through the Hadoop file system, so it holds for any storage."""
    parts = [sf_dir.rstrip("/"), _code_version()]
    for n in names:
        p, fs = _fs(spark, f"{sf_dir}/{n}.parquet")
        files = fs.listFiles(p, True)
        while files.hasNext():
            f = files.next()
            parts.append(f"{f.getPath()}:{f.getLen()}:{f.getModificationTime()}")
    return hashlib.sha1("|".join(sorted(parts)).encode()).hexdigest()[:16]


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _exists(spark: SparkSession, path: str) -> bool:
    p, fs = _fs(spark, path)
    return fs.exists(p)


def materialized(spark: SparkSession, sf_dir: str, kind: str, build, partition_by,
                 sort_by=()) -> DataFrame:
    """Write ``build()`` once to the shared folder (keyed by the source
    files' identity and the code version) and read it back.  The table is
    written to a private folder and renamed into place, so concurrent
    writers (threads or processes) never see a half-written table: the first
    rename wins and the others drop their copy."""
    if os.environ.get("CHAINLAKE_MATERIALIZE_BRONZE", "1") == "0":
        return build()
    ensure_checkpoint_dir(spark)
    path = checkpoint_path(spark, f"bronze-{kind}-{_signature(spark, sf_dir, _SOURCES[kind])}")
    with _LOCK:
        if not _exists(spark, f"{path}/_SUCCESS"):
            tmp = f"{path}.tmp-{uuid.uuid4().hex[:12]}"
            df = build()
            if partition_by:
                # cluster by the partition columns (few files per folder);
                # the rebalance hint lets AQE split a hot (ticker, day) over
                # several writers and merge small ones
                df = df.hint("rebalance", *partition_by)
            if sort_by:
                # rows of a ticker/contract sit together, so Parquet
                # min/max statistics skip row groups on those columns
                df = df.sortWithinPartitions(*sort_by)
            w = df.write.mode("overwrite").option("maxRecordsPerFile", 5_000_000)
            if partition_by:
                w = w.partitionBy(*partition_by)
            w.parquet(tmp)
            src, fs = _fs(spark, tmp)
            dst, _ = _fs(spark, path)
            if not fs.rename(src, dst):
                fs.delete(src, True)        # another writer published first
                if not _exists(spark, f"{path}/_SUCCESS"):
                    raise IOError(f"could not publish {tmp} -> {path}")
    out = spark.read.parquet(path)
    return out


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def bronze_options(self) -> DataFrame:
        cols = fixtures.BRONZE_OPTION_COLS

        def build():
            b = fixtures.bronze_options_raw(self.spark, self.sf_dir)
            return b.withColumn("snapshot_date", F.to_date("snapshot_time"))

        df = materialized(self.spark, self.sf_dir, "options", build, ["snapshot_date"],
                          sort_by=("ticker", "contractSymbol", "snapshot_time"))
        return df.select(*cols)

    def bronze_price(self) -> DataFrame:
        cols = fixtures.BRONZE_PRICE_COLS
        df = materialized(self.spark, self.sf_dir, "price",
                          lambda: fixtures.bronze_price_raw(self.spark, self.sf_dir), [],
                          sort_by=("ticker", "Date"))
        return df.select(*cols)

    def silver_price(self) -> DataFrame:
        return silver.silver_price(self.bronze_price())

    def silver_options(self) -> DataFrame:
        return silver.silver_options(self.bronze_options())

    def gold_latest(self) -> DataFrame:
        return silver.latest_snapshot(self.silver_options(), self.silver_price())

    def spot(self) -> DataFrame:
        return silver.spot(self.silver_price())

    def gold_pcr(self) -> DataFrame:
        return gold.pcr(self.silver_options())

    def iv_per_snapshot(self, **kw) -> DataFrame:
        return gold.iv_per_snapshot(self.bronze_options(), self.silver_price(), **kw)

    def gold_iv_rank(self) -> DataFrame:
        return gold.iv_rank(self.iv_per_snapshot())

    def gold_exposure(self) -> DataFrame:
        return gold.greeks_exposure(self.silver_options())

    def price_history(self) -> DataFrame:
        df = materialized(self.spark, self.sf_dir, "history",
                          lambda: fixtures.price_history(self.spark, self.sf_dir), [],
                          sort_by=("ticker", "Date"))
        return df.select("Date", "ticker", "Close")
