"""Batch build of the Silver and Gold tables, validate-then-publish.

Each table is computed, written to a staging folder under the shared
checkpoint directory (which also cuts the lineage for the tables built on
top of it), checked by the job that writes it, and only then moved into
place.  A table whose abort-level checks fail is not published; the
reference publishes first and asserts afterwards.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from chainlake.operators import gold, quality, silver
from chainlake.session import checkpoint_path
from chainlake.sources import files

# Silver/Gold are one row per contract, ticker-day or less: only the
# contract-level table is partitioned (by expiry); the rest are single
# folders.
PARTITIONS = {
    "silver_price_daily": [],
    "silver_options_latest": ["expiry"],
    "gold_latest_snapshot": ["expiry"],
    "gold_pcr": [],
    "gold_iv_rank": [],
    "gold_greeks_exposure": [],
}


# Tables each table is built from: a table whose input failed validation is
# held back as well.
DEPENDS = {
    "gold_latest_snapshot": ("silver_options_latest", "silver_price_daily"),
    "gold_pcr": ("silver_options_latest",),
    "gold_iv_rank": ("silver_price_daily",),
    "gold_greeks_exposure": ("silver_options_latest",),
}


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


POINTER = "_CURRENT"


def _read_pointer(spark: SparkSession, target: str) -> str | None:
    p, fs = _fs(spark, f"{target}/{POINTER}")
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def replace_table(spark: SparkSession, staged: str, target: str) -> None:
    """Publish a staged folder as a new version of ``target``: it is renamed
    to a folder of its own, then the pointer file is replaced.  Readers see
    the old version or the new one at any time, and a crash in between leaves
    the old one.  The version before stays for readers that have begun."""
    before = _read_pointer(spark, target)
    version = f"v-{uuid.uuid4().hex[:12]}"
    src, fs = _fs(spark, staged)
    dst, _ = _fs(spark, f"{target}/{version}")
    fs.mkdirs(dst.getParent())
    if not fs.rename(src, dst):
        raise IOError(f"could not publish {staged} -> {target}")
    pointer, _ = _fs(spark, f"{target}/{POINTER}")
    out = fs.create(pointer, True)
    try:
        out.write(version.encode())
    finally:
        out.close()
    for f in fs.listStatus(dst.getParent()):
        name = f.getPath().getName()
        if name.startswith("v-") and name not in (version, before):
            fs.delete(f.getPath(), True)


def read_table(spark: SparkSession, out_dir: str, name: str) -> DataFrame | None:
    """The published version of a table; None before the first one."""
    target = f"{out_dir.rstrip('/')}/{name}"
    version = _read_pointer(spark, target)
    return spark.read.parquet(f"{target}/{version}") if version else None


def _stage(spark: SparkSession, df: DataFrame, name: str, run: str) -> tuple[DataFrame, int, list[str]]:
    """Write a table to its staging folder; its rows are counted and checked
    by the same job.  Returns it read back, with the count and failed checks."""
    path = checkpoint_path(spark, f"medallion-{run}/{name}")
    df, seen = quality.observed(name, df)
    w = df.write.mode("overwrite")
    if PARTITIONS.get(name):
        w = w.partitionBy(*PARTITIONS[name])
    w.parquet(path)
    return spark.read.parquet(path), seen.get["_rows"], quality.observed_failures(name, seen)


def _repeated(df: DataFrame, key: str) -> bool:
    """A key occurs twice: only the key column of a staged table is read."""
    return not df.groupBy(key).count().where("count > 1").isEmpty()


def build(spark: SparkSession, bronze_options: DataFrame | None, bronze_price: DataFrame | None,
          out_dir: str | None = None, strict: bool = False,
          silver_tables: dict[str, tuple[DataFrame | None, list[str]]] | None = None,
          per_snapshot: DataFrame | None = None) -> DataFrame:
    """Build the six tables; returns one row per table: rows, failed
    abort-level checks, published flag.  ``out_dir=None`` validates only.
    ``strict=True`` raises on the first failing table.

    ``silver_tables``: Silver is maintained incrementally (checked before each
    merge is published); per table its published version, if any, and the
    checks that the last merge failed.  Only the Gold tables are built then,
    those whose Silver is whole, and ``per_snapshot`` is the IV per run: no
    scan of Bronze at all."""
    run = uuid.uuid4().hex[:12]
    in_place = silver_tables is not None
    tables: dict[str, DataFrame | None] = {}
    verdicts: dict[str, tuple[int | None, list[str]]] = {}
    def stage(name: str, df: DataFrame) -> None:
        tables[name], n, bad = _stage(spark, df, name, run)
        verdicts[name] = (n, bad)
    if in_place:
        for name, (df, bad) in silver_tables.items():
            tables[name] = df
            verdicts[name] = (df.count() if df is not None else None, bad)
    else:  # one row per key by the way they are selected
        stage("silver_price_daily", silver.silver_price(bronze_price))
        stage("silver_options_latest", silver.silver_options(bronze_options))
    px, opts = tables["silver_price_daily"], tables["silver_options_latest"]

    def ranked() -> DataFrame:
        return gold.iv_rank(gold.iv_per_snapshot(bronze_options, px) if per_snapshot is None else per_snapshot)
    made = {
        "gold_latest_snapshot": lambda: silver.latest_snapshot(opts, px),
        "gold_pcr": lambda: gold.pcr(opts),
        "gold_iv_rank": ranked,
        "gold_greeks_exposure": lambda: gold.greeks_exposure(opts),
    }
    for name, df in made.items():
        if in_place and any(verdicts[d][1] or tables[d] is None for d in DEPENDS[name]):
            tables[name], verdicts[name] = None, (None, [])
        else:
            stage(name, df())
    latest = tables["gold_latest_snapshot"]
    if latest is not None:
        n, bad = verdicts["gold_latest_snapshot"]
        bad = bad + (["rows_vs_silver"] if n != verdicts["silver_options_latest"][0] else [])
        verdicts["gold_latest_snapshot"] = (n, bad + (["contracts_vs_silver"] if _repeated(latest, "contractSymbol") else []))
    for name, (_, bad) in verdicts.items():
        if bad and strict:
            raise ValueError(f"{name} failed checks: {bad}")
    for name, deps in DEPENDS.items():
        n, bad = verdicts[name]
        verdicts[name] = (n, bad + [f"upstream:{d}" for d in deps if tables[d] is None or verdicts[d][1]
                                    and not any(b.startswith("upstream:") for b in verdicts[d][1])])
    report = []
    for name in PARTITIONS:
        n, bad = verdicts[name]
        if in_place and name.startswith("silver_"):
            report.append((name, n, len(bad), ",".join(bad), not bad and tables[name] is not None))
            continue
        published = not bad and out_dir is not None
        if published:
            replace_table(spark, checkpoint_path(spark, f"medallion-{run}/{name}"),
                          f"{out_dir.rstrip('/')}/{name}")
        report.append((name, n, len(bad), ",".join(bad), published))
    return spark.createDataFrame(
        report, "table string, rows long, failed_checks int, failed string, published boolean")


SILVER_DIRS = {"options": "silver_options_latest", "price": "silver_price_daily"}


def update_kept(spark: SparkSession, bronze_dir: str, kept_dir: str, reduce_rows) -> DataFrame:
    """A table of mergeable parts (``reduce_rows`` of each Bronze batch), kept
    beside Bronze: only batches that it does not hold yet are read.  A folder
    per update, named by a commit, so an update that died leaves nothing
    behind that is read."""
    from chainlake.streaming import ingest as stream

    said = files.read_commit(spark, kept_dir) or {"through": -1, "folders": []}
    new = stream.batches_after(spark, bronze_dir, said["through"])
    if new:
        folder = f"p-{uuid.uuid4().hex[:12]}"
        reduce_rows(stream.read_bronze(spark, bronze_dir, "options", after=said["through"])).write.parquet(f"{kept_dir}/{folder}")
        said = {"through": new[-1], "folders": [*said["folders"], folder]}
        files.write_commit(spark, kept_dir, said)
    paths = [f"{kept_dir}/{f}" for f in said["folders"]]
    return spark.read.parquet(*paths) if paths else reduce_rows(stream.read_bronze(spark, bronze_dir, "options"))


def update_iv_partials(spark: SparkSession, bronze_dir: str, partials_dir: str) -> DataFrame:
    """``gold.iv_partials`` of every Bronze batch."""
    return update_kept(spark, bronze_dir, partials_dir, gold.iv_partials)


def run(spark: SparkSession, landing_root: str, warehouse: str, strict: bool = False,
        incremental: bool = True) -> DataFrame:
    """End-to-end scheduled job.

    1. Ingest every new file under ``landing_root/options`` and
       ``landing_root/price`` into Bronze (Structured Streaming,
       ``availableNow``; checkpoints under the warehouse).
    2. ``incremental=True``: merge only the Bronze batches added since the
       last run into the Silver tables (newest row per key, touched buckets
       only, checked before they are published) and into the partial IV sums,
       then build, validate and publish Gold from those: old Bronze is not
       read.  ``incremental=False``: rebuild Silver from all of Bronze, the
       reference's behaviour, validate-then-publish everything.

    Safe to re-run: files in Bronze's manifest and batches in Silver's commits
    count once."""
    from chainlake.streaming import ingest as stream

    root = warehouse.rstrip("/")
    for kind in ("options", "price"):
        stream.ingest_to_bronze(spark, f"{landing_root.rstrip('/')}/{kind}", kind,
                                f"{root}/bronze_{kind}", f"{root}/_checkpoints/bronze_{kind}")
    if not incremental:
        return build(spark, stream.read_bronze(spark, f"{root}/bronze_options"),
                     stream.read_bronze(spark, f"{root}/bronze_price", "price"), out_dir=root, strict=strict)
    checks = {"options": quality.abort_silver_options, "price": quality.abort_silver_price}
    silver_tables = {}
    for kind, name in reversed(SILVER_DIRS.items()):
        bad = stream.silver_from_bronze(spark, f"{root}/bronze_{kind}", kind, f"{root}/{name}", checks[kind])
        silver_tables[name] = (stream.read_silver(spark, f"{root}/{name}", kind), bad)
    partials = update_iv_partials(spark, f"{root}/bronze_options", f"{root}/iv_partials")
    px = silver_tables["silver_price_daily"][0]
    return build(spark, None, None, out_dir=root, strict=strict, silver_tables=silver_tables,
                 per_snapshot=None if px is None else gold.iv_from_partials(partials, px))
