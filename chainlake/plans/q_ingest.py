"""Registered queries: landing -> Bronze ingestion (Structured Streaming),
Silver merge, snapshot sink, table replacement, column stamping.

The ingest queries write landing CSV files derived from the driver's
tables into a fresh folder under the shared checkpoint directory, in two
collection runs (snapshots through ``RUN1_THROUGH``, then the rest), run
the streaming ingest after each, and once more with nothing new: every
row must land exactly once, also when the stream's checkpoint is lost.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainlake.functions.util import lit_date, select_existing
from chainlake.plans import medallion
from chainlake.plans.catalog import register
from chainlake.plans.oracle import sql
from chainlake.plans.tables import Tables
from chainlake.session import checkpoint_path, ensure_checkpoint_dir
from chainlake.operators import gold, silver
from chainlake.sources import fixtures, ingest, schemas
from chainlake.streaming import ingest as stream

RUN1_THROUGH = "2024-01-15"
OPTION_COLS = [f.name for f in schemas.OPTIONS_CSV.fields]
PRICE_COLS = [f.name for f in schemas.PRICE_CSV.fields]
SILVER_COLS = [c for c in silver.SILVER_OPTION_COLS if c != "_source_file"]


def _workdir(spark, name: str) -> str:
    ensure_checkpoint_dir(spark)
    return checkpoint_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")


def _runs(rows):
    d = F.to_date("snapshot_time")
    cut = lit_date(RUN1_THROUGH)
    return [rows.filter(d <= cut), rows.filter(d > cut)]


# The landing folder of a row, as far as its name does not change by run.
def _part():
    return F.regexp_extract("_source_file", "part=([^/]+)/", 1).alias("_source_file")


OPTION_PART_SQL = """
parts AS (SELECT *, 'r' || lpad(CAST(row_number() OVER (PARTITION BY contractSymbol, snapshot_time, snapshot_str
                                                       ORDER BY _source_file) AS VARCHAR), 4, '0') AS part
          FROM bronze_options_raw)"""


def _rows(spark, sf_dir: str, kind: str):
    return (fixtures.options_csv_rows if kind == "options" else fixtures.price_csv_rows)(spark, sf_dir, with_part=True)


def _ingest(spark, sf_dir: str, kind: str, runs: int = 2) -> tuple[str, str]:
    """Landing folder and Bronze table after some of the two runs."""
    base = _workdir(spark, f"ingest-{kind}")
    landing, bronze, ckpt = f"{base}/landing", f"{base}/bronze", f"{base}/_ckpt"
    for k, part in enumerate(_runs(_rows(spark, sf_dir, kind))):
        if k:  # the second run's files have other columns first, and 90 more
            more = [F.lit("x").alias(f"note{i}") for i in range(90)]
            part = part.select(*more, *reversed([c for c in part.columns if c != "part"]), "part")
        stream.write_landing(part, landing, by=("part",))
        if k < runs:
            stream.ingest_to_bronze(spark, landing, kind, bronze, ckpt)
    if runs == 2:
        stream.ingest_to_bronze(spark, landing, kind, bronze, ckpt)  # nothing new: adds 0 rows
        stream.ingest_to_bronze(spark, landing, kind, bronze, f"{ckpt}-lost")  # all files again, all in the manifest
    return landing, bronze


@register("ingest_options", sql(f"""
SELECT {", ".join(c for c in OPTION_COLS)}, part AS _source_file FROM parts""", extra=OPTION_PART_SQL))
def q_ingest_options(spark, sf_dir):
    _, bronze = _ingest(spark, sf_dir, "options")
    return stream.read_bronze(spark, bronze).select(*OPTION_COLS, _part())


@register("ingest_price", sql(f"""
SELECT {", ".join(f'"{c}"' for c in PRICE_COLS)}, ticker || '_' || snapshot_str AS _source_file FROM bronze_price_raw"""))
def q_ingest_price(spark, sf_dir):
    _, bronze = _ingest(spark, sf_dir, "price")
    return stream.read_bronze(spark, bronze, "price").select(*PRICE_COLS, _part())


@register("ingest_manifest", sql("""
SELECT part, CAST(snapshot_time AS DATE) > DATE '%s' AS late, count(*) AS n_rows FROM parts GROUP BY 1, 2""" % RUN1_THROUGH,
                                 extra=OPTION_PART_SQL))
def q_ingest_manifest(spark, sf_dir):
    """Rows by landing folder and batch, from the manifest alone."""
    _, bronze = _ingest(spark, sf_dir, "options")
    m = stream.read_manifest(spark, bronze).where("n_rows > 0")
    return (m.groupBy(F.regexp_extract("path", "part=([^/]+)/", 1).alias("part"), (F.col("batch") > 0).alias("late"))
            .agg(F.sum("n_rows").alias("n_rows")))


@register("manifest_dedupe", sql(f"""
SELECT {", ".join(c for c in OPTION_COLS)}, part AS _source_file FROM parts
WHERE CAST(snapshot_time AS DATE) > DATE '{RUN1_THROUGH}'""", extra=OPTION_PART_SQL))
def q_manifest_dedupe(spark, sf_dir):
    """The landing folder holds both runs, Bronze the first: the rows of files
    that its manifest does not name (``new_files_only``, on the table of
    headers).  Bronze itself is not read."""
    landing, bronze = _ingest(spark, sf_dir, "options", runs=1)
    new = ingest.read_landing(spark, landing, "options", stream.read_manifest(spark, bronze))
    return new.select(*OPTION_COLS, _part())


# What the quarantine query spoils, by number of the contract.
OPEN_TICKER, WIDE_TICKER, BAD_STRIKE, BAD_BID, NO_CLOCK = 11, 13, 17, 19, 23
QUARANTINE_SQL = f"""
SELECT reason, loaded, bid_null, count(*) AS n FROM (
  SELECT CASE WHEN u % {WIDE_TICKER} = 0 THEN 'more fields, header has 18'
              WHEN u % {OPEN_TICKER} = 0 THEN 'open quote'
              WHEN u % {NO_CLOCK} = 0 THEN 'snapshot_time: never'
              WHEN u % {BAD_STRIKE} = 0 THEN 'strike: oops'
              WHEN u % {BAD_BID} = 0 THEN 'bid: n/a' ELSE '' END AS reason,
         (u % {WIDE_TICKER} <> 0 AND u % {OPEN_TICKER} <> 0 AND u % {NO_CLOCK} <> 0 AND u % {BAD_STRIKE} <> 0) AS loaded,
         (u % {BAD_BID} = 0 AND u % {WIDE_TICKER} <> 0 AND u % {OPEN_TICKER} <> 0 AND u % {NO_CLOCK} <> 0 AND u % {BAD_STRIKE} <> 0) AS bid_null
  FROM (SELECT CAST(substr(contractSymbol, 2) AS BIGINT) AS u FROM bronze_options_raw)) GROUP BY 1, 2, 3"""


@register("ingest_quarantine", sql(QUARANTINE_SQL))
def q_ingest_quarantine(spark, sf_dir):
    """Landing rows, some spoiled; how many came to Bronze and how many to the
    quarantine table, by first reason."""
    base = _workdir(spark, "ingest-quarantine")
    landing, bronze = f"{base}/landing", f"{base}/bronze"
    u = F.substring("contractSymbol", 2, 20).cast("long")
    spoiled = fixtures.options_csv_rows(spark, sf_dir).withColumns({
        "ticker": F.when(u % WIDE_TICKER == 0, F.lit("TKA,more")).when(u % OPEN_TICKER == 0, F.lit('"TKA')).otherwise(F.col("ticker")),
        "snapshot_time": F.when(u % NO_CLOCK == 0, "never").otherwise(F.date_format("snapshot_time", stream.TS_FORMAT)),
        "strike": F.when((u % BAD_STRIKE == 0) & (u % NO_CLOCK != 0), "oops").otherwise(F.col("strike").cast("string")),
        "bid": F.when((u % BAD_BID == 0) & (u % NO_CLOCK != 0) & (u % BAD_STRIKE != 0), "n/a").otherwise(F.col("bid").cast("string"))})
    # as one column of whole lines, so that the writer quotes nothing
    line = F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in OPTION_COLS])
    spoiled.select(line.alias(",".join(OPTION_COLS))).write.options(header=True, sep="\u0001", quote="").csv(landing)
    stream.ingest_to_bronze(spark, landing, "options", bronze, f"{base}/_ckpt")
    bad = stream.read_quarantine(spark, bronze).select(
        F.get("reasons", F.lit(0)).alias("reason"), "loaded", F.col("loaded").alias("bid_null"))
    good = stream.read_bronze(spark, bronze).where("bid IS NOT NULL").select(
        F.lit("").alias("reason"), F.lit(True).alias("loaded"), F.lit(False).alias("bid_null"))
    return bad.unionByName(good).groupBy("reason", "loaded", "bid_null").agg(F.count(F.lit(1)).alias("n"))


@register("stream_silver_merge", sql(f"""
SELECT {", ".join(f"s.{c}" for c in SILVER_COLS)}, p.part AS _source_file
FROM silver_options_latest s JOIN parts p
  ON s.contractSymbol = p.contractSymbol AND s.snapshot_time = p.snapshot_time AND s.snapshot_str = p.snapshot_str
     AND s._source_file = p._source_file""", extra=OPTION_PART_SQL))
def q_stream_silver_merge(spark, sf_dir):
    """Two micro-batch runs of all landing rows merged into a bucketed Silver
    table, ties included; must equal the one-shot batch rebuild."""
    base = _workdir(spark, "silver-merge")
    landing, silver_dir, ckpt = f"{base}/landing", f"{base}/silver", f"{base}/_ckpt"
    # the later run first: the earlier snapshots then arrive late
    for part in reversed(_runs(_rows(spark, sf_dir, "options"))):
        stream.write_landing(part, landing, by=("part",))
        stream.stream_silver_merge(spark, landing, "options", silver_dir, ckpt)
    return stream.read_silver(spark, silver_dir, "options").select(*SILVER_COLS, _part())


@register("iv_rank_incremental", sql("SELECT * FROM gold_iv_rank", gold=True))
def q_iv_rank_incremental(spark, sf_dir):
    """IV rank of two scheduled runs, the second from the partial sums kept by
    the first and its own Bronze batch: no rescan of old Bronze."""
    base = _workdir(spark, "iv-incremental")
    for kind in ("options", "price"):
        for part in _runs(_rows(spark, sf_dir, kind)):
            stream.write_landing(part, f"{base}/landing-{kind}", by=("part",))
            stream.ingest_to_bronze(spark, f"{base}/landing-{kind}", kind, f"{base}/{kind}", f"{base}/_ckpt-{kind}")
            if kind == "options":
                partials = medallion.update_iv_partials(spark, f"{base}/options", f"{base}/iv_partials")
    stream.silver_from_bronze(spark, f"{base}/price", "price", f"{base}/silver_price")
    px = stream.read_silver(spark, f"{base}/silver_price", "price")
    return gold.iv_rank(gold.iv_from_partials(partials, px))


@register("csv_snapshot_sink", sql("""
SELECT ticker, CAST(snapshot_time AS DATE) AS snapshot_date, count(*) AS n_rows,
       count(DISTINCT snapshot_str) AS n_runs
FROM bronze_options_raw GROUP BY 1, 2"""))
def q_csv_snapshot_sink(spark, sf_dir):
    base = _workdir(spark, "snapshot-sink")
    ingest.csv_snapshot_sink(Tables(spark, sf_dir).bronze_options(), base)
    back = spark.read.parquet(base)
    return back.groupBy("ticker", "snapshot_date").agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("snapshot_str").alias("n_runs"))


# The one check that the half-day bars of the test data can fail, and what
# depends on that table.
REPLACE_SQL = """
SELECT tbl, CASE WHEN ok THEN n END AS n_rows, ok AS published FROM (
  SELECT 'silver_price_daily' AS tbl, (SELECT count(*) FROM silver_price_daily) AS n, (SELECT ok FROM px) AS ok
  UNION ALL SELECT 'silver_options_latest', (SELECT count(*) FROM silver_options_latest), TRUE
  UNION ALL SELECT 'gold_latest_snapshot', (SELECT count(*) FROM gold_latest_snapshot), (SELECT ok FROM px)
  UNION ALL SELECT 'gold_pcr', (SELECT count(*) FROM gold_pcr), TRUE
  UNION ALL SELECT 'gold_iv_rank', (SELECT count(*) FROM gold_iv_rank), (SELECT ok FROM px)
  UNION ALL SELECT 'gold_greeks_exposure', (SELECT count(*) FROM gold_greeks_exposure), TRUE)"""


@register("replace_table", sql(REPLACE_SQL, gold=True, extra="""
px AS (SELECT count(*) = 0 AS ok FROM silver_price_daily
       WHERE "High" < "Low" OR "Close" < "Low" OR "Close" > "High" OR "Open" < "Low" OR "Open" > "High")"""))
def q_replace_table(spark, sf_dir):
    """Validate-then-publish build of the six Silver/Gold tables, then the row
    counts of what was published, read back through the version pointers."""
    t = Tables(spark, sf_dir)
    out = _workdir(spark, "medallion-out")
    medallion.build(spark, t.bronze_options(), t.bronze_price(), out_dir=out)
    parts = []
    for name in medallion.PARTITIONS:
        df = medallion.read_table(spark, out, name)
        there = df is not None
        rows = df.agg(F.count(F.lit(1)).alias("n_rows")) if there else spark.range(1).select(F.lit(None).cast("long").alias("n_rows"))
        parts.append(rows.select(F.lit(name).alias("tbl"), "n_rows", F.lit(there).alias("published")))
    return reduce(DataFrame.unionByName, parts)


@register("add_metadata", sql(r"""
SELECT contractSymbol, snapshot_time, strftime(snapshot_time, '%Y%m%d_%H%M%S') AS snapshot_str, ticker
FROM landing_rows"""))
def q_add_metadata(spark, sf_dir):
    """Stamp every landing row with its run clock and ticker (Column form:
    a run clock per row instead of one literal per run)."""
    land = fixtures.options_landing(spark, sf_dir).select("contractSymbol", "snapshot_time", "ticker")
    stamped = ingest.add_metadata(land, F.col("snapshot_time"), F.col("ticker"))
    return stamped.select("contractSymbol", "snapshot_time", "snapshot_str", "ticker")


@register("select_existing", sql(f"""
SELECT {", ".join(c for c in OPTION_COLS if c not in ("theta", "vega", "inTheMoney"))}, inTheMoney
FROM (SELECT *, inTheMoney_text AS inTheMoney FROM landing_rows)"""))
def q_select_existing(spark, sf_dir):
    """The collector keeps its 18 columns where present; the landing rows
    lack theta and vega, which are dropped silently."""
    land = fixtures.options_landing(spark, sf_dir)
    return select_existing(land, OPTION_COLS)


PRICE_SILVER_COLS = ["Date", "ticker", "Open", "High", "Low", "Close", "Volume", "HV_20", "HV_252",
                     "snapshot_time", "snapshot_str"]


@register("stream_silver_merge_price", sql(f"""
SELECT {", ".join(f'"{c}"' for c in PRICE_SILVER_COLS)} FROM silver_price_daily"""))
def q_stream_silver_merge_price(spark, sf_dir):
    """Price snapshots merged into Silver (newest run per ticker and day) in
    two micro-batch runs, the later run first; equals the batch rebuild."""
    base = _workdir(spark, "silver-merge-price")
    landing, silver_dir, ckpt = f"{base}/landing", f"{base}/silver", f"{base}/_ckpt"
    for part in reversed(_runs(_rows(spark, sf_dir, "price"))):
        stream.write_landing(part, landing, by=("part",))
        stream.stream_silver_merge(spark, landing, "price", silver_dir, ckpt)
    return stream.read_silver(spark, silver_dir, "price").select(*PRICE_SILVER_COLS)
