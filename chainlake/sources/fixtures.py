"""Bronze-shaped views over the driver's generic tables.

The reference ingests option-chain and price snapshots; the test harness
ships ``events`` and ``orders`` instead.  These functions derive Bronze
tables of the reference's schema from them (one option row per ``events``
row, price bars by half-day, a daily price history from ``orders``) so every
operator downstream runs on data whose size grows with the given tables.

All derivations are declarative DataFrame code: aggregates are partial
(map-side) and the only joins are against small aggregated sides that AQE
broadcasts after measuring them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chainlake.functions.pricing import time_to_expiry, with_greeks
from chainlake.functions.util import lit_date, null_double
from chainlake.sources.ingest import normalize_itm

# Fixed values of the fixture definitions (shared with the SQL oracle).
FIRST_EXPIRY = "2024-01-15"
AS_OF_DATE = "2024-01-31"
AS_OF_TS = "2024-01-31 10:30:00"
TICKERS = ("TKA", "TKB")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _ticker_of(user_id) -> F.Column:
    return F.when(user_id % 3 == 0, F.lit("TKB")).otherwise(F.lit("TKA"))


def options_landing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Option snapshot rows as the collector writes them (``inTheMoney`` as
    text, no theta/vega yet, run clock per (ticker, day, hour))."""
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "value")
    eid, uid, v = F.col("event_id"), F.col("user_id"), F.col("value")
    rows = ev.select(
        F.concat(F.lit("C"), uid.cast("string")).alias("contractSymbol"),
        F.date_add(lit_date(FIRST_EXPIRY), ((uid % 9) * 20).cast("int")).alias("expiry"),
        F.when(uid % 2 == 0, "call").otherwise("put").alias("option_type"),
        (F.lit(35) + uid % 31).cast("double").alias("strike"),
        (v * 0.98).alias("bid"),
        (v * F.when(eid % 50 == 0, 0.90).otherwise(1.02)).alias("ask"),
        v.alias("lastPrice"),
        F.when(eid % 17 == 0, None).otherwise((eid * 37) % 400).cast("long").alias("volume"),
        F.when(eid % 23 == 0, None).otherwise((eid * 101) % 3000).cast("long").alias("openInterest"),
        (F.when(eid % 29 == 0, 0).otherwise(30 + (eid * 13) % 100).cast("double") / 200)
        .alias("impliedVolatility"),
        (F.when(eid % 31 == 0, None)
         .when(uid % 2 == 0, eid % 100).otherwise(-(eid % 100)).cast("double") / 100).alias("delta"),
        (F.when(eid % 31 == 0, None).otherwise(eid % 50).cast("double") / 1000).alias("gamma"),
        F.when(eid % 4 == 0, "True").when(eid % 4 == 1, "False")
        .when(eid % 4 == 2, "1.0").alias("inTheMoney"),
        F.col("ts"),
        F.concat(F.col("ts").cast("date").cast("string"), F.lit("_"),
                 F.hour("ts").cast("string")).alias("snapshot_str"),
        F.concat(F.lit("F"), eid.cast("string")).alias("_source_file"),
        _ticker_of(uid).alias("ticker"),
    )
    # One run clock per (ticker, day, hour): a partial aggregate down to at
    # most tickers x hours rows, joined back (broadcast by AQE once measured).
    keys = ["ticker", "_d", "_h"]
    rows = rows.withColumn("_d", F.col("ts").cast("date")).withColumn("_h", F.hour("ts"))
    runs = rows.groupBy(*keys).agg(F.max("ts").alias("snapshot_time"))
    return rows.join(runs, keys, "left").drop("_d", "_h", "ts")


def bronze_price_raw(spark: SparkSession, sf_dir: str, with_hv: bool = True) -> DataFrame:
    """Price bars per (ticker, day, AM/PM half) from ``events``."""
    from chainlake.operators.prices import hv

    ev = table(spark, sf_dir, "events").select("ts", "user_id", "value")
    half = F.when(F.hour("ts") < 12, "AM").otherwise("PM")
    bars = (ev.groupBy(F.col("ts").cast("date").alias("Date"),
                       _ticker_of(F.col("user_id")).alias("ticker"),
                       half.alias("snapshot_str"))
            .agg(F.min("value").alias("Low"), F.max("value").alias("High"),
                 (F.lit(45.0) + F.avg("value") / 10).alias("Close"),
                 F.count(F.lit(1)).alias("Volume"),
                 F.max("ts").alias("snapshot_time")))
    bars = bars.withColumn("Open", F.col("Close"))
    if with_hv:
        bars = hv(bars, order_by=("snapshot_time",))
    else:
        bars = bars.withColumn("HV_20", null_double()).withColumn("HV_252", null_double())
    return bars.select(
        "Date", "Open", "High", "Low", "Close", "Volume", "HV_20", "HV_252",
        "snapshot_time", "snapshot_str", "ticker",
        F.concat_ws("_", F.lit("P"), "ticker", F.col("Date").cast("string"),
                    "snapshot_str").alias("_source_file"))


def priced_landing(spark: SparkSession, sf_dir: str, market_tz: str = "UTC") -> DataFrame:
    """Landing rows with theta/vega priced from the newest spot of each
    ticker (what the collector writes to CSV; ``inTheMoney`` still text)."""
    from chainlake.operators.silver import silver_price, spot

    land = options_landing(spark, sf_dir)
    px = spot(silver_price(bronze_price_raw(spark, sf_dir, with_hv=False)))
    priced = land.join(px.select("ticker", F.col("spot").alias("_spot")),
                       "ticker", "left")
    priced = with_greeks(priced, "_spot", "strike", "impliedVolatility", "option_type",
                         time_to_expiry("expiry", "snapshot_time", market_tz), prefix="_g_")
    return priced.withColumnRenamed("_g_theta", "theta").withColumnRenamed("_g_vega", "vega") \
        .drop("_g_delta", "_g_gamma", "_spot")


def bronze_options_raw(spark: SparkSession, sf_dir: str, market_tz: str = "UTC") -> DataFrame:
    """Bronze option rows: landing rows with ``inTheMoney`` normalised and
    theta/vega priced from the newest spot of each ticker."""
    priced = priced_landing(spark, sf_dir, market_tz)
    return priced.select(
        "contractSymbol", "expiry", "option_type", "strike", "bid", "ask", "lastPrice",
        "volume", "openInterest", "impliedVolatility", "delta", "gamma", "theta", "vega",
        normalize_itm("inTheMoney").alias("inTheMoney"),
        "snapshot_time", "snapshot_str", "ticker", "_source_file")


def options_csv_rows(spark: SparkSession, sf_dir: str, with_part: bool = False) -> DataFrame:
    """Rows of the option snapshot CSV files in landing layout: integer
    fields written as doubles (``12.0``) and the flag as text.

    ``with_part`` adds the landing sub-folder of each row, ``part``: a
    collection run writes a contract once per file, so of the events of one
    contract and run the k-th goes to part k, and the file settles their order
    as the source id does in the derived Bronze."""
    from chainlake.sources.schemas import OPTIONS_CSV

    p = priced_landing(spark, sf_dir)
    cols = [F.col(f.name).cast("double").alias(f.name) if f.name in ("volume", "openInterest") else F.col(f.name)
            for f in OPTIONS_CSV.fields]
    if with_part:
        run = Window.partitionBy("contractSymbol", "snapshot_time", "snapshot_str").orderBy("_source_file")
        cols.append(F.concat(F.lit("r"), F.lpad(F.row_number().over(run).cast("string"), 4, "0")).alias("part"))
    return p.select(*cols)


def price_csv_rows(spark: SparkSession, sf_dir: str, with_part: bool = False) -> DataFrame:
    """Rows of the price snapshot CSV files (Volume written as double);
    ``with_part``: one landing sub-folder per ticker and half day."""
    from chainlake.sources.schemas import PRICE_CSV

    b = bronze_price_raw(spark, sf_dir)
    cols = [F.col(f.name).cast("double").alias(f.name) if f.name == "Volume" else F.col(f.name)
            for f in PRICE_CSV.fields]
    return b.select(*cols, *([F.concat_ws("_", "ticker", "snapshot_str").alias("part")] if with_part else []))


def price_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily close series per ticker from ``orders`` (long enough for the
    252-row volatility window)."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice", "o_orderdate")
    return (o.groupBy(F.col("o_orderdate").cast("date").alias("Date"),
                      F.when(F.col("o_custkey") % 2 == 0, "TKA").otherwise("TKB").alias("ticker"))
            .agg((F.avg("o_totalprice") / 1000).alias("Close")))


def override_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Append-only log of manual OHLC overrides: one per option snapshot, its
    quoted ask and bid (several writes per contract-day; crossed quotes give
    high < low, which validation rejects)."""
    land = options_landing(spark, sf_dir)
    return land.select(
        F.col("contractSymbol").alias("symbol"), F.to_date("snapshot_time").alias("date"),
        F.col("ask").alias("high"), F.col("bid").alias("low"),
        F.col("snapshot_time").alias("updated_at"))


BRONZE_OPTION_COLS = ["contractSymbol", "expiry", "option_type", "strike", "bid", "ask", "lastPrice",
                      "volume", "openInterest", "impliedVolatility", "delta", "gamma", "theta", "vega",
                      "inTheMoney", "snapshot_time", "snapshot_str", "ticker", "_source_file"]
BRONZE_PRICE_COLS = ["Date", "Open", "High", "Low", "Close", "Volume", "HV_20", "HV_252",
                     "snapshot_time", "snapshot_str", "ticker", "_source_file"]
