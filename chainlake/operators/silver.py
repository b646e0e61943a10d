"""Silver layer: newest valid row per key, and the joins to spot price.

Top-1 per key uses ``row_number() = 1``; Spark plans a partial
``WindowGroupLimit`` on the map side, so even a key holding a third of all
rows arrives at the shuffle as at most one row per input partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


# Newest-row order.  The reference orders by snapshot_time only; ties are
# broken by run id, then source file, all descending, so results are
# deterministic.
NEWEST_COLS = ("snapshot_time", "snapshot_str", "_source_file")


def newest_order(cols=NEWEST_COLS):
    return [F.col(c).desc_nulls_last() for c in cols]

SILVER_PRICE_COLS = ["Date", "ticker", "Open", "High", "Low", "Close", "Volume", "HV_20",
                     "HV_252", "snapshot_time", "snapshot_str"]
SILVER_OPTION_COLS = ["contractSymbol", "expiry", "option_type", "strike", "bid", "ask",
                      "lastPrice", "volume", "openInterest", "impliedVolatility", "delta",
                      "gamma", "theta", "vega", "inTheMoney", "snapshot_time", "snapshot_str",
                      "ticker", "_source_file"]


def newest_per_key(df: DataFrame, keys, order=None) -> DataFrame:
    """One row per ``keys``: the first under ``order`` (default: newest
    snapshot, ties by run id then source file)."""
    w = Window.partitionBy(*keys).orderBy(*(order if order is not None else newest_order()))
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def silver_price(bronze_price: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Newest snapshot per (ticker, Date); rows missing a critical field are
    removed before ranking.  ``keep``: further columns to return, such as the
    source file, which breaks ties in a later merge."""
    ok = bronze_price.filter(F.col("ticker").isNotNull() & F.col("Date").isNotNull()
                             & F.col("Close").isNotNull() & F.col("snapshot_time").isNotNull())
    order = newest_order(NEWEST_COLS if "_source_file" in bronze_price.columns else NEWEST_COLS[:2])
    return newest_per_key(ok, ["ticker", "Date"], order).select(*SILVER_PRICE_COLS, *keep)


def valid_quote(bid="bid", ask="ask"):
    """Quote is usable unless both sides exist and are crossed."""
    b, a = F.col(bid), F.col(ask)
    return b.isNull() | a.isNull() | (a >= b)


def silver_options(bronze_options: DataFrame) -> DataFrame:
    """Newest valid snapshot per contract: crossed quotes are removed
    before ranking, so an older valid row survives."""
    return newest_per_key(bronze_options.filter(valid_quote()), ["contractSymbol"]) \
        .select(SILVER_OPTION_COLS)


def spot(px: DataFrame) -> DataFrame:
    """Newest close per ticker with its date and HV: one row per ticker.

    A grouped ``max_by`` (partial aggregation before the shuffle) rather than
    a window over ``ticker``, which would put a whole ticker in one task.
    """
    newest = F.max_by(F.struct("Date", "Close", "HV_20", "HV_252"), F.col("Date"))
    return (px.groupBy("ticker").agg(newest.alias("_n"))
            .select("ticker", F.col("_n.Date").alias("price_date"),
                    F.col("_n.Close").alias("spot"),
                    F.col("_n.HV_20").alias("HV_20"), F.col("_n.HV_252").alias("HV_252")))


def latest_snapshot(latest: DataFrame, px: DataFrame) -> DataFrame:
    """Each latest option joined to its ticker's newest price row (left:
    a ticker without prices keeps NULLs).  The price side is one row per
    ticker -- bounded by the number of underlyings, so it is broadcast."""
    s = spot(px)
    j = latest.join(s, "ticker", "left")
    return j.select(
        "contractSymbol", "expiry", "option_type", "strike", "bid", "ask",
        F.col("lastPrice").alias("option_last"), "volume", "openInterest",
        F.col("impliedVolatility").alias("iv"), "delta", "gamma", "theta", "vega",
        "inTheMoney", F.col("snapshot_time").alias("options_snapshot_time"), "ticker",
        "price_date", F.col("spot").alias("price_close"), "HV_20", "HV_252")
