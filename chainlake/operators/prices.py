"""Price-series operators: cleaning and historical volatility."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chainlake.functions.pricing import RISK_FREE, time_to_expiry, with_greeks
from chainlake.functions.util import pandas_round, safe_div

PRICE_COLS = ("Open", "High", "Low", "Close")
TRADING_DAYS = 252


def clean_price(df: DataFrame, date_col: str = "Date") -> DataFrame:
    """Date -> DATE, OHLC rounded to 2 the way pandas rounds, corporate
    action columns dropped if present."""
    out = df.withColumn(date_col, F.to_date(F.col(date_col)))
    for c in PRICE_COLS:
        if c in out.columns:
            out = out.withColumn(c, pandas_round(F.col(c), 2))
    return out.drop("Dividends", "Stock Splits")


def hv(df: DataFrame, windows=(20, 252), partition_by=("ticker",),
       order_by=("Date",), close: str = "Close") -> DataFrame:
    """Annualised rolling sample stddev of log returns, rounded to 4.

    A value exists only once the window holds ``n`` returns (the first at row
    ``n + 1`` of a series).  The window is partitioned per ticker; price
    tables are one row per ticker and day, so a partition is a few thousand
    rows even over decades.  A return from or to a close of zero is NULL, and
    so are the values of the windows that hold it.
    """
    w = Window.partitionBy(*partition_by).orderBy(*order_by)
    out = df.withColumn("_lr", F.log(safe_div(F.col(close), F.lag(close).over(w))))
    for n in windows:
        frame = w.rowsBetween(-(n - 1), Window.currentRow)
        vol = F.stddev_samp("_lr").over(frame) * math.sqrt(TRADING_DAYS)
        out = out.withColumn(f"HV_{n}", F.when(F.count("_lr").over(frame) == n, pandas_round(vol, 4)))
    return out.drop("_lr")


def greeks(opts: DataFrame, px: DataFrame, r: float = RISK_FREE, as_of="snapshot_time",
           market_tz: str = "America/New_York") -> DataFrame:
    """Black-Scholes delta, gamma, theta, vega for every option row, priced
    from its ticker's newest close (one row per ticker, broadcast) with time
    to the 16:00 ``market_tz`` close of expiry, measured from ``as_of`` (a
    column, default the snapshot's own time).  Native expressions only."""
    from chainlake.operators.silver import spot

    s = spot(px).select("ticker", F.col("spot").alias("_spot"))
    j = opts.join(s, "ticker", "left")
    t = time_to_expiry("expiry", as_of, market_tz)
    return with_greeks(j, "_spot", "strike", "impliedVolatility", "option_type", t, r).drop("_spot")
