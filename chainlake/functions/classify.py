"""Scalar classifiers and calendar arithmetic as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chainlake.functions.util import as_col, lit_date, lit_ts, pandas_round

# Thresholds and labels of the reference's classifiers.
PCR_BULLISH_BELOW = 0.7
PCR_NEUTRAL_UPTO = 1.0
IV_REGIMES = ((25, "low"), (50, "moderate"), (75, "elevated"))
IV_REGIME_TOP = "high"
ZSCORE_EXPENSIVE = 2.0
DTE_BUCKETS = ((30, "<30d"), (60, "30-60d"), (90, "60-90d"), (120, "90-120d"))
DTE_BUCKET_TOP = "120d+"
STALE_HOURS = 24
WARN_HOURS = 8
MARKET_HOURS = (9, 18)
PM_FROM_HOUR = 15


def market_hours(ts, lo: int = MARKET_HOURS[0], hi: int = MARKET_HOURS[1]) -> Column:
    """HOUR(ts) BETWEEN lo AND hi (admits up to hi:59:59)."""
    return F.hour(as_col(ts)).between(lo, hi)


def pm_only(ts, from_hour: int = PM_FROM_HOUR) -> Column:
    return F.hour(as_col(ts)) >= from_hour


def pcr_class(ratio) -> Column:
    r = as_col(ratio)
    return (F.when(r < PCR_BULLISH_BELOW, "bullish")
            .when(r <= PCR_NEUTRAL_UPTO, "neutral")
            .when(r.isNotNull(), "bearish"))


def iv_regime(rank_pct) -> Column:
    """Regime of an IV rank given in percent (0..100); upper bounds strict."""
    x = as_col(rank_pct)
    out = None
    for bound, label in IV_REGIMES:
        out = F.when(x < bound, label) if out is None else out.when(x < bound, label)
    return out.when(x.isNotNull(), IV_REGIME_TOP)


def zscore_label(z) -> Column:
    x = as_col(z)
    return (F.when(x > ZSCORE_EXPENSIVE, "Expensive")
            .when(x < -ZSCORE_EXPENSIVE, "Cheap")
            .when(x.isNotNull(), "Normal"))


def dte_calendar(expiry, as_of_date) -> Column:
    """Calendar days from ``as_of_date`` to expiry."""
    return F.datediff(as_col(expiry), lit_date(as_of_date)).cast("long")


def dte_elapsed(expiry, as_of_ts) -> Column:
    """floor((expiry midnight - as_of instant) / 1 day): one less than the
    calendar count whenever ``as_of`` is past midnight."""
    micros = F.timestamp_diff("MICROSECOND", lit_ts(as_of_ts),
                              as_col(expiry).cast("date").cast("timestamp_ntz"))
    return F.floor(micros / F.lit(86400 * 1_000_000)).cast("long")


def dte_bucket(days) -> Column:
    d = as_col(days)
    out = None
    for bound, label in DTE_BUCKETS:
        out = F.when(d < bound, label) if out is None else out.when(d < bound, label)
    return out.when(d.isNotNull(), DTE_BUCKET_TOP)


def flow_ratio(num, den, digits: int = 2) -> Column:
    """NULL -> 0 on both sides, zero denominator -> 0, rounded as pandas does."""
    n = F.coalesce(as_col(num), F.lit(0)).cast("double")
    d = F.coalesce(as_col(den), F.lit(0)).cast("double")
    return F.coalesce(pandas_round(n / F.when(d != 0, d), digits), F.lit(0.0))


def freshness(hours_ago) -> Column:
    h = as_col(hours_ago)
    return (F.when(h > STALE_HOURS, "stale").when(h > WARN_HOURS, "warning")
            .when(h.isNotNull(), "ok"))


def hours_between(later, earlier) -> Column:
    micros = F.timestamp_diff("MICROSECOND", as_col(earlier).cast("timestamp_ntz"),
                              as_col(later).cast("timestamp_ntz"))
    return micros / F.lit(3600.0 * 1_000_000)


def candle_direction(open_, close) -> Column:
    return F.when(as_col(close) >= as_col(open_), "up").when(
        as_col(close).isNotNull() & as_col(open_).isNotNull(), "down")
