"""Registered queries: the reports that the reference sorts, with the number
of each row in that order, so that the order itself is compared; and modes of
the dashboard pages that no other query takes."""

from __future__ import annotations

from pyspark.sql import functions as F

from chainlake.functions.util import lit_date
from chainlake.operators import calendar, chain, gold, tracker
from chainlake.operators.ordering import numbered
from chainlake.plans import q_chain, q_medallion, q_quality, q_tracker  # noqa: F401  (their queries are sorted here)
from chainlake.plans.catalog import ORACLES, QUERIES, register
from chainlake.plans.oracle import sql
from chainlake.plans.tables import Tables

# Report: its order; where that leaves ties, all other columns follow.
SORTED = {
    "greeks_exposure": ("ticker", "expiry", "strike"),
    "contract_detail": ("contractSymbol", "snapshot_time", "last_price", "iv_pct", "delta", "gamma", "theta", "volume",
                        "openInterest", "bid", "ask"),
    "contract_summary": ("ticker", "expiry", "strike", "option_type", "contractSymbol"),
    "health_bronze": ("ticker",),
    "skew": ("ticker", "expiry", "strike", "option_type", "iv", "volume", "vol_share"),
    "term_structure": ("ticker", "expiry"),
    "trackable": ("ticker", "expiry", "strike", "option_type", "contractSymbol"),
    "contract_history": ("contractSymbol", "snapshot_time", "lastPrice", "impliedVolatility", "delta", "theta", "gamma",
                         "volume", "openInterest"),
    "ohlc": ("contractSymbol", "date"),
    "oi_change": ("contractSymbol", "snapshot_time", "volume", "openInterest", "oi_prev", "oi_change", "oi_direction"),
}


def _sorted_sql(body: str, order) -> str:
    by = ", ".join(f'"{c}" ASC NULLS LAST' for c in order)
    return f"SELECT *, row_number() OVER (ORDER BY {by}) AS row_no FROM ({body})"


def _register_sorted(key: str, order) -> None:
    base = QUERIES[key]

    def query(spark, sf_dir):
        return numbered(base(spark, sf_dir), order)
    register(f"{key}_sorted", _sorted_sql(ORACLES[key], order))(query)


for _key, _order in SORTED.items():
    _register_sorted(_key, _order)


@register("pcr_sorted", sql("SELECT *, row_number() OVER (ORDER BY ticker, expiry NULLS LAST) AS row_no FROM gold_pcr", gold=True))
def q_pcr_sorted(spark, sf_dir):
    """The put/call table, the expiries of a ticker before its total."""
    return numbered(gold.pcr(Tables(spark, sf_dir).silver_options()), ("ticker", "expiry"))


# Expiry of the pages that show one.
EXPIRY = "2024-02-24"


@register("skew_one_expiry", _sorted_sql(f"SELECT * FROM ({ORACLES['skew']}) WHERE expiry = DATE '{EXPIRY}'", SORTED["skew"]))
def q_skew_one_expiry(spark, sf_dir):
    g = chain.skew(Tables(spark, sf_dir).gold_latest(), EXPIRY, min_volume=q_chain.SKEW_MIN_VOLUME)
    return numbered(g, SORTED["skew"])


@register("exposure_one_expiry", _sorted_sql(f"SELECT * FROM ({ORACLES['greeks_exposure']}) WHERE expiry = DATE '{EXPIRY}'",
                                             SORTED["greeks_exposure"]))
def q_exposure_one_expiry(spark, sf_dir):
    """Exposure by strike of one expiry: the cut reaches the option rows."""
    opts = Tables(spark, sf_dir).silver_options().filter(F.col("expiry") == lit_date(EXPIRY))
    return numbered(gold.greeks_exposure(opts), SORTED["greeks_exposure"])


METRICS = ("impliedVolatility", "delta", "theta", "gamma")


@register("metric_history", sql("\nUNION ALL\n".join(
    f"SELECT contractSymbol, snapshot_time, '{m}' AS metric, {m} AS value FROM h WHERE {m} IS NOT NULL" for m in METRICS), extra="""
h AS (SELECT * FROM bronze_options_raw b WHERE hour(snapshot_time) BETWEEN 9 AND 18
      AND snapshot_time = (SELECT max(b2.snapshot_time) FROM bronze_options_raw b2
                           WHERE b2.contractSymbol = b.contractSymbol
                             AND CAST(b2.snapshot_time AS DATE) = CAST(b.snapshot_time AS DATE)
                             AND hour(b2.snapshot_time) BETWEEN 9 AND 18))"""))
def q_metric_history(spark, sf_dir):
    """Daily newest value of every metric that the tracker page can draw."""
    return tracker.metric_history(Tables(spark, sf_dir).bronze_options(), METRICS)


def _frames() -> str:
    return ", ".join(f"('{k}', {'NULL' if d is None else d})" for k, d in tracker.TIMEFRAMES.items())


@register("timeframe_all", sql(f"""
SELECT timeframe, contractSymbol, snapshot_time, lastPrice, impliedVolatility, delta, theta, gamma, volume, openInterest
FROM (SELECT *, max(snapshot_time) OVER (PARTITION BY contractSymbol) AS mx
      FROM bronze_options_raw WHERE hour(snapshot_time) BETWEEN 9 AND 18), (VALUES {_frames()}) f(timeframe, days)
WHERE days IS NULL OR snapshot_time >= mx - to_days(CAST(days AS INTEGER))"""))
def q_timeframe_all(spark, sf_dir):
    """History of every contract in all five windows, from one pass."""
    return tracker.all_timeframes(tracker.contract_history(Tables(spark, sf_dir).bronze_options(), "lastPrice"))


# Holidays by another Easter formula and by walking the days of each month.
CALENDAR_SQL = """
y AS (SELECT CAST(unnest(range(1990, 2031)) AS INTEGER) AS y),
e1 AS (SELECT y, y // 100 AS c, y - 19 * (y // 19) AS n FROM y),
e2 AS (SELECT y, c, n, c - c // 4 - (c - (c - 17) // 25) // 3 + 19 * n + 15 AS i0 FROM e1),
e3 AS (SELECT y, c, n, i0 - 30 * (i0 // 30) AS i1 FROM e2),
e4 AS (SELECT y, c, i1 - (i1 // 28) * (1 - (i1 // 28) * (29 // (i1 + 1)) * ((21 - n) // 11)) AS i FROM e3),
e5 AS (SELECT y, i, y + y // 4 + i + 2 - c + c // 4 AS j0 FROM e4),
e6 AS (SELECT y, i - (j0 - 7 * (j0 // 7)) AS l FROM e5),
easter AS (SELECT y, make_date(y, 3 + (l + 40) // 44, l + 28 - 31 * ((3 + (l + 40) // 44) // 4)) AS d FROM e6),
days AS (SELECT CAST(unnest(generate_series(DATE '1990-01-01', DATE '2030-12-31', INTERVAL 1 DAY)) AS DATE) AS d),
nth AS (SELECT d, isodow(d) AS w, month(d) AS m, row_number() OVER (PARTITION BY year(d), month(d), isodow(d) ORDER BY d) AS k,
               row_number() OVER (PARTITION BY year(d), month(d), isodow(d) ORDER BY d DESC) AS back FROM days),
fixed AS (SELECT make_date(y, m, dd) AS d, m FROM y, (VALUES (1, 1), (7, 4), (12, 25)) f(m, dd)),
holidays AS (
  SELECT CASE isodow(d) WHEN 7 THEN d + 1 WHEN 6 THEN d - 1 ELSE d END AS d FROM fixed WHERE NOT (m = 1 AND isodow(d) = 6)
  UNION SELECT d - 2 FROM easter
  UNION SELECT d FROM nth WHERE w = 1 AND ((m IN (1, 2) AND k = 3) OR (m = 5 AND back = 1) OR (m = 9 AND k = 1))
  UNION SELECT d FROM nth WHERE w = 4 AND m = 11 AND k = 4
  UNION SELECT d + 1 FROM nth WHERE w = 4 AND m = 11 AND k = 4)"""


@register("market_calendar", sql("""
SELECT p.day, isodow(p.day) <= 5 AS weekday, h.d IS NOT NULL AS holiday, isodow(p.day) <= 5 AND h.d IS NULL AS is_trading_day
FROM (SELECT DISTINCT "Date" AS day FROM price_history) p LEFT JOIN holidays h ON h.d = p.day""", extra=CALENDAR_SQL))
def q_market_calendar(spark, sf_dir):
    """Trading days of any year by rule."""
    days = Tables(spark, sf_dir).price_history().select(F.col("Date").alias("day")).distinct()
    return calendar.trading_days(days, "day", holidays=None)
