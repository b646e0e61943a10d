"""Registered queries: contract tracker (history, bars, overrides, EMA, OI
change) and the contract verification reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from chainlake.operators import tracker
from chainlake.plans.catalog import register
from chainlake.plans.oracle import f, sql
from chainlake.plans.tables import Tables
from chainlake.sources import fixtures

TIMEFRAME_DAYS = tracker.TIMEFRAMES["1W"]

HIST = ("contractSymbol, snapshot_time, lastPrice, impliedVolatility, delta, theta, gamma, "
        "volume, openInterest")
MKT = "hour(snapshot_time) BETWEEN 9 AND 18"

OHLC_SQL = """
ohlc_agg AS (
  SELECT contractSymbol, CAST(snapshot_time AS DATE) AS "date",
    arg_min(lastPrice, (snapshot_time, _source_file)) FILTER (WHERE hour(snapshot_time) < 12) AS o_,
    arg_max(lastPrice, (snapshot_time, _source_file)) FILTER (WHERE hour(snapshot_time) >= 12) AS c_,
    arg_max(openInterest, (snapshot_time, _source_file)) FILTER (WHERE openInterest IS NOT NULL) AS oi
  FROM bronze_options_raw WHERE lastPrice > 0 AND impliedVolatility > 0.01
  GROUP BY 1, 2),
ohlc AS (
  SELECT contractSymbol, "date", coalesce(o_, c_) AS "open",
         greatest(coalesce(o_, c_), coalesce(c_, o_)) AS high,
         least(coalesce(o_, c_), coalesce(c_, o_)) AS low, coalesce(c_, o_) AS "close", oi
  FROM ohlc_agg),
ov_ok AS (SELECT * FROM override_log WHERE NOT coalesce(high < low, FALSE)),
ov_latest AS (
  SELECT symbol, "date", high, low, updated_at FROM (
    SELECT *, row_number() OVER (PARTITION BY symbol, "date"
           ORDER BY updated_at DESC NULLS LAST, high DESC NULLS LAST, low DESC NULLS LAST) AS rn
    FROM ov_ok) WHERE rn = 1)"""


def _t(spark, sf_dir):
    return Tables(spark, sf_dir)


def _accepted_overrides(spark, sf_dir):
    ok, _ = tracker.validate_overrides(fixtures.override_log(spark, sf_dir))
    return tracker.latest_overrides(ok)


@register("contract_history", sql(f"SELECT {HIST} FROM bronze_options_raw WHERE {MKT}"))
def q_contract_history(spark, sf_dir):
    return tracker.contract_history(_t(spark, sf_dir).bronze_options(), "lastPrice")


@register("daily_latest", sql(f"""
SELECT {HIST} FROM bronze_options_raw b
WHERE {MKT} AND impliedVolatility IS NOT NULL
  AND snapshot_time = (SELECT max(b2.snapshot_time) FROM bronze_options_raw b2
                       WHERE b2.contractSymbol = b.contractSymbol
                         AND CAST(b2.snapshot_time AS DATE) = CAST(b.snapshot_time AS DATE)
                         AND hour(b2.snapshot_time) BETWEEN 9 AND 18)"""))
def q_daily_latest(spark, sf_dir):
    return tracker.contract_history(_t(spark, sf_dir).bronze_options(), "impliedVolatility")


@register("timeframe", sql(f"""
SELECT {HIST} FROM (
  SELECT *, max(snapshot_time) OVER (PARTITION BY contractSymbol) AS mx
  FROM bronze_options_raw WHERE {MKT})
WHERE snapshot_time >= mx - INTERVAL {TIMEFRAME_DAYS} DAY"""))
def q_timeframe(spark, sf_dir):
    h = tracker.contract_history(_t(spark, sf_dir).bronze_options(), "lastPrice")
    return tracker.last_days(h, TIMEFRAME_DAYS)


@register("ohlc", sql("SELECT * FROM ohlc", extra=OHLC_SQL))
def q_ohlc(spark, sf_dir):
    return tracker.ohlc(_t(spark, sf_dir).bronze_options())


@register("candle_direction", sql("""
SELECT contractSymbol, "date", "open", "close",
       CASE WHEN "close" >= "open" THEN 'up' ELSE 'down' END AS direction FROM ohlc""", extra=OHLC_SQL))
def q_candle_direction(spark, sf_dir):
    b = tracker.candles(tracker.ohlc(_t(spark, sf_dir).bronze_options()))
    return b.select("contractSymbol", "date", "open", "close", "direction")


def _ema_sql() -> str:
    a = [2.0 / (s + 1) for s in tracker.EMA_SPANS]
    cols = ", ".join(f"round(e{s}, 8) AS ema_{s}" for s in tracker.EMA_SPANS)
    first = ", ".join(f'"close" AS e{s}' for s in tracker.EMA_SPANS)
    step = ", ".join(f'({f(1 - al)} * r.e{s} + {f(al)} * i."close") / ({f(1 - al)} + {f(al)})'
                     for s, al in zip(tracker.EMA_SPANS, a))
    return f"""
ema_in AS (SELECT contractSymbol, "date", "close",
                  row_number() OVER (PARTITION BY contractSymbol ORDER BY "date") AS rn FROM ohlc),
ema_rec AS (
  SELECT contractSymbol, "date", "close", rn, {first} FROM ema_in WHERE rn = 1
  UNION ALL
  SELECT i.contractSymbol, i."date", i."close", i.rn, {step}
  FROM ema_rec r JOIN ema_in i ON i.contractSymbol = r.contractSymbol AND i.rn = r.rn + 1),
ema_out AS (SELECT contractSymbol, "date", "close", {cols} FROM ema_rec)"""


@register("ema", sql("SELECT * FROM ema_out", extra=OHLC_SQL + "," + _ema_sql(), recursive=True))
def q_ema(spark, sf_dir):
    e = tracker.ema(tracker.ohlc(_t(spark, sf_dir).bronze_options()))
    return e.select("contractSymbol", "date", "close",
                    *[F.round(f"ema_{s}", 8).alias(f"ema_{s}") for s in tracker.EMA_SPANS])


def _frames_sql() -> str:
    frames = ", ".join(f"('{k}', {'NULL' if d is None else d})" for k, d in tracker.TIMEFRAMES.items())
    a = [2.0 / (s + 1) for s in tracker.EMA_SPANS]
    first = ", ".join(f'"close" AS e{s}' for s in tracker.EMA_SPANS)
    step = ", ".join(f'({f(1 - al)} * r.e{s} + {f(al)} * i."close") / ({f(1 - al)} + {f(al)})' for s, al in zip(tracker.EMA_SPANS, a))
    return f"""
frames(timeframe, days) AS (VALUES {frames}),
cut AS (SELECT o.contractSymbol, timeframe, o."date", o."close" FROM
          (SELECT *, max("date") OVER (PARTITION BY contractSymbol) AS top FROM ohlc) o, frames
        WHERE days IS NULL OR o."date" >= o.top - CAST(days AS INTEGER)),
tf_in AS (SELECT *, row_number() OVER (PARTITION BY contractSymbol, timeframe ORDER BY "date") AS rn FROM cut),
tf_rec AS (
  SELECT contractSymbol, timeframe, "date", "close", rn, {first} FROM tf_in WHERE rn = 1
  UNION ALL
  SELECT i.contractSymbol, i.timeframe, i."date", i."close", i.rn, {step}
  FROM tf_rec r JOIN tf_in i ON i.contractSymbol = r.contractSymbol AND i.timeframe = r.timeframe AND i.rn = r.rn + 1)"""


@register("ema_timeframes", sql(f"""
SELECT contractSymbol, timeframe, "date", "close", {", ".join(f"round(e{s}, 8) AS ema_{s}" for s in tracker.EMA_SPANS)}
FROM tf_rec""", extra=OHLC_SQL + "," + _frames_sql(), recursive=True))
def q_ema_timeframes(spark, sf_dir):
    """The averages of all five timeframes, each begun at its first bar."""
    e = tracker.ema_timeframes(tracker.ohlc(_t(spark, sf_dir).bronze_options()))
    return e.select("contractSymbol", "timeframe", "date", "close",
                    *[F.round(f"ema_{s}", 8).alias(f"ema_{s}") for s in tracker.EMA_SPANS])


@register("oi_change", sql("""
SELECT contractSymbol, snapshot_time, volume, openInterest, lag(openInterest) OVER w AS oi_prev,
       openInterest - lag(openInterest) OVER w AS oi_change,
       CASE WHEN coalesce(openInterest - lag(openInterest) OVER w, 0) >= 0 THEN 'up' ELSE 'down' END
         AS oi_direction
FROM bronze_options_raw WHERE hour(snapshot_time) >= 15
WINDOW w AS (PARTITION BY contractSymbol ORDER BY snapshot_time, _source_file)"""))
def q_oi_change(spark, sf_dir):
    return tracker.oi_change(_t(spark, sf_dir).bronze_options())


@register("trackable", sql("""
SELECT ticker, contractSymbol, expiry, option_type, strike, count(DISTINCT snapshot_str) AS snapshots
FROM bronze_options_raw GROUP BY 1, 2, 3, 4, 5 HAVING count(DISTINCT snapshot_str) >= 2"""))
def q_trackable(spark, sf_dir):
    return tracker.trackable(_t(spark, sf_dir).bronze_options(), 2)


@register("contract_summary", sql("""
SELECT ticker, contractSymbol, CAST(expiry AS VARCHAR) AS expiry, option_type, strike,
       count(DISTINCT snapshot_str) AS snapshots, round(min(lastPrice), 2) AS price_min,
       round(max(lastPrice), 2) AS price_max, CAST(round(CAST(avg(CAST(impliedVolatility * 100 AS DECIMAL(24, 10))) AS DECIMAL(24, 10)), 2) AS DOUBLE)
         AS iv_avg_pct,
       CAST(round(CAST(avg(CAST(delta AS DECIMAL(24, 10))) AS DECIMAL(24, 10)), 3) AS DOUBLE) AS delta_avg
FROM bronze_options_raw WHERE lastPrice > 0 AND impliedVolatility > 0.01
GROUP BY 1, 2, 3, 4, 5 HAVING count(DISTINCT snapshot_str) >= 3"""))
def q_contract_summary(spark, sf_dir):
    return tracker.contract_summary(_t(spark, sf_dir).bronze_options(), 3)


@register("contract_detail", sql("""
SELECT contractSymbol, snapshot_time, round_even(lastPrice * 100.0, 0) / 100.0 AS last_price,
       round_even(impliedVolatility * 100 * 100.0, 0) / 100.0 AS iv_pct,
       round_even(delta * 10000.0, 0) / 10000.0 AS delta, round_even(gamma * 10000.0, 0) / 10000.0 AS gamma,
       round_even(theta * 10000.0, 0) / 10000.0 AS theta, volume, openInterest, bid, ask
FROM bronze_options_raw WHERE lastPrice > 0 AND impliedVolatility > 0.01"""))
def q_contract_detail(spark, sf_dir):
    return tracker.contract_detail(_t(spark, sf_dir).bronze_options())


@register("contract_detail_footer", sql("""
SELECT contractSymbol, min(lastPrice) AS price_min, max(lastPrice) AS price_max, count(*) AS snapshots
FROM bronze_options_raw WHERE lastPrice > 0 AND impliedVolatility > 0.01 GROUP BY 1"""))
def q_contract_detail_footer(spark, sf_dir):
    return tracker.contract_detail_footer(_t(spark, sf_dir).bronze_options())


@register("lifetime_high_low", sql(f"""
SELECT contractSymbol, max(lastPrice) FILTER (WHERE lastPrice > 0 AND {MKT}) AS contract_high,
       min(lastPrice) FILTER (WHERE lastPrice > 0 AND {MKT}) AS contract_low
FROM bronze_options_raw GROUP BY 1"""))
def q_lifetime_high_low(spark, sf_dir):
    return tracker.high_low(_t(spark, sf_dir).bronze_options())


@register("current_greeks", sql(f"""
SELECT contractSymbol, arg_max_null(delta, (snapshot_time, _source_file)) AS delta,
       arg_max_null(theta, (snapshot_time, _source_file)) AS theta,
       arg_max_null(gamma, (snapshot_time, _source_file)) AS gamma, max(snapshot_time) AS snapshot_time
FROM bronze_options_raw WHERE {MKT} GROUP BY 1"""))
def q_current_greeks(spark, sf_dir):
    return tracker.current_greeks(_t(spark, sf_dir).bronze_options())


@register("dq_override", sql("SELECT * FROM override_log WHERE high < low"))
def q_dq_override(spark, sf_dir):
    _, rejected = tracker.validate_overrides(fixtures.override_log(spark, sf_dir))
    return rejected


@register("override_upsert", sql("SELECT * FROM ov_latest", extra=OHLC_SQL))
def q_override_upsert(spark, sf_dir):
    return _accepted_overrides(spark, sf_dir)


@register("override_list", sql("""
SELECT symbol, "date", high, low, round(high - low, 2) AS "range", updated_at FROM ov_latest""",
                               extra=OHLC_SQL))
def q_override_list(spark, sf_dir):
    return tracker.list_overrides(_accepted_overrides(spark, sf_dir))


OVERRIDDEN_SQL = """
SELECT o.contractSymbol, o."date", o."open", coalesce(v.high, o.high) AS high,
       coalesce(v.low, o.low) AS low, o."close", o.oi,
       (v.high IS NOT NULL OR v.low IS NOT NULL) AS overridden{extra}
FROM {src} o LEFT JOIN ov_latest v ON v.symbol = o.contractSymbol AND v."date" = o."date" """


@register("override_join", sql(OVERRIDDEN_SQL.format(extra="", src="ohlc"), extra=OHLC_SQL))
def q_override_join(spark, sf_dir):
    bars = tracker.ohlc(_t(spark, sf_dir).bronze_options())
    return tracker.apply_overrides(bars, _accepted_overrides(spark, sf_dir), scope="all")


@register("today_ohlc", sql(OVERRIDDEN_SQL.format(
    extra=""",
       o."close" - o."open" AS change, coalesce(v.high, o.high) - o."open" AS high_vs_open,
       coalesce(v.low, o.low) - o."open" AS low_vs_open""",
    src="""(SELECT * FROM ohlc WHERE ("date") IN (
              SELECT max(x."date") FROM ohlc x WHERE x.contractSymbol = ohlc.contractSymbol))"""),
    extra=OHLC_SQL))
def q_today_ohlc(spark, sf_dir):
    bars = tracker.ohlc(_t(spark, sf_dir).bronze_options())
    return tracker.today_ohlc(bars, _accepted_overrides(spark, sf_dir))


@register("days_with_sides", sql("""
SELECT contractSymbol, CAST(snapshot_time AS DATE) AS "date",
       count(*) FILTER (WHERE hour(snapshot_time) < 12) AS am_rows,
       count(*) FILTER (WHERE hour(snapshot_time) >= 12) AS pm_rows
FROM bronze_options_raw GROUP BY 1, 2"""))
def q_days_with_sides(spark, sf_dir):
    return tracker.days_with_sides(_t(spark, sf_dir).bronze_options())
