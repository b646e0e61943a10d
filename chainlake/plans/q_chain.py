"""Registered queries: options-chain page (filters, skew, term structure,
exposure by strike, PCR report) and the scalar classifiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from chainlake.functions import classify as C
from chainlake.operators import calendar, chain
from chainlake.plans.catalog import register
from chainlake.plans.oracle import AS_OF_DATE_SQL, AS_OF_TS_SQL, f, sql
from chainlake.plans.tables import Tables
from chainlake.sources.fixtures import AS_OF_DATE, AS_OF_TS

# Registered parameter choices (the page's controls).
CHAIN_SIDE, CHAIN_PCT = "Puts", 20
FLOW_PCT = 30
ZONE = "30-60d"
SKEW_MIN_VOLUME = 50


def _ratio_sql(num: str, den: str) -> str:
    return (f"coalesce(round_even(CAST(coalesce({num}, 0) AS DOUBLE) / "
            f"nullif(CAST(coalesce({den}, 0) AS DOUBLE), 0) * 100.0, 0) / 100.0, 0.0)")


DTE_SQL = f"datediff('day', {AS_OF_DATE_SQL}, expiry)"
RATIOS_SQL = (f"{_ratio_sql('volume', 'openInterest')} AS vol_oi_ratio, "
              f"{_ratio_sql('openInterest', 'volume')} AS oi_vol_ratio")


def _chain_sql(pct: float, extra_where: str = "") -> str:
    lo, hi = 1 - pct / 100, 1 + pct / 100
    return f"""
chain_rows AS (
  SELECT g.*, {DTE_SQL} AS dte, {RATIOS_SQL}
  FROM gold_latest_snapshot g
  WHERE strike BETWEEN price_close * {f(lo)} AND price_close * {f(hi)}
    AND {DTE_SQL} >= 0 {extra_where})"""


def _bucket_sql(d: str) -> str:
    parts = " ".join(f"WHEN {d} < {b} THEN '{lab}'" for b, lab in C.DTE_BUCKETS)
    return f"(CASE {parts} WHEN {d} IS NOT NULL THEN '{C.DTE_BUCKET_TOP}' END)"


def _elapsed_sql(d: str, ts: str) -> str:
    return (f"CAST(floor((epoch_us(CAST({d} AS TIMESTAMP)) - epoch_us({ts})) "
            f"/ CAST(86400000000 AS DOUBLE)) AS BIGINT)")


@register("chain_filter", sql("SELECT * FROM chain_rows",
                              extra=_chain_sql(CHAIN_PCT, "AND option_type = 'put'")))
def q_chain_filter(spark, sf_dir):
    return chain.chain(Tables(spark, sf_dir).gold_latest(), AS_OF_DATE,
                       option_type=CHAIN_SIDE, pct=CHAIN_PCT)


@register("vol_oi_ratio", sql(f"""
SELECT contractSymbol, volume, openInterest, {RATIOS_SQL} FROM gold_latest_snapshot"""))
def q_vol_oi_ratio(spark, sf_dir):
    g = chain.with_ratios(Tables(spark, sf_dir).gold_latest())
    return g.select("contractSymbol", "volume", "openInterest", "vol_oi_ratio", "oi_vol_ratio")


@register("dte_calendar", sql(f"""
SELECT contractSymbol, expiry, {DTE_SQL} AS dte FROM gold_latest_snapshot WHERE {DTE_SQL} >= 0"""))
def q_dte_calendar(spark, sf_dir):
    g = Tables(spark, sf_dir).gold_latest()
    return (g.select("contractSymbol", "expiry", C.dte_calendar("expiry", AS_OF_DATE).alias("dte"))
            .filter(F.col("dte") >= 0))


@register("dte_elapsed", sql(f"""
SELECT DISTINCT ticker, expiry, {DTE_SQL} AS dte_calendar,
       {_elapsed_sql('expiry', AS_OF_TS_SQL)} AS dte_elapsed
FROM gold_latest_snapshot"""))
def q_dte_elapsed(spark, sf_dir):
    g = Tables(spark, sf_dir).gold_latest()
    return g.select("ticker", "expiry", C.dte_calendar("expiry", AS_OF_DATE).alias("dte_calendar"),
                    C.dte_elapsed("expiry", AS_OF_TS).alias("dte_elapsed")).distinct()


@register("dte_bucket", sql(f"""
SELECT ticker, {_bucket_sql(DTE_SQL)} AS dte_zone, count(*) AS n_contracts
FROM gold_latest_snapshot WHERE {DTE_SQL} >= 0 GROUP BY 1, 2"""))
def q_dte_bucket(spark, sf_dir):
    g = Tables(spark, sf_dir).gold_latest()
    d = C.dte_calendar("expiry", AS_OF_DATE)
    return (g.filter(d >= 0).groupBy("ticker", C.dte_bucket(d).alias("dte_zone"))
            .agg(F.count(F.lit(1)).alias("n_contracts")))


def _flow_sql() -> str:
    parts = [f"SELECT ticker, 'all' AS flow, count(*) AS n_contracts FROM chain_rows GROUP BY ticker"]
    for key, col, thr in chain.FLOW_FILTERS:
        parts.append(f"SELECT ticker, '{key}', count(*) FILTER (WHERE {col} > {f(thr)}) "
                     f"FROM chain_rows GROUP BY ticker")
    return "\nUNION ALL\n".join(parts)


@register("flow_filter", sql(_flow_sql(), extra=_chain_sql(FLOW_PCT)))
def q_flow_filter(spark, sf_dir):
    return chain.flow_counts(chain.chain(Tables(spark, sf_dir).gold_latest(), AS_OF_DATE,
                                         pct=FLOW_PCT))


@register("dte_zone_filter", sql(
    f"SELECT * FROM chain_rows WHERE {_bucket_sql('dte')} = '{ZONE}'", extra=_chain_sql(FLOW_PCT)))
def q_dte_zone_filter(spark, sf_dir):
    return chain.chain(Tables(spark, sf_dir).gold_latest(), AS_OF_DATE, pct=FLOW_PCT, zone=ZONE)


@register("skew", sql(f"""
SELECT ticker, expiry, strike, option_type, iv, volume,
       volume / (CASE WHEN mx > 0 THEN mx ELSE 1 END) AS vol_share
FROM (SELECT ticker, expiry, strike, option_type, iv, CAST(coalesce(volume, 0) AS BIGINT) AS volume,
             max(coalesce(volume, 0)) OVER (PARTITION BY ticker, expiry) AS mx
      FROM gold_latest_snapshot WHERE iv > 0)
WHERE volume >= {SKEW_MIN_VOLUME}"""))
def q_skew(spark, sf_dir):
    return chain.skew(Tables(spark, sf_dir).gold_latest(), min_volume=SKEW_MIN_VOLUME)


TERM_SQL = f"""
term_agg AS (
  SELECT ticker, expiry, sum(iv * volume) / nullif(sum(volume), 0) * 100 AS atm_iv,
         CAST(sum(volume) AS BIGINT) AS vol,
         {_elapsed_sql('expiry', AS_OF_TS_SQL)} AS dte
  FROM gold_latest_snapshot
  WHERE iv > 0 AND strike BETWEEN price_close * {f(0.95)} AND price_close * {f(1.05)}
  GROUP BY ticker, expiry HAVING sum(volume) > 10),
term AS (
  SELECT ticker, expiry, atm_iv, vol, dte,
         dte - lag(dte) OVER w AS dte_gap, atm_iv - lag(atm_iv) OVER w AS iv_change
  FROM term_agg WHERE dte BETWEEN 7 AND 540
  WINDOW w AS (PARTITION BY ticker ORDER BY expiry)),
term_slope AS (
  SELECT *, coalesce(iv_change / nullif(dte_gap, 0), 0.0) AS slope FROM term)"""


def _term(spark, sf_dir):
    t = chain.term_structure(Tables(spark, sf_dir).gold_latest(), AS_OF_TS)
    for c in ("atm_iv", "iv_change", "slope"):
        t = t.withColumn(c, F.round(c, 8))
    return t


@register("term_structure", sql("""
SELECT ticker, expiry, round(atm_iv, 8) AS atm_iv, vol, dte, dte_gap, round(iv_change, 8) AS iv_change,
       round(slope, 8) AS slope, CASE WHEN slope >= 0 THEN 'contango' ELSE 'backwardation' END AS shape
FROM term_slope""", extra=TERM_SQL))
def q_term_structure(spark, sf_dir):
    return _term(spark, sf_dir)


@register("term_slope", sql("""
SELECT ticker, expiry, dte_gap, round(slope, 8) AS slope,
       CASE WHEN slope >= 0 THEN 'contango' ELSE 'backwardation' END AS shape
FROM term_slope""", extra=TERM_SQL))
def q_term_slope(spark, sf_dir):
    return _term(spark, sf_dir).select("ticker", "expiry", "dte_gap", "slope", "shape")


# Besides the library's calendar, events and holidays inside the dates of the
# test data, so that both outcomes occur.
EVENTS = chain.DATED_EVENTS + (("Rate decision", "2024-03-20"), ("~Earnings", "2024-04-25"), ("Settlement", "2024-02-01"))
HOLIDAYS = calendar.MARKET_HOLIDAYS + ("1995-07-04", "1996-12-25", "1998-01-01", "1999-11-25", "2000-05-29")


def _events_sql() -> str:
    rows = ", ".join(f"('{n.lstrip('~')}', DATE '{d}', {str(n.startswith('~')).upper()})"
                     for n, d in EVENTS)
    return f"""
ev(event, event_date, estimated) AS (VALUES {rows}),
as_of AS (SELECT ticker, max(snapshot_time) AS as_of FROM bronze_options_raw GROUP BY ticker)"""


@register("event_markers", sql(f"""
SELECT a.ticker, e.event, e.event_date, e.estimated, {_elapsed_sql('e.event_date', 'a.as_of')} AS dte,
       {_elapsed_sql('e.event_date', 'a.as_of')} BETWEEN 7 AND 540 AS shown
FROM as_of a, ev e""", extra=_events_sql()))
def q_event_markers(spark, sf_dir):
    b = Tables(spark, sf_dir).bronze_options()
    as_of = b.groupBy("ticker").agg(F.max("snapshot_time").alias("as_of"))
    return chain.event_markers(as_of, EVENTS)


@register("gex_by_strike", sql(f"""
SELECT e.ticker, e.strike, round(sum(call_gamma_notional) / 1000, 6) AS call_gex_k,
       round(sum(put_gamma_notional) / 1000, 6) AS put_gex_k,
       round(sum(net_gamma_notional) / 1000, 6) AS net_gex_k
FROM gold_greeks_exposure e JOIN spot s ON s.ticker = e.ticker
GROUP BY e.ticker, e.strike, s.spot
HAVING e.strike >= s.spot * {f(0.8)} AND e.strike <= s.spot * {f(1.2)}""", gold=True))
def q_gex_by_strike(spark, sf_dir):
    t = Tables(spark, sf_dir)
    g = chain.gex_by_strike(t.gold_exposure(), t.silver_price())
    return g.select("ticker", "strike", *[F.round(c, 6).alias(c) for c in
                                          ("call_gex_k", "put_gex_k", "net_gex_k")])


@register("pcr_report", sql(f"""
SELECT ticker, expiry, put_volume, call_volume, pcr_volume, CAST(coalesce(put_oi, 0) AS BIGINT) AS put_oi,
       CAST(coalesce(call_oi, 0) AS BIGINT) AS call_oi, coalesce(pcr_oi, 0.0) AS pcr_oi,
       CASE WHEN expiry = 'ALL' THEN 1 ELSE 0 END AS row_order
FROM gold_pcr WHERE expiry = 'ALL' OR TRY_CAST(expiry AS DATE) >= {AS_OF_DATE_SQL}""", gold=True))
def q_pcr_report(spark, sf_dir):
    return chain.pcr_report(Tables(spark, sf_dir).gold_pcr(), AS_OF_DATE)


def _pcr_class_sql(c: str) -> str:
    return (f"CASE WHEN {c} < {C.PCR_BULLISH_BELOW} THEN 'bullish' WHEN {c} <= {C.PCR_NEUTRAL_UPTO} "
            f"THEN 'neutral' WHEN {c} IS NOT NULL THEN 'bearish' END")


@register("pcr_class", sql(f"""
SELECT ticker, expiry, pcr_volume, {_pcr_class_sql('pcr_volume')} AS volume_signal,
       pcr_oi, {_pcr_class_sql('pcr_oi')} AS oi_signal FROM gold_pcr""", gold=True))
def q_pcr_class(spark, sf_dir):
    p = Tables(spark, sf_dir).gold_pcr()
    return p.select("ticker", "expiry", "pcr_volume", C.pcr_class("pcr_volume").alias("volume_signal"),
                    "pcr_oi", C.pcr_class("pcr_oi").alias("oi_signal"))


def _regime_sql(x: str) -> str:
    parts = " ".join(f"WHEN {x} < {b} THEN '{lab}'" for b, lab in C.IV_REGIMES)
    return f"CASE {parts} WHEN {x} IS NOT NULL THEN '{C.IV_REGIME_TOP}' END"


@register("iv_regime", sql(f"""
SELECT ticker, iv_rank * 100 AS rank_pct, {_regime_sql('iv_rank * 100')} AS regime,
       iv_rank * 100 - 50 AS vs_mid FROM gold_iv_rank""", gold=True))
def q_iv_regime(spark, sf_dir):
    r = Tables(spark, sf_dir).gold_iv_rank().withColumn("rank_pct", F.col("iv_rank") * 100)
    return r.select("ticker", "rank_pct", C.iv_regime("rank_pct").alias("regime"),
                    (F.col("rank_pct") - 50).alias("vs_mid"))


@register("zscore_label", sql(f"""
SELECT ticker, iv_zscore, CASE WHEN iv_zscore > 2 THEN 'Expensive' WHEN iv_zscore < -2 THEN 'Cheap'
       WHEN iv_zscore IS NOT NULL THEN 'Normal' END AS label FROM gold_iv_rank""", gold=True))
def q_zscore_label(spark, sf_dir):
    r = Tables(spark, sf_dir).gold_iv_rank()
    return r.select("ticker", "iv_zscore", C.zscore_label("iv_zscore").alias("label"))


@register("market_hours", sql("""
SELECT ticker, hour(snapshot_time) AS hour, hour(snapshot_time) BETWEEN 9 AND 18 AS in_market,
       count(*) AS n_rows FROM bronze_options_raw GROUP BY 1, 2, 3"""))
def q_market_hours(spark, sf_dir):
    b = Tables(spark, sf_dir).bronze_options()
    return (b.groupBy("ticker", F.hour("snapshot_time").cast("long").alias("hour"),
                      C.market_hours("snapshot_time").alias("in_market"))
            .agg(F.count(F.lit(1)).alias("n_rows")))


@register("pm_only", sql("""
SELECT contractSymbol, count(*) AS pm_snapshots, max(snapshot_time) AS last_pm
FROM bronze_options_raw WHERE hour(snapshot_time) >= 15 GROUP BY contractSymbol"""))
def q_pm_only(spark, sf_dir):
    b = Tables(spark, sf_dir).bronze_options().filter(C.pm_only("snapshot_time"))
    return b.groupBy("contractSymbol").agg(F.count(F.lit(1)).alias("pm_snapshots"),
                                           F.max("snapshot_time").alias("last_pm"))


def _holidays_sql() -> str:
    return "hol(d) AS (VALUES " + ", ".join(f"(DATE '{d}')" for d in HOLIDAYS) + ")"


@register("trading_day", sql("""
SELECT d."Date" AS day, isodow(d."Date") <= 5 AS weekday, h.d IS NOT NULL AS holiday,
       isodow(d."Date") <= 5 AND h.d IS NULL AS is_trading_day
FROM (SELECT DISTINCT "Date" FROM price_history) d LEFT JOIN hol h ON h.d = d."Date" """,
                             extra=_holidays_sql()))
def q_trading_day(spark, sf_dir):
    days = Tables(spark, sf_dir).price_history().select(F.col("Date").alias("day")).distinct()
    return calendar.trading_days(days, "day", HOLIDAYS)


@register("freshness", sql(f"""
SELECT ticker, last_snapshot,
       round((epoch_us({AS_OF_TS_SQL}) - epoch_us(last_snapshot)) / CAST(3600000000 AS DOUBLE), 6) AS hours_ago,
       CASE WHEN (epoch_us({AS_OF_TS_SQL}) - epoch_us(last_snapshot)) / CAST(3600000000 AS DOUBLE) > 24 THEN 'stale'
            WHEN (epoch_us({AS_OF_TS_SQL}) - epoch_us(last_snapshot)) / CAST(3600000000 AS DOUBLE) > 8 THEN 'warning'
            WHEN last_snapshot IS NOT NULL THEN 'ok' END AS status
FROM (SELECT ticker, max(snapshot_time) AS last_snapshot FROM bronze_options_raw GROUP BY ticker
      UNION ALL SELECT 'ALL', max(snapshot_time) FROM bronze_options_raw)"""))
def q_freshness(spark, sf_dir):
    return chain.freshness_report(Tables(spark, sf_dir).bronze_options(), AS_OF_TS)


@register("distinct_lists", sql("SELECT DISTINCT ticker, expiry FROM gold_latest_snapshot"))
def q_distinct_lists(spark, sf_dir):
    return Tables(spark, sf_dir).gold_latest().select("ticker", "expiry").distinct()


@register("scalar_max", sql("""
SELECT b.ticker, b.newest_bronze, p.newest_pcr
FROM (SELECT ticker, max(snapshot_time) AS newest_bronze FROM bronze_options_raw GROUP BY ticker
      UNION ALL SELECT 'ALL', max(snapshot_time) FROM bronze_options_raw) b
LEFT JOIN (SELECT ticker, max(snapshot_time) AS newest_pcr FROM gold_pcr GROUP BY ticker
           UNION ALL SELECT 'ALL', max(snapshot_time) FROM gold_pcr) p ON p.ticker = b.ticker""",
                            gold=True))
def q_scalar_max(spark, sf_dir):
    t = Tables(spark, sf_dir)
    b = calendar.newest_with_total(t.bronze_options(), "newest_bronze")
    p = calendar.newest_with_total(t.gold_pcr(), "newest_pcr")
    return b.join(p, "ticker", "left")


@register("chain_ladder", sql(f"""
SELECT ticker, expiry, strike,
  max(CASE WHEN option_type = 'call' THEN iv END) AS call_iv,
  max(CASE WHEN option_type = 'call' THEN option_last END) AS call_last,
  max(CASE WHEN option_type = 'call' THEN volume END) AS call_volume,
  max(CASE WHEN option_type = 'call' THEN openInterest END) AS call_oi,
  max(CASE WHEN option_type = 'put' THEN iv END) AS put_iv,
  max(CASE WHEN option_type = 'put' THEN option_last END) AS put_last,
  max(CASE WHEN option_type = 'put' THEN volume END) AS put_volume,
  max(CASE WHEN option_type = 'put' THEN openInterest END) AS put_oi,
  max(CASE WHEN option_type = 'put' THEN iv END) - max(CASE WHEN option_type = 'call' THEN iv END) AS skew,
  {DTE_SQL} AS dte
FROM gold_latest_snapshot GROUP BY ticker, expiry, strike"""))
def q_chain_ladder(spark, sf_dir):
    return chain.chain_ladder(Tables(spark, sf_dir).gold_latest(), AS_OF_DATE)


@register("oi_vol_ratio", sql(f"""
SELECT contractSymbol, {_ratio_sql('openInterest', 'volume')} AS oi_vol_ratio FROM gold_latest_snapshot"""))
def q_oi_vol_ratio(spark, sf_dir):
    g = chain.with_ratios(Tables(spark, sf_dir).gold_latest())
    return g.select("contractSymbol", "oi_vol_ratio")
