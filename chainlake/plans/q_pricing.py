"""Registered queries: price cleaning, historical volatility, Greeks, time
to expiry, OCC symbols and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from chainlake.functions import occ
from chainlake.functions.pricing import time_to_expiry
from chainlake.operators import prices
from chainlake.plans.catalog import register
from chainlake.plans.oracle import greeks_ctes, hv_sql, sql, tte_sql
from chainlake.plans.tables import Tables

MARKET_TZ = "America/New_York"


@register("clean_price", sql("""
SELECT "Date", ticker, snapshot_str, round_even("Open" * 100.0, 0) / 100.0 AS "Open",
       round_even("High" * 100.0, 0) / 100.0 AS "High", round_even("Low" * 100.0, 0) / 100.0 AS "Low",
       round_even("Close" * 100.0, 0) / 100.0 AS "Close"
FROM bronze_price_raw"""))
def q_clean_price(spark, sf_dir):
    c = prices.clean_price(Tables(spark, sf_dir).bronze_price())
    return c.select("Date", "ticker", "snapshot_str", "Open", "High", "Low", "Close")


@register("hv", sql(f"""
SELECT "Date", ticker, round("Close", 10) AS "Close",
       {hv_sql('"Close"', 'ticker', '"Date"', 20)} AS HV_20,
       {hv_sql('"Close"', 'ticker', '"Date"', 252)} AS HV_252
FROM (SELECT *, ln("Close" / lag("Close") OVER (PARTITION BY ticker ORDER BY "Date")) AS _lr
      FROM price_history)"""))
def q_hv(spark, sf_dir):
    h = prices.hv(Tables(spark, sf_dir).price_history(), order_by=("Date",))
    return h.select("Date", "ticker", F.round("Close", 10).alias("Close"), "HV_20", "HV_252")


@register("greeks", sql("""
SELECT contractSymbol, snapshot_time, g_delta AS delta, g_gamma AS gamma, g_theta AS theta,
       g_vega AS vega FROM opt_greeks""", extra=f"""
opt_spot AS (SELECT o.*, s.spot AS _spot FROM silver_options_latest o LEFT JOIN spot s ON s.ticker = o.ticker),
{greeks_ctes('opt_spot', '_spot', 'opt_greeks', tz=MARKET_TZ)}"""))
def q_greeks(spark, sf_dir):
    t = Tables(spark, sf_dir)
    g = prices.greeks(t.silver_options(), t.silver_price(), market_tz=MARKET_TZ)
    return g.select("contractSymbol", "snapshot_time", "delta", "gamma", "theta", "vega")


@register("time_to_expiry", sql(f"""
SELECT contractSymbol, expiry, snapshot_time, {tte_sql('UTC')} AS t_utc, {tte_sql(MARKET_TZ)} AS t_market
FROM silver_options_latest"""))
def q_time_to_expiry(spark, sf_dir):
    o = Tables(spark, sf_dir).silver_options()
    return o.select("contractSymbol", "expiry", "snapshot_time",
                    time_to_expiry("expiry", "snapshot_time", "UTC").alias("t_utc"),
                    time_to_expiry("expiry", "snapshot_time", MARKET_TZ).alias("t_market"))


OCC_SQL = r"""
occ_rows AS (
  SELECT contractSymbol, upper(ticker) || strftime(expiry, '%y%m%d')
           || CASE WHEN lower(option_type) = 'call' THEN 'C' ELSE 'P' END
           || lpad(CAST(CAST(round(strike * 1000) AS BIGINT) AS VARCHAR), 8, '0') AS occ
  FROM silver_options_latest),
occ_sym AS (SELECT contractSymbol AS source, occ AS symbol FROM occ_rows
            UNION ALL SELECT contractSymbol, contractSymbol FROM occ_rows),
occ_parsed AS (
  SELECT source, symbol, CASE WHEN ok THEN root END AS root, CASE WHEN ok THEN d END AS expiry,
         CASE WHEN ok THEN cp END AS cp, CASE WHEN ok THEN k END AS strike
  FROM (SELECT source, symbol,
          regexp_extract(symbol, '@OCC@', 1) AS root,
          CAST(try_strptime('20' || regexp_extract(symbol, '@OCC@', 2)
               || regexp_extract(symbol, '@OCC@', 3)
               || regexp_extract(symbol, '@OCC@', 4), '%Y%m%d') AS DATE) AS d,
          regexp_extract(symbol, '@OCC@', 5) AS cp,
          TRY_CAST(regexp_extract(symbol, '@OCC@', 6) AS BIGINT) / 1000.0 AS k,
          regexp_matches(symbol, '@OCC@') AS ok0
        FROM occ_sym) x, LATERAL (SELECT ok0 AND d IS NOT NULL AS ok) y)""".replace("@OCC@", occ.OCC_PATTERN)


def _symbols(spark, sf_dir):
    o = Tables(spark, sf_dir).silver_options()
    occ_rows = o.select("contractSymbol",
                        occ.occ_symbol("ticker", "expiry", "option_type", "strike").alias("occ"))
    return (occ_rows.select(F.col("contractSymbol").alias("source"), F.col("occ").alias("symbol"))
            .unionByName(occ_rows.select(F.col("contractSymbol").alias("source"),
                                         F.col("contractSymbol").alias("symbol"))))


@register("occ_parse", sql("SELECT source, symbol, root, expiry, cp, strike FROM occ_parsed", extra=OCC_SQL))
def q_occ_parse(spark, sf_dir):
    s = _symbols(spark, sf_dir).withColumn("_p", occ.occ_parse("symbol"))
    return s.select("source", "symbol", F.col("_p.root").alias("root"),
                    F.col("_p.expiry").alias("expiry"), F.col("_p.cp").alias("cp"),
                    F.col("_p.strike").alias("strike"))


def _strike_sql() -> str:
    return ("'$' || CASE WHEN strike = floor(strike) THEN CAST(CAST(strike AS BIGINT) AS VARCHAR) "
            "ELSE printf('%.2f', strike) END")


@register("contract_label", sql(f"""
SELECT source, symbol,
  coalesce(CASE WHEN root IS NOT NULL THEN {_strike_sql()} || cp || ' ' || strftime(expiry, '%m/%d/%y') END,
           symbol) AS label_short,
  coalesce(CASE WHEN root IS NOT NULL THEN root || ' ' || {_strike_sql()} || ' '
                || CASE WHEN cp = 'C' THEN 'Call' ELSE 'Put' END || '  ' || strftime(expiry, '%b %d ''%y') END,
           symbol) AS label_full,
  coalesce(CASE WHEN root IS NOT NULL THEN {_strike_sql()} || cp END, symbol) AS label_minimal
FROM occ_parsed""", extra=OCC_SQL))
def q_contract_label(spark, sf_dir):
    s = _symbols(spark, sf_dir)
    return s.select("source", "symbol", *[occ.contract_label("symbol", st).alias(f"label_{st}")
                                          for st in occ.LABEL_STYLES])
