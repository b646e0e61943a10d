"""Registered queries: Bronze fixtures, Silver, Gold and their joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from chainlake.functions.util import lit_date
from chainlake.operators import gold
from chainlake.plans.catalog import register
from chainlake.plans.oracle import f, sql
from chainlake.plans.tables import Tables
from chainlake.sources import fixtures, ingest

# Bronze runs up to this day count as already loaded in ``source_file_dedupe``.
LOADED_THROUGH = "2024-01-15"


@register("silver_price", sql('SELECT * FROM silver_price_daily'))
def q_silver_price(spark, sf_dir):
    return Tables(spark, sf_dir).silver_price()


@register("silver_options", sql("SELECT * FROM silver_options_latest"))
def q_silver_options(spark, sf_dir):
    return Tables(spark, sf_dir).silver_options()


@register("latest_snapshot", sql("SELECT * FROM gold_latest_snapshot"))
def q_latest_snapshot(spark, sf_dir):
    return Tables(spark, sf_dir).gold_latest()


@register("spot_lookup", sql("SELECT * FROM spot"))
def q_spot_lookup(spark, sf_dir):
    return Tables(spark, sf_dir).spot()


@register("pcr_all", sql("SELECT * FROM gold_pcr", gold=True))
def q_pcr_all(spark, sf_dir):
    return Tables(spark, sf_dir).gold_pcr()


@register("pcr_by_expiry", sql("SELECT * FROM gold_pcr WHERE expiry <> 'ALL'", gold=True))
def q_pcr_by_expiry(spark, sf_dir):
    return Tables(spark, sf_dir).gold_pcr().filter(F.col("expiry") != "ALL")


@register("iv_per_snapshot", sql(
    "SELECT ticker, snapshot_str, snapshot_time, round(atm_iv, 10) AS atm_iv "
    "FROM run_iv", gold=True))
def q_iv_per_snapshot(spark, sf_dir):
    return Tables(spark, sf_dir).iv_per_snapshot().withColumn("atm_iv", F.round("atm_iv", 10))


@register("atm_band_join", sql(f"""
SELECT b.ticker, b.snapshot_str, b.contractSymbol, b.strike, s.spot, b.impliedVolatility AS iv
FROM bronze_options_raw b JOIN spot s ON s.ticker = b.ticker
WHERE b.strike BETWEEN s.spot * {f(0.98)} AND s.spot * {f(1.02)}"""))
def q_atm_band_join(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return gold.atm_band(t.bronze_options(), t.silver_price(), band=0.02).select(
        "ticker", "snapshot_str", "contractSymbol", "strike", "spot",
        F.col("impliedVolatility").alias("iv"))


@register("same_day_atm_join", sql(f"""
SELECT b.ticker, b.snapshot_str, b.contractSymbol, b.option_type, b.strike, p."Close" AS spot,
       b.impliedVolatility AS iv
FROM bronze_options_raw b
JOIN silver_price_daily p ON p.ticker = b.ticker AND p."Date" = CAST(b.snapshot_time AS DATE)
WHERE b.strike BETWEEN p."Close" * {f(0.95)} AND p."Close" * {f(1.05)}"""))
def q_same_day_atm_join(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return gold.atm_band(t.bronze_options(), t.silver_price(), band=0.05, spot_mode="same_day").select(
        "ticker", "snapshot_str", "contractSymbol", "option_type", "strike", "spot",
        F.col("impliedVolatility").alias("iv"))


@register("iv_rank", sql("SELECT * FROM gold_iv_rank", gold=True))
def q_iv_rank(spark, sf_dir):
    return Tables(spark, sf_dir).gold_iv_rank()


@register("iv_percentile", sql("SELECT ticker, iv_percentile FROM gold_iv_rank", gold=True))
def q_iv_percentile(spark, sf_dir):
    return Tables(spark, sf_dir).gold_iv_rank().select("ticker", "iv_percentile")


@register("iv_zscore", sql("SELECT ticker, iv_zscore FROM gold_iv_rank", gold=True))
def q_iv_zscore(spark, sf_dir):
    return Tables(spark, sf_dir).gold_iv_rank().select("ticker", "iv_zscore")


@register("self_stats_join", sql("""
SELECT a.ticker, a.snapshot_str, round(a.atm_iv, 10) AS atm_iv,
       round((a.atm_iv - a.mean) / nullif(a.sd, 0), 4) AS zscore,
       round((a.atm_iv - a.lo) / nullif(a.hi - a.lo, 0), 4) AS rank_in_range
FROM run_iv_now a""", gold=True))
def q_self_stats_join(spark, sf_dir):
    return gold.snapshot_vs_stats(Tables(spark, sf_dir).iv_per_snapshot()) \
        .withColumn("atm_iv", F.round("atm_iv", 10))


@register("iv_change_prev", sql("""
SELECT r.ticker, r.iv_current, round(p.prev_iv, 6) AS prev_iv,
       round(CASE WHEN p.prev_iv <> 0 THEN r.iv_current - p.prev_iv END, 6) AS iv_delta
FROM gold_iv_rank r LEFT JOIN (
  SELECT o.ticker, avg(o.impliedVolatility) AS prev_iv
  FROM bronze_options_raw o
  JOIN (SELECT ticker, snapshot_str FROM (
          SELECT ticker, snapshot_str, row_number() OVER (PARTITION BY ticker
                 ORDER BY max(snapshot_time) DESC, snapshot_str DESC) AS r
          FROM bronze_options_raw WHERE impliedVolatility > 0.01 GROUP BY ticker, snapshot_str)
        WHERE r = 2) q ON q.ticker = o.ticker AND q.snapshot_str = o.snapshot_str
  WHERE o.impliedVolatility > 0.01 AND o.option_type = 'call'
  GROUP BY o.ticker) p ON p.ticker = r.ticker""", gold=True))
def q_iv_change_prev(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return gold.iv_change(t.bronze_options(), t.gold_iv_rank())


@register("greeks_exposure", sql("SELECT * FROM gold_greeks_exposure", gold=True))
def q_greeks_exposure(spark, sf_dir):
    return Tables(spark, sf_dir).gold_exposure()


@register("normalize_itm", sql("""
SELECT inTheMoney_text AS raw_text,
       CASE WHEN lower(trim(inTheMoney_text)) IN ('true', '1', '1.0') THEN TRUE
            WHEN lower(trim(inTheMoney_text)) IN ('false', '0', '0.0') THEN FALSE END AS inTheMoney,
       count(*) AS n
FROM landing_rows GROUP BY 1, 2"""))
def q_normalize_itm(spark, sf_dir):
    land = fixtures.options_landing(spark, sf_dir)
    return (land.groupBy(F.col("inTheMoney").alias("raw_text"),
                         ingest.normalize_itm("inTheMoney").alias("inTheMoney"))
            .agg(F.count(F.lit(1)).alias("n")))


@register("source_file_dedupe", sql(f"""
SELECT l.* FROM bronze_options_raw l
WHERE NOT EXISTS (SELECT 1 FROM bronze_options_raw b
                  WHERE CAST(b.snapshot_time AS DATE) <= DATE '{LOADED_THROUGH}'
                    AND b._source_file = l._source_file)"""))
def q_source_file_dedupe(spark, sf_dir):
    """The landing folder holds every run; Bronze already holds the runs up
    to ``LOADED_THROUGH``.  Only rows of files not yet loaded come back."""
    t = Tables(spark, sf_dir)
    incoming = t.bronze_options()
    loaded = incoming.filter(F.to_date("snapshot_time") <= lit_date(LOADED_THROUGH))
    return ingest.new_files_only(incoming, loaded)


@register("chain_union", sql("""
SELECT contractSymbol, expiry, strike, lastPrice, volume, snapshot_str, ticker, 'call' AS option_type
FROM landing_rows WHERE option_type = 'call'
UNION ALL
SELECT contractSymbol, expiry, strike, lastPrice, volume, snapshot_str, ticker, 'put' AS option_type
FROM landing_rows WHERE option_type = 'put'"""))
def q_chain_union(spark, sf_dir):
    """Calls and puts arrive as separate frames without a type column; tag
    and stack them (``unionByName`` with missing columns allowed)."""
    land = fixtures.options_landing(spark, sf_dir)
    cols = ["contractSymbol", "expiry", "strike", "lastPrice", "volume", "snapshot_str", "ticker"]
    calls = land.filter(F.col("option_type") == "call").select(*cols)
    puts = land.filter(F.col("option_type") == "put").select(*cols)
    return ingest.chain_union([calls], [puts])


@register("bronze_sample", sql("""
SELECT contractSymbol, ticker, snapshot_time, snapshot_str, lastPrice, _source_file
FROM bronze_options_raw
ORDER BY snapshot_time DESC, _source_file DESC LIMIT 5"""))
def q_bronze_sample(spark, sf_dir):
    b = Tables(spark, sf_dir).bronze_options()
    return ingest.bronze_sample(b, 5).select(
        "contractSymbol", "ticker", "snapshot_time", "snapshot_str", "lastPrice", "_source_file")


@register("bronze_count", sql("""
SELECT 'options' AS tbl, count(*) AS n_rows, count(DISTINCT _source_file) AS n_files FROM bronze_options_raw
UNION ALL
SELECT 'price', count(*), count(DISTINCT _source_file) FROM bronze_price_raw"""))
def q_bronze_count(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return ingest.bronze_count(t.bronze_options(), "options").unionByName(
        ingest.bronze_count(t.bronze_price(), "price"))


@register("watchlist_explode", sql("""
SELECT g.* FROM gold_latest_snapshot g
WHERE EXISTS (SELECT 1 FROM bronze_options_raw b
              WHERE b.ticker = g.ticker AND b.contractSymbol = g.contractSymbol)"""))
def q_watchlist_explode(spark, sf_dir):
    """Watchlist documents ``{ticker: [symbol]}`` (one per snapshot row, so a
    contract is pinned many times) are parsed, exploded, de-duplicated
    and semi-joined to the Gold snapshot: every pinned contract in one job."""
    t = Tables(spark, sf_dir)
    docs = t.bronze_options().select(F.to_json(F.create_map("ticker", F.array("contractSymbol"))).alias("value"))
    pinned = ingest.watchlist_explode(docs)
    return t.gold_latest().join(pinned, ["ticker", "contractSymbol"], "left_semi")


@register("bronze_sample_price", sql("""
SELECT ticker, "Date", snapshot_time, snapshot_str, "Close", _source_file
FROM bronze_price_raw
ORDER BY snapshot_time DESC, _source_file DESC LIMIT 5"""))
def q_bronze_sample_price(spark, sf_dir):
    b = Tables(spark, sf_dir).bronze_price()
    return ingest.bronze_sample(b, 5).select("ticker", "Date", "snapshot_time", "snapshot_str", "Close",
                                             "_source_file")
