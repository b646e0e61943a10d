"""Registered queries: data-quality checks, table health, IV report."""

from __future__ import annotations

from pyspark.sql import functions as F

from chainlake.operators import quality as Q
from chainlake.operators import sketches, stats, tracker
from chainlake.plans.catalog import register
from chainlake.plans.oracle import sql
from chainlake.plans.tables import Tables


def _report(*parts: str) -> str:
    """UNION ALL of (check, violations, severity) selects -> + ok."""
    body = "\nUNION ALL\n".join(parts)
    return (f'SELECT "check", CAST(violations AS BIGINT) AS violations, severity, violations = 0 AS ok '
            f'FROM ({body}) AS u("check", violations, severity)')


def _cnt(name: str, cond: str, table: str, severity: str = "abort") -> str:
    return f"SELECT '{name}' AS \"check\", count(*) FILTER (WHERE {cond}) AS violations, '{severity}' AS severity FROM {table}"


def _dups(name: str, keys: str, table: str) -> str:
    return (f"SELECT '{name}', count(*) FILTER (WHERE n > 1), 'abort' "
            f"FROM (SELECT {keys}, count(*) AS n FROM {table} GROUP BY {keys})")


def _at_least_one(name: str, table: str, cond: str = "TRUE") -> str:
    return (f"SELECT '{name}', CASE WHEN count(*) FILTER (WHERE {cond}) >= 1 THEN 0 ELSE 1 END, 'abort' "
            f"FROM {table}")


@register("dq_silver_price", sql(_report(
    _dups("duplicate_keys", 'ticker, "Date"', "silver_price_daily"),
    _cnt("invalid_price_values", '"Open" <= 0 OR "High" <= 0 OR "Low" <= 0 OR "Close" <= 0 OR "Volume" < 0',
         "silver_price_daily"),
    _cnt("invalid_price_logic", '"High" < "Low" OR "High" < "Open" OR "High" < "Close" OR "Low" > "Open" '
         'OR "Low" > "Close"', "silver_price_daily"),
    _cnt("invalid_hv_values", "HV_20 < 0 OR HV_252 < 0", "silver_price_daily"),
    _cnt("null_critical_fields", 'ticker IS NULL OR "Date" IS NULL OR "Close" IS NULL OR snapshot_time IS NULL',
         "bronze_price_raw", "warn"),
    "SELECT 'rows_vs_bronze_keys', abs((SELECT count(*) FROM (SELECT DISTINCT ticker, \"Date\" FROM bronze_price_raw))"
    " - (SELECT count(*) FROM silver_price_daily)), 'warn'")))
def q_dq_silver_price(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return Q.dq_silver_price(t.silver_price(), t.bronze_price())


@register("dq_silver_options", sql(_report(
    _dups("duplicate_contracts", "contractSymbol", "silver_options_latest"),
    _cnt("null_critical_fields", "contractSymbol IS NULL OR expiry IS NULL OR option_type IS NULL "
         "OR strike IS NULL OR snapshot_time IS NULL OR ticker IS NULL", "silver_options_latest"),
    _cnt("bad_option_type", "option_type NOT IN ('call', 'put')", "silver_options_latest"),
    _cnt("invalid_numeric_values", "strike <= 0 OR bid < 0 OR ask < 0 OR lastPrice < 0 OR volume < 0 "
         "OR openInterest < 0 OR impliedVolatility < 0 OR gamma < 0 OR vega < 0", "silver_options_latest"),
    _cnt("ask_below_bid", "bid IS NOT NULL AND ask IS NOT NULL AND ask < bid", "bronze_options_raw", "warn"))))
def q_dq_silver_options(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return Q.dq_silver_options(t.silver_options(), t.bronze_options())


@register("dq_latest_snapshot", sql(_report(
    "SELECT 'rows_vs_silver', abs((SELECT count(*) FROM gold_latest_snapshot) "
    "- (SELECT count(*) FROM silver_options_latest)), 'abort'",
    "SELECT 'contracts_vs_silver', abs((SELECT count(DISTINCT contractSymbol) FROM gold_latest_snapshot) "
    "- (SELECT count(*) FROM silver_options_latest)), 'abort'")))
def q_dq_latest_snapshot(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return Q.dq_latest_snapshot(t.gold_latest(), t.silver_options())


@register("dq_pcr", sql(_report(
    _at_least_one("ticker_level_rows", "gold_pcr", "expiry = 'ALL'"),
    _cnt("both_ratios_null", "expiry <> 'ALL' AND pcr_volume IS NULL AND pcr_oi IS NULL", "gold_pcr", "warn")),
    gold=True))
def q_dq_pcr(spark, sf_dir):
    return Q.dq_pcr(Tables(spark, sf_dir).gold_pcr())


@register("dq_iv_rank", sql(_report(
    _at_least_one("has_rows", "gold_iv_rank"),
    _cnt("null_fields", "iv_current IS NULL OR iv_rank IS NULL OR iv_percentile IS NULL", "gold_iv_rank"),
    _cnt("out_of_range", "iv_rank < 0 OR iv_rank > 1 OR iv_percentile < 0 OR iv_percentile > 1",
         "gold_iv_rank")), gold=True))
def q_dq_iv_rank(spark, sf_dir):
    return Q.dq_iv_rank(Tables(spark, sf_dir).gold_iv_rank())


@register("dq_greeks_exposure", sql(_report(
    _at_least_one("has_rows", "gold_greeks_exposure"),
    _cnt("null_net_fields", "net_delta IS NULL OR net_gamma IS NULL OR net_delta_notional IS NULL "
         "OR net_gamma_notional IS NULL", "gold_greeks_exposure"),
    _cnt("bad_strikes", "strike <= 0", "gold_greeks_exposure")), gold=True))
def q_dq_greeks_exposure(spark, sf_dir):
    return Q.dq_greeks_exposure(Tables(spark, sf_dir).gold_exposure())


@register("health_bronze", sql("""
SELECT ticker, count(DISTINCT snapshot_str) AS total_snapshots, max(snapshot_time) AS last_snapshot,
       count(*) AS total_rows FROM bronze_options_raw GROUP BY ticker"""))
def q_health_bronze(spark, sf_dir):
    return Q.health_bronze(Tables(spark, sf_dir).bronze_options())


@register("health_silver", sql(
    "SELECT ticker, count(*) AS contracts FROM silver_options_latest GROUP BY ticker"))
def q_health_silver(spark, sf_dir):
    return Q.health_silver(Tables(spark, sf_dir).silver_options())


@register("health_iv", sql("""
SELECT ticker, round(iv_current * 100, 2) AS iv_pct, round(iv_rank * 100, 1) AS iv_rank_pct, snapshot_count
FROM gold_iv_rank""", gold=True))
def q_health_iv(spark, sf_dir):
    return Q.health_iv(Tables(spark, sf_dir).gold_iv_rank())


@register("health_gex", sql(
    'SELECT ticker, count(*) AS "rows" FROM gold_greeks_exposure GROUP BY ticker', gold=True))
def q_health_gex(spark, sf_dir):
    return Q.health_gex(Tables(spark, sf_dir).gold_exposure())


@register("iv_report", sql("""
SELECT ticker, iv_current * 100 AS iv_current_pct, iv_min * 100 AS iv_min_pct, iv_max * 100 AS iv_max_pct,
       iv_rank * 100 AS iv_rank_pct, iv_percentile * 100 AS iv_percentile_pct, iv_zscore, snapshot_count,
       snapshot_time FROM gold_iv_rank""", gold=True))
def q_iv_report(spark, sf_dir):
    return Q.iv_report(Tables(spark, sf_dir).gold_iv_rank())


# The sketches are compared with the exact forms: an estimate within the
# stated error of the exact count or rank is TRUE in the column ``near``.


def _near(estimate: str, exact: str):
    return F.abs(F.col(estimate) - F.col(exact)) <= F.greatest(sketches.COUNT_ERROR * F.col(exact), F.lit(0.5))


@register("health_bronze_sketch", sql("""
SELECT ticker, TRUE AS near, max(snapshot_time) AS last_snapshot, count(*) AS total_rows FROM bronze_options_raw GROUP BY ticker"""))
def q_health_bronze_sketch(spark, sf_dir):
    b = Tables(spark, sf_dir).bronze_options()
    exact = Q.health_bronze(b).select("ticker", F.col("total_snapshots").alias("exact"))
    got = sketches.health_bronze(sketches.run_sketches(b)).join(exact, "ticker")
    return got.select("ticker", _near("total_snapshots", "exact").alias("near"), "last_snapshot", "total_rows")


@register("contract_summary_sketch", sql("""
SELECT ticker, contractSymbol, CAST(expiry AS VARCHAR) AS expiry, option_type, strike, TRUE AS near,
       round(min(lastPrice), 2) AS price_min, round(max(lastPrice), 2) AS price_max
FROM bronze_options_raw WHERE lastPrice > 0 AND impliedVolatility > 0.01
GROUP BY 1, 2, 3, 4, 5 HAVING count(DISTINCT snapshot_str) >= 3"""))
def q_contract_summary_sketch(spark, sf_dir):
    b = Tables(spark, sf_dir).bronze_options()
    keys = ["ticker", "contractSymbol", "expiry", "option_type", "strike"]
    exact = tracker.contract_summary(b).select(*keys, F.col("snapshots").alias("exact"))
    got = sketches.contract_summary(sketches.contract_sketches(b)).join(exact, keys, "full")
    return got.select(*keys, F.coalesce(_near("snapshots", "exact"), F.lit(False)).alias("near"), "price_min", "price_max")


@register("qq_plot_sketch", sql("""
SELECT ticker, j, (j - 0.5) / 200 AS p, TRUE AS near
FROM (SELECT DISTINCT ticker FROM bronze_options_raw
      WHERE impliedVolatility > 0.01 AND impliedVolatility < 2.0 AND hour(snapshot_time) BETWEEN 9 AND 18),
     (SELECT CAST(unnest(range(1, 201)) AS INTEGER) AS j)"""))
def q_qq_plot_sketch(spark, sf_dir):
    """Sketched Q-Q points; ``near``: the exact ranks of the value hold the
    probability, up to the stated error."""
    b = Tables(spark, sf_dir).bronze_options()
    pts = sketches.qq_points(sketches.iv_sketches(b))
    ranks = stats.ranked_values(stats.iv_sample(b)).select(
        "ticker", F.col("iv").alias("osr"), ((F.col("start") - 1) / F.col("n")).alias("lo"), ((F.col("start") - 1 + F.col("m")) / F.col("n")).alias("hi"))
    near = (F.col("p") >= F.col("lo") - sketches.RANK_ERROR) & (F.col("p") <= F.col("hi") + sketches.RANK_ERROR)
    return pts.join(ranks, ["ticker", "osr"], "left").select("ticker", "j", "p", F.coalesce(near, F.lit(False)).alias("near"))
