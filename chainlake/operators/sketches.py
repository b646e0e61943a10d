"""Health and distribution reports from kept daily sketches.

A sketch per ticker (or contract) and day is a few kilobytes whatever it has
seen, and sketches merge.  They are made once per batch of rows (see
``plans.medallion.update_kept``); a report unites them, so its work depends on
tickers and days, not on rows.  The exact forms stay in ``quality``,
``tracker`` and ``stats``.

Errors: the standard error of a united HyperLogLog sketch is 1.04 / 2^(LG_K/2),
0.81 % with ``LG_K`` = 14; counts are taken as right within four of these,
``COUNT_ERROR`` (relative), and are exact in effect up to some hundred.  KLL
ranks with ``RANK_K`` = 800 are within ``RANK_ERROR`` of all ranks (99 %).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainlake.functions.classify import market_hours
from chainlake.functions.stats import with_norm_ppf
from chainlake.operators.tracker import KEY

LG_K, RANK_K = 14, 800
COUNT_ERROR, RANK_ERROR = 4 * 1.04 / 2 ** (LG_K / 2), 0.006
CONTRACT = ["ticker", KEY, "expiry", "option_type", "strike"]


def run_sketches(opts: DataFrame) -> DataFrame:
    """Per ticker and day: rows, newest snapshot, sketch of the runs."""
    return opts.groupBy("ticker", F.to_date("snapshot_time").alias("day")).agg(
        F.hll_sketch_agg("snapshot_str", F.lit(LG_K)).alias("runs"),
        F.max("snapshot_time").alias("last_snapshot"), F.count(F.lit(1)).alias("n_rows"))


def health_bronze(kept: DataFrame) -> DataFrame:
    """``quality.health_bronze`` with the distinct runs estimated."""
    return kept.groupBy("ticker").agg(
        F.hll_sketch_estimate(F.hll_union_agg("runs")).alias("total_snapshots"),
        F.max("last_snapshot").alias("last_snapshot"), F.sum("n_rows").alias("total_rows"))


def contract_sketches(opts: DataFrame, iv_floor: float = 0.01) -> DataFrame:
    """Per contract and day: sketches of its runs and of those with a valid
    print, the price range, sums and counts of IV and delta."""
    ok = (F.col("lastPrice") > 0) & (F.col("impliedVolatility") > iv_floor)

    def valid(c) -> F.Column:
        return F.when(ok, c)
    iv = (F.col("impliedVolatility") * 100).cast("decimal(24,10)")
    delta = F.col("delta").cast("decimal(24,10)")
    return opts.groupBy(*CONTRACT, F.to_date("snapshot_time").alias("day")).agg(
        F.hll_sketch_agg("snapshot_str", F.lit(LG_K)).alias("runs"),
        F.hll_sketch_agg(valid(F.col("snapshot_str")), F.lit(LG_K)).alias("valid_runs"),
        F.min(valid(F.col("lastPrice"))).alias("price_min"), F.max(valid(F.col("lastPrice"))).alias("price_max"),
        F.sum(valid(iv)).alias("iv_sum"), F.count(valid(iv)).alias("iv_n"),
        F.sum(valid(delta)).alias("delta_sum"), F.count(valid(delta)).alias("delta_n"))


def trackable(kept: DataFrame, min_snapshots: int = 2) -> DataFrame:
    """``tracker.trackable`` with the distinct runs estimated."""
    return (kept.groupBy(*CONTRACT).agg(F.hll_sketch_estimate(F.hll_union_agg("runs")).alias("snapshots"))
            .filter(F.col("snapshots") >= min_snapshots))


def contract_summary(kept: DataFrame, min_snapshots: int = 3) -> DataFrame:
    """``tracker.contract_summary`` with the distinct runs estimated."""
    def mean(what: str, digits: int) -> F.Column:
        n = F.sum(f"{what}_n")
        return F.round(F.sum(f"{what}_sum").cast("decimal(30,10)") / F.when(n > 0, n).cast("decimal(20,0)"), digits).cast("double")
    return (kept.groupBy("ticker", KEY, F.col("expiry").cast("string").alias("expiry"), "option_type", "strike").agg(
        F.hll_sketch_estimate(F.hll_union_agg("valid_runs")).alias("snapshots"),
        F.round(F.min("price_min"), 2).alias("price_min"), F.round(F.max("price_max"), 2).alias("price_max"),
        mean("iv", 2).alias("iv_avg_pct"), mean("delta", 3).alias("delta_avg"))
        .filter(F.col("snapshots") >= min_snapshots))


def iv_sketches(opts: DataFrame, lo: float = 0.01, hi: float = 2.0, hours=(9, 18)) -> DataFrame:
    """Per ticker and day: quantile sketch of the ``stats.iv_sample`` values."""
    iv = F.col("impliedVolatility")
    rows = opts.filter((iv > lo) & (iv < hi) & market_hours("snapshot_time", *hours))
    return rows.groupBy("ticker", F.to_date("snapshot_time").alias("day")).agg(
        F.kll_sketch_agg_double(iv * 100, RANK_K).alias("ranks"), F.count(F.lit(1)).alias("n"))


def qq_points(kept: DataFrame, points: int = 200) -> DataFrame:
    """Normal probability plot at ``points`` evenly spaced probabilities per
    ticker: theoretical quantile ``osm`` and estimated sample quantile
    ``osr``."""
    ps = [(j - 0.5) / points for j in range(1, points + 1)]
    merged = kept.groupBy("ticker").agg(F.kll_merge_agg_double("ranks").alias("_all"), F.sum("n").alias("n"))
    values = F.kll_sketch_get_quantile_double("_all", F.array(*map(F.lit, ps)))
    at = merged.select("ticker", "n", F.posexplode(F.arrays_zip(F.array(*map(F.lit, ps)).alias("p"), values.alias("osr"))).alias("_j", "_at"))
    at = at.select("ticker", (F.col("_j") + 1).alias("j"), "n", F.col("_at.p").alias("p"), F.col("_at.osr").alias("osr"))
    return with_norm_ppf(at, "p", "osm").select("ticker", "j", "p", "n", "osm", "osr")
