"""Data-quality checks and health reports.

Every check is a count of violating rows, returned as rows
``(check, violations, severity, ok)``; the check names are fixed values.  Each
source table is scanned once: its checks are conditional counts in one
aggregation, unpivoted into rows; where duplicate keys count too, the counts
are taken per key first.  Checks that compare two tables (Gold vs Silver row
counts) emit signed counts from each side and sum them -- a union and a tiny
aggregation, no join.  A build observes the checks of a table's own rows while
it writes the table.  Validation runs *before* a table is published (``plans.medallion``).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from chainlake.functions.util import count_if

ABORT, WARN = "abort", "warn"


def _rows(wide: DataFrame, specs) -> DataFrame:
    """One row of counts -> (check, violations, severity) rows."""
    rows = wide.unpivot([], [n for n, _, _ in specs], "check", "violations")
    sev = F.create_map(*[x for n, _, s in specs for x in (F.lit(n), F.lit(s))])
    return rows.select("check", "violations", sev[F.col("check")].alias("severity"))


def _checks(df: DataFrame, specs) -> DataFrame:
    """specs: (name, violation count Column, severity), all in one scan."""
    return _rows(df.agg(*[c.cast("long").alias(n) for n, c, _ in specs]), specs)


def _keyed_checks(df: DataFrame, keys, duplicates: str, specs, more=()) -> DataFrame:
    """``specs`` and the number of keys that occur more than once, in one scan:
    the counts are taken per key first.  ``more``: (name, Column over ``_n``,
    the rows of a key, severity)."""
    per = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *[c.alias(n) for n, c, _ in specs])
    all_specs = [(duplicates, count_if(F.col("_n") > 1), ABORT), *more,
                 *[(n, F.coalesce(F.sum(n), F.lit(0)), s) for n, _, s in specs]]
    return _checks(per, all_specs)


def _finish(parts) -> DataFrame:
    """Rows of one check add up: signed counts of two tables."""
    out = reduce(lambda a, b: a.unionByName(b), parts)
    out = out.groupBy("check", "severity").agg(F.abs(F.sum("violations")).cast("long").alias("violations"))
    return out.select("check", "violations", "severity", (F.col("violations") == 0).alias("ok"))


def _at_least_one(name: str, cond=None):
    n = F.count(F.lit(1)) if cond is None else count_if(cond)
    return (name, F.when(n >= 1, 0).otherwise(1), ABORT)


def _c(name: str):
    return F.col(name)


def price_specs():
    c = _c
    return [
        ("invalid_price_values", count_if((c("Open") <= 0) | (c("High") <= 0) | (c("Low") <= 0)
                                          | (c("Close") <= 0) | (c("Volume") < 0)), ABORT),
        ("invalid_price_logic", count_if((c("High") < c("Low")) | (c("High") < c("Open"))
                                         | (c("High") < c("Close")) | (c("Low") > c("Open"))
                                         | (c("Low") > c("Close"))), ABORT),
        ("invalid_hv_values", count_if((c("HV_20") < 0) | (c("HV_252") < 0)), ABORT),
    ]


def option_specs():
    c = _c
    return [
        ("null_critical_fields", count_if(
            c("contractSymbol").isNull() | c("expiry").isNull() | c("option_type").isNull()
            | c("strike").isNull() | c("snapshot_time").isNull() | c("ticker").isNull()), ABORT),
        ("bad_option_type", count_if(~c("option_type").isin("call", "put")), ABORT),
        ("invalid_numeric_values", count_if(
            (c("strike") <= 0) | (c("bid") < 0) | (c("ask") < 0) | (c("lastPrice") < 0)
            | (c("volume") < 0) | (c("openInterest") < 0) | (c("impliedVolatility") < 0)
            | (c("gamma") < 0) | (c("vega") < 0)), ABORT),
    ]


def pcr_specs():
    both_null = count_if((_c("expiry") != "ALL") & _c("pcr_volume").isNull() & _c("pcr_oi").isNull())
    return [_at_least_one("ticker_level_rows", _c("expiry") == "ALL"), ("both_ratios_null", both_null, WARN)]


def rank_specs():
    c = _c
    return [
        _at_least_one("has_rows"),
        ("null_fields", count_if(c("iv_current").isNull() | c("iv_rank").isNull()
                                 | c("iv_percentile").isNull()), ABORT),
        ("out_of_range", count_if((c("iv_rank") < 0) | (c("iv_rank") > 1)
                                  | (c("iv_percentile") < 0) | (c("iv_percentile") > 1)), ABORT),
    ]


def exposure_specs():
    c = _c
    return [
        _at_least_one("has_rows"),
        ("null_net_fields", count_if(c("net_delta").isNull() | c("net_gamma").isNull()
                                     | c("net_delta_notional").isNull()
                                     | c("net_gamma_notional").isNull()), ABORT),
        ("bad_strikes", count_if(c("strike") <= 0), ABORT),
    ]


# Checks of a table's own rows, which can be observed while it is written.
SPECS = {
    "silver_price_daily": price_specs,
    "silver_options_latest": option_specs,
    "gold_latest_snapshot": list,
    "gold_pcr": pcr_specs,
    "gold_iv_rank": rank_specs,
    "gold_greeks_exposure": exposure_specs,
}


def observed(name: str, df: DataFrame) -> tuple[DataFrame, Observation]:
    """``df`` with the checks of its rows, and their number (``_rows``), taken
    by whatever job runs over it next: no second read."""
    seen = Observation()
    return df.observe(seen, F.count(F.lit(1)).alias("_rows"), *[c.cast("long").alias(n) for n, c, _ in SPECS[name]()]), seen


def observed_failures(name: str, seen: Observation) -> list[str]:
    """Names of the abort-level checks that an observed job found failing."""
    return sorted(n for n, _, s in SPECS[name]() if s == ABORT and seen.get[n])


def abort_silver_price(silver: DataFrame) -> DataFrame:
    """The checks that stop a price merge, from the merged rows alone."""
    return _finish([_keyed_checks(silver, ["ticker", "Date"], "duplicate_keys", price_specs())])


def abort_silver_options(silver: DataFrame) -> DataFrame:
    """The checks that stop an option merge, from the merged rows alone."""
    return _finish([_keyed_checks(silver, ["contractSymbol"], "duplicate_contracts", option_specs())])


def dq_silver_price(silver: DataFrame, bronze: DataFrame) -> DataFrame:
    """Silver in one scan, Bronze in one: its keys and null fields together."""
    c = F.col
    gap = "rows_vs_bronze_keys"
    mine = _keyed_checks(silver, ["ticker", "Date"], "duplicate_keys", price_specs(),
                         [(gap, -F.coalesce(F.sum("_n"), F.lit(0)), WARN)])
    nulls = count_if(c("ticker").isNull() | c("Date").isNull() | c("Close").isNull() | c("snapshot_time").isNull())
    per = bronze.groupBy("ticker", "Date").agg(nulls.alias("_nulls"))
    raw = _checks(per, [("null_critical_fields", F.coalesce(F.sum("_nulls"), F.lit(0)), WARN), (gap, F.count(F.lit(1)), WARN)])
    return _finish([mine, raw])


def dq_silver_options(silver: DataFrame, bronze: DataFrame) -> DataFrame:
    """Silver option checks, with the crossed quotes of Bronze as a warning."""
    c = F.col
    crossed = _checks(bronze, [("ask_below_bid", count_if(
        c("bid").isNotNull() & c("ask").isNotNull() & (c("ask") < c("bid"))), WARN)])
    return _finish([_keyed_checks(silver, ["contractSymbol"], "duplicate_contracts", option_specs()), crossed])


def dq_latest_snapshot(gold: DataFrame, silver: DataFrame) -> DataFrame:
    """Rows and distinct contracts of Gold against the rows of Silver."""
    names = ("rows_vs_silver", "contracts_vs_silver")
    counts = (F.count(F.lit(1)), F.countDistinct("contractSymbol"))
    return _finish([_checks(gold, [(n, k, ABORT) for n, k in zip(names, counts)]),
                    _checks(silver, [(n, -F.count(F.lit(1)), ABORT) for n in names])])


def dq_pcr(pcr: DataFrame) -> DataFrame:
    return _finish([_checks(pcr, pcr_specs())])


def dq_iv_rank(rank: DataFrame) -> DataFrame:
    return _finish([_checks(rank, rank_specs())])


def dq_greeks_exposure(gex: DataFrame) -> DataFrame:
    return _finish([_checks(gex, exposure_specs())])


def failed(report: DataFrame, severity: str = ABORT) -> DataFrame:
    """Checks of the given severity that found violations."""
    return report.filter((F.col("severity") == severity) & ~F.col("ok"))


def health_bronze(bronze: DataFrame) -> DataFrame:
    return bronze.groupBy("ticker").agg(
        F.countDistinct("snapshot_str").alias("total_snapshots"),
        F.max("snapshot_time").alias("last_snapshot"), F.count(F.lit(1)).alias("total_rows"))


def health_silver(silver: DataFrame) -> DataFrame:
    return silver.groupBy("ticker").agg(F.count(F.lit(1)).alias("contracts"))


def health_iv(rank: DataFrame) -> DataFrame:
    return rank.select("ticker", F.round(F.col("iv_current") * 100, 2).alias("iv_pct"),
                       F.round(F.col("iv_rank") * 100, 1).alias("iv_rank_pct"), "snapshot_count")


def health_gex(gex: DataFrame) -> DataFrame:
    return gex.groupBy("ticker").agg(F.count(F.lit(1)).alias("rows"))


def iv_report(rank: DataFrame) -> DataFrame:
    """One row per ticker of the IV table, in percent."""
    c = F.col
    return rank.select("ticker", (c("iv_current") * 100).alias("iv_current_pct"),
                       (c("iv_min") * 100).alias("iv_min_pct"), (c("iv_max") * 100).alias("iv_max_pct"),
                       (c("iv_rank") * 100).alias("iv_rank_pct"),
                       (c("iv_percentile") * 100).alias("iv_percentile_pct"), "iv_zscore",
                       "snapshot_count", "snapshot_time")
