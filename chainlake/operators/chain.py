"""Options-chain operators: chain filters, skew, term structure, exposure by
strike, PCR report, calendar markers.

Inputs are Gold tables (one row per contract, or per contract strike),
already far smaller than Bronze.  The reference asks one ticker (and one
expiry) at a time; these operators answer for every ticker and expiry in one
job, so partitions are ``(ticker, expiry)`` and the only windows run over
per-expiry rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chainlake.functions.classify import (dte_bucket, dte_calendar, dte_elapsed, flow_ratio,
                                          hours_between, freshness)
from chainlake.functions.util import count_if, lit_date, lit_ts, safe_div
from chainlake.operators.silver import spot as spot_of

# The activity/liquidity filters of the chain page, as
# (name, column, threshold); every test is a strict ``>``.
FLOW_FILTERS = (
    ("vol_oi_gt_1_0", "vol_oi_ratio", 1.0),
    ("vol_oi_gt_0_5", "vol_oi_ratio", 0.5),
    ("oi_vol_gt_10", "oi_vol_ratio", 10.0),
    ("oi_vol_gt_50", "oi_vol_ratio", 50.0),
    ("high_oi", "openInterest", 1000.0),
    ("high_vol", "volume", 500.0),
)
# The dated catalyst events shown on the term structure; a
# leading "~" marks an estimated date.
DATED_EVENTS = (
    ("WWDC 2026", "2026-06-09"),
    ("Q3 Earnings", "2026-07-30"),
    ("~CEO Transition", "2026-09-01"),
    ("~iPhone 18 Keynote", "2026-09-09"),
    ("~iPhone Ultra", "2026-10-28"),
)
DTE_WINDOW = (7, 540)


def side_name(option_type: str | None) -> str | None:
    """``Calls``/``Puts``/``call``/... -> ``call``/``put``; ``All``/None -> None."""
    if option_type is None or option_type.lower() == "all":
        return None
    return option_type.lower().rstrip("s")


def flow_predicate(name: str | None):
    if name in (None, "all"):
        return None
    for key, col, thr in FLOW_FILTERS:
        if key == name:
            return F.col(col) > F.lit(thr)
    raise ValueError(f"unknown flow filter {name!r}")


def with_ratios(df: DataFrame) -> DataFrame:
    return (df.withColumn("vol_oi_ratio", flow_ratio("volume", "openInterest"))
            .withColumn("oi_vol_ratio", flow_ratio("openInterest", "volume")))


def chain(gold: DataFrame, as_of_date, expiry=None, option_type=None, pct: float = 10,
          flow: str | None = None, zone: str | None = None,
          spot_col: str = "price_close") -> DataFrame:
    """The chain table: Gold rows of an expiry (or all) and side (or both)
    with strikes inside ``spot * (1 +- pct%)`` (inclusive), calendar DTE >= 0,
    Vol/OI and OI/Vol ratios, then the optional DTE-zone and flow filters.
    Spot is the Gold row's own newest close.  Sorted by expiry and strike."""
    g = gold
    if expiry is not None and str(expiry).upper() != "ALL":
        g = g.filter(F.col("expiry") == lit_date(expiry))
    side = side_name(option_type)
    if side is not None:
        g = g.filter(F.col("option_type") == side)
    lo, hi = 1 - pct / 100, 1 + pct / 100
    s = F.col(spot_col)
    g = g.filter(F.col("strike").between(s * F.lit(lo), s * F.lit(hi)))
    g = g.withColumn("dte", dte_calendar("expiry", as_of_date)).filter(F.col("dte") >= 0)
    g = with_ratios(g)
    if zone is not None and zone.lower() != "all":
        g = g.filter(dte_bucket("dte") == zone)
    pred = flow_predicate(flow)
    return (g if pred is None else g.filter(pred)).orderBy("expiry", "strike", "option_type", "contractSymbol")


def flow_counts(chain_rows: DataFrame) -> DataFrame:
    """Rows passing each flow filter, per ticker: one aggregation pass over
    the chain, then unpivoted (no scan per filter)."""
    aggs = [F.count(F.lit(1)).alias("all")] + [
        count_if(F.col(col) > F.lit(thr)).alias(key) for key, col, thr in FLOW_FILTERS]
    wide = chain_rows.groupBy("ticker").agg(*aggs)
    names = ["all"] + [k for k, _, _ in FLOW_FILTERS]
    return wide.unpivot("ticker", names, "flow", "n_contracts")


def skew(gold: DataFrame, expiry=None, min_volume: int = 0) -> DataFrame:
    """Strike, side and IV per (ticker, expiry) with iv > 0, volume NULL -> 0,
    volume >= ``min_volume``; ``vol_share`` = volume / the expiry's largest
    volume, taken over all rows before the volume cut (0 -> 1)."""
    g = gold.filter(F.col("iv") > 0)
    if expiry is not None:
        g = g.filter(F.col("expiry") == lit_date(expiry))
    g = g.withColumn("volume", F.coalesce(F.col("volume"), F.lit(0)).cast("long"))
    top = g.groupBy(F.col("ticker").alias("_t"), F.col("expiry").alias("_e")).agg(F.greatest(F.max("volume"), F.lit(1)).alias("_mx"))
    g = g.join(top, F.col("ticker").eqNullSafe(F.col("_t")) & F.col("expiry").eqNullSafe(F.col("_e")))
    return (g.filter(F.col("volume") >= min_volume)
            .select("ticker", "expiry", "strike", "option_type", "iv", "volume",
                    (F.col("volume") / F.col("_mx")).alias("vol_share")))


def term_structure(gold: DataFrame, as_of_ts, band: float = 0.05, min_volume: float = 10,
                   dte_range=DTE_WINDOW, spot_col: str = "price_close") -> DataFrame:
    """Volume-weighted near-the-money IV (in %) per (ticker, expiry); expiries
    with total volume <= ``min_volume`` drop out (HAVING), then elapsed DTE in
    ``dte_range``; then slope to the previous kept expiry: iv change / DTE gap
    (first row 0), ``contango`` when slope >= 0.

    The per-expiry table is tiny (tickers x expiries), so its ``lag`` window
    is cheap; the heavy part is the partial aggregation over contracts."""
    s = F.col(spot_col)
    rows = gold.filter((F.col("iv") > 0)
                       & F.col("strike").between(s * F.lit(1 - band), s * F.lit(1 + band)))
    agg = (rows.groupBy("ticker", "expiry")
           .agg(F.sum(F.col("iv") * F.col("volume")).alias("_ivv"), F.sum("volume").alias("vol"))
           .filter(F.col("vol") > min_volume)
           .withColumn("atm_iv", safe_div(F.col("_ivv"), F.col("vol")) * 100)
           .withColumn("dte", dte_elapsed("expiry", as_of_ts))
           .filter(F.col("dte").between(*dte_range)))
    w = Window.partitionBy("ticker").orderBy("expiry")
    gap = F.col("dte") - F.lag("dte").over(w)
    chg = F.col("atm_iv") - F.lag("atm_iv").over(w)
    out = (agg.withColumn("dte_gap", gap).withColumn("iv_change", chg)
           .withColumn("slope", F.coalesce(safe_div(F.col("iv_change"), F.col("dte_gap")), F.lit(0.0))))
    return out.select("ticker", "expiry", "atm_iv", F.col("vol").cast("long").alias("vol"), "dte",
                      "dte_gap", "iv_change", "slope",
                      F.when(F.col("slope") >= 0, "contango").otherwise("backwardation")
                      .alias("shape"))


def event_markers(as_of: DataFrame, events=DATED_EVENTS, dte_range=DTE_WINDOW) -> DataFrame:
    """Each event's elapsed DTE relative to each row of ``as_of`` (columns
    ``ticker``, ``as_of``), with ``shown`` = DTE inside ``dte_range``.  The
    events are a literal array attached to every as-of row and inlined (a
    fixed fan-out of len(events), no join)."""
    arr = F.array(*[F.struct(F.lit(name.lstrip("~")).alias("event"),
                             F.lit(d).cast("date").alias("event_date"),
                             F.lit(name.startswith("~")).alias("estimated"))
                    for name, d in events])
    rows = as_of.select("ticker", "as_of", F.inline(arr))
    dte = dte_elapsed("event_date", F.col("as_of"))
    return rows.select("ticker", "event", "event_date", "estimated", dte.alias("dte"),
                       dte.between(*dte_range).alias("shown"))


def gex_by_strike(exposure: DataFrame, px: DataFrame, expiry=None, band: float = 0.20,
                  scale: float = 1000.0) -> DataFrame:
    """Call, put and net gamma notional per (ticker, strike), summed over
    expiries (or one expiry), strikes within spot +- band, in thousands.
    Spot is one row per ticker (broadcast)."""
    e = exposure
    if expiry is not None:
        e = e.filter(F.col("expiry") == lit_date(expiry))
    s = spot_of(px).select("ticker", "spot")
    sums = (e.groupBy("ticker", "strike")
            .agg(F.sum("call_gamma_notional").alias("call_gex"),
                 F.sum("put_gamma_notional").alias("put_gex"),
                 F.sum("net_gamma_notional").alias("net_gex")))
    j = sums.join(s, "ticker")
    j = j.filter((F.col("strike") >= F.col("spot") * F.lit(1 - band))
                 & (F.col("strike") <= F.col("spot") * F.lit(1 + band)))
    return j.select("ticker", "strike", *[(F.col(c) / scale).alias(f"{c}_k")
                                          for c in ("call_gex", "put_gex", "net_gex")])


def pcr_report(pcr: DataFrame, as_of_date) -> DataFrame:
    """The PCR table as shown: the ALL row plus expiries on or after
    ``as_of_date``; NULL OI fields -> 0 (volume fields are left alone);
    ``row_order`` puts dated rows by expiry, then ALL last."""
    exp_date = F.expr("try_cast(expiry AS DATE)")
    keep = (F.col("expiry") == "ALL") | (exp_date >= lit_date(as_of_date))
    r = pcr.filter(keep)
    return r.select(
        "ticker", "expiry", "put_volume", "call_volume", "pcr_volume",
        F.coalesce("put_oi", F.lit(0)).cast("long").alias("put_oi"),
        F.coalesce("call_oi", F.lit(0)).cast("long").alias("call_oi"),
        F.coalesce("pcr_oi", F.lit(0.0)).alias("pcr_oi"),
        F.when(F.col("expiry") == "ALL", 1).otherwise(0).alias("row_order"))


def chain_ladder(gold: DataFrame, as_of_date) -> DataFrame:
    """One row per (ticker, expiry, strike): call fields left, put fields
    right, skew = put IV - call IV (conditional aggregation, no self-join)."""
    def side(col, t):
        return F.max(F.when(F.col("option_type") == t, F.col(col)))
    lad = (gold.groupBy("ticker", "expiry", "strike")
           .agg(side("iv", "call").alias("call_iv"), side("option_last", "call").alias("call_last"),
                side("volume", "call").alias("call_volume"),
                side("openInterest", "call").alias("call_oi"),
                side("iv", "put").alias("put_iv"), side("option_last", "put").alias("put_last"),
                side("volume", "put").alias("put_volume"),
                side("openInterest", "put").alias("put_oi")))
    return (lad.withColumn("skew", F.col("put_iv") - F.col("call_iv"))
            .withColumn("dte", dte_calendar("expiry", as_of_date)))


def freshness_report(bronze: DataFrame, as_of_ts) -> DataFrame:
    """Newest snapshot per ticker and overall (``ticker`` = ``'ALL'``),
    hours before ``as_of_ts`` and the stale/warning/ok status."""
    per = bronze.groupBy("ticker").agg(F.max("snapshot_time").alias("last_snapshot"))
    overall = per.agg(F.max("last_snapshot").alias("last_snapshot")).select(
        F.lit("ALL").alias("ticker"), "last_snapshot")
    both = per.unionByName(overall)
    h = hours_between(lit_ts(as_of_ts), F.col("last_snapshot"))
    return both.select("ticker", "last_snapshot", F.round(h, 6).alias("hours_ago"),
                       freshness(h).alias("status"))
