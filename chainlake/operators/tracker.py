"""Per-contract time series: history, daily bars, overrides, EMA, OI change,
contract summaries.

The reference queries one contract symbol at a time; every operator here
answers for all contracts in one job.  Partitioning is by contract (and day),
which spreads evenly -- a contract holds at most two snapshots per trading
day of its life -- so no window ever spans a whole ticker.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chainlake.functions.classify import candle_direction, market_hours, pm_only
from chainlake.functions.util import count_if, pandas_round

KEY = "contractSymbol"
# Order of snapshots within a contract; the source file breaks ties on time.
TIME_ORDER = ("snapshot_time", "_source_file")
HISTORY_COLS = ["contractSymbol", "snapshot_time", "lastPrice", "impliedVolatility", "delta",
                "theta", "gamma", "volume", "openInterest"]
# The timeframe choices of the tracker page, in days (None = all).
TIMEFRAMES = {"1D": 1, "1W": 7, "1M": 30, "3M": 90, "All": None}
# EMA spans drawn on the candlestick chart.
EMA_SPANS = (8, 27, 200)


def _order_key(df: DataFrame):
    cols = [c for c in TIME_ORDER if c in df.columns]
    return F.struct(*[F.col(c) for c in cols])


def contract_history(opts: DataFrame, metric: str = "lastPrice", hours=(9, 18)) -> DataFrame:
    """Market-hours snapshots of every contract.  For price, all of them; for
    any other metric, only the newest snapshot of each (contract, day) --
    every row tied on that time is kept (``rank``) -- and rows whose metric is
    NULL are dropped."""
    rows = opts.filter(market_hours("snapshot_time", *hours))
    if metric == "lastPrice":
        return rows.select(HISTORY_COLS)
    # newest time per (contract, day) by a partial aggregate, then a semi-join
    # back on (contract, day, time): a hot contract-day is combined map-side
    # and split by AQE's skew join instead of sorted in one window task
    rows = rows.withColumn("_d", F.to_date("snapshot_time"))
    newest = rows.groupBy(KEY, "_d").agg(F.max("snapshot_time").alias("snapshot_time"))
    kept = rows.join(newest, [KEY, "_d", "snapshot_time"], "left_semi")
    return kept.filter(F.col(metric).isNotNull()).select(HISTORY_COLS)


def metric_history(opts: DataFrame, metrics, hours=(9, 18)) -> DataFrame:
    """``contract_history`` of several daily metrics at once, as rows (contract,
    time, metric, value): the newest snapshots are found once."""
    rows = opts.filter(market_hours("snapshot_time", *hours)).withColumn("_d", F.to_date("snapshot_time"))
    newest = rows.groupBy(KEY, "_d").agg(F.max("snapshot_time").alias("snapshot_time"))
    kept = rows.join(newest, [KEY, "_d", "snapshot_time"], "left_semi")
    return kept.unpivot([KEY, "snapshot_time"], list(metrics), "metric", "value").filter(F.col("value").isNotNull())


def all_timeframes(df: DataFrame, timeframes=None, ts: str = "snapshot_time") -> DataFrame:
    """``last_days`` of every timeframe in one pass, with its name."""
    newest = df.groupBy(KEY).agg(F.max(ts).alias("_top"))
    since = F.inline(F.array(*[F.struct(F.lit(k).alias("timeframe"),
                                        (F.col("_top") - F.make_dt_interval(F.lit(d)) if d is not None else F.lit(None).cast("timestamp_ntz")).alias("_from"))
                               for k, d in (timeframes or TIMEFRAMES).items()]))
    return (df.join(newest.select(KEY, since), KEY).filter(F.col("_from").isNull() | (F.col(ts) >= F.col("_from")))
            .select("timeframe", *df.columns))


def last_days(df: DataFrame, days: int | None, ts: str = "snapshot_time",
              by: str | None = KEY) -> DataFrame:
    """Rows at or after (newest ``ts`` of the series - ``days`` days); the
    newest time is per series (``by``), not the wall clock.  ``None`` keeps
    everything."""
    if days is None:
        return df
    mx = F.col("_series_max")
    is_date = dict(df.dtypes).get(ts) == "date"
    cutoff = F.date_sub(mx, days) if is_date else mx - F.make_dt_interval(F.lit(days))
    if by is None:
        # one series: its newest time is a single scalar
        top = df.agg(F.max(ts)).first()[0]
        if top is None:
            return df
        lit_top = F.lit(top)
        return df.filter(F.col(ts) >= (F.date_sub(lit_top, days) if is_date
                                       else lit_top - F.make_dt_interval(F.lit(days))))
    # newest time per series by a partial aggregate joined back on the key
    # (no window holding a whole series in one task)
    newest = df.groupBy(by).agg(F.max(ts).alias("_series_max"))
    return df.join(newest, by).filter(F.col(ts) >= cutoff).drop("_series_max")


def ohlc(opts: DataFrame, iv_floor: float = 0.01, noon: int = 12, use_all: bool = False) -> DataFrame:
    """Daily bars per contract from snapshots with lastPrice > 0 and IV above
    ``iv_floor``: open = first morning price, close = last afternoon price
    (a missing side takes the other), high/low = max/min of open and close
    (``use_all=True``: of every snapshot that day), oi = last non-NULL OI of
    the day.  One grouped aggregation per (contract, day), no join."""
    rows = opts.filter((F.col("lastPrice") > 0) & (F.col("impliedVolatility") > iv_floor))
    k = _order_key(rows)
    am = F.hour("snapshot_time") < noon
    agg = rows.groupBy(KEY, F.to_date("snapshot_time").alias("date")).agg(
        F.min_by(F.when(am, F.col("lastPrice")), F.when(am, k)).alias("_open"),
        F.max_by(F.when(~am, F.col("lastPrice")), F.when(~am, k)).alias("_close"),
        F.max_by(F.col("openInterest"), F.when(F.col("openInterest").isNotNull(), k)).alias("oi"),
        F.max("lastPrice").alias("_hi"), F.min("lastPrice").alias("_lo"))
    o = F.coalesce("_open", "_close")
    c = F.coalesce("_close", "_open")
    hi = F.col("_hi") if use_all else F.greatest(o, c)
    lo = F.col("_lo") if use_all else F.least(o, c)
    return agg.select(KEY, "date", o.alias("open"), hi.alias("high"), lo.alias("low"),
                      c.alias("close"), "oi")


def candles(bars: DataFrame) -> DataFrame:
    return bars.withColumn("direction", candle_direction("open", "close"))


def validate_overrides(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split an override log into (accepted, rejected): high < low is
    rejected; NULL operands are not a violation."""
    bad = F.col("high") < F.col("low")
    return log.filter(~bad | bad.isNull()), log.filter(bad)


def latest_overrides(log: DataFrame) -> DataFrame:
    """Upsert semantics over an append-only log: one row per (symbol, date),
    the last write wins (ties on ``updated_at`` broken by the values)."""
    w = Window.partitionBy("symbol", "date").orderBy(
        F.col("updated_at").desc_nulls_last(), F.col("high").desc_nulls_last(),
        F.col("low").desc_nulls_last())
    return (log.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1")
            .select("symbol", "date", "high", "low", "updated_at"))


def list_overrides(overrides: DataFrame) -> DataFrame:
    """Saved overrides with the day's range, newest date first."""
    return overrides.select("symbol", "date", "high", "low",
                            F.round(F.col("high") - F.col("low"), 2).alias("range"), "updated_at") \
        .orderBy(F.col("date").desc_nulls_last(), "symbol")


def apply_overrides(bars: DataFrame, overrides: DataFrame, scope: str = "last") -> DataFrame:
    """Manual high/low win over the synthetic ones.  ``scope='last'`` (the
    reference) patches each contract's newest bar only and returns just that
    bar; ``'all'`` patches every bar.  Left join on (contract, date): the
    override table is keyed the same way, so this is a co-partitioned
    equi-join, never a broadcast of an unbounded log."""
    b = bars
    if scope == "last":
        b = b.groupBy(KEY).agg(F.max_by(F.struct(*b.columns), "date").alias("_b")).select("_b.*")  # one bar per contract and day
    ov = overrides.select(F.col("symbol").alias(KEY), "date", F.col("high").alias("_ovh"),
                          F.col("low").alias("_ovl"))
    j = b.join(ov, [KEY, "date"], "left")
    return j.select(KEY, "date", "open", F.coalesce("_ovh", "high").alias("high"),
                    F.coalesce("_ovl", "low").alias("low"), "close", "oi",
                    (F.col("_ovh").isNotNull() | F.col("_ovl").isNotNull()).alias("overridden"))


def today_ohlc(bars: DataFrame, overrides: DataFrame) -> DataFrame:
    """Newest bar per contract, overrides applied, with the moves from open."""
    t = apply_overrides(bars, overrides, scope="last")
    return t.select("*", (F.col("close") - F.col("open")).alias("change"),
                    (F.col("high") - F.col("open")).alias("high_vs_open"),
                    (F.col("low") - F.col("open")).alias("low_vs_open"))


def ema_over(bars: DataFrame, days: int | None = None, warmup: bool = False, **kw) -> DataFrame:
    """EMA for a timeframe of ``days``: the reference cuts the bars first and
    starts the averages at the first bar of the window (``warmup=False``);
    ``warmup=True`` runs them over the whole history and cuts afterwards."""
    if days is None:
        return ema(bars, **kw)
    if warmup:
        return last_days(ema(bars, **kw), days, ts="date")
    return ema(last_days(bars, days, ts="date"), **kw)


# Days of a segment of the EMA scan.
SEGMENT_DAYS = 256


def _affine(span: float) -> tuple[float, float]:
    """y = A y' + B x, as pandas ``ewm(adjust=False)`` computes it."""
    a = 2.0 / (span + 1)
    return (1.0 - a) / ((1.0 - a) + a), a / ((1.0 - a) + a)


def _ema_scan(bars: DataFrame, spans, value: str, order: str) -> DataFrame:
    """KEY, order, value, ``_t`` (number of the bar, from 1) and ``_y{i}``.

    A bar is an affine map of the average before it, and maps compose.  Each
    series is cut into segments of ``SEGMENT_DAYS`` days, which any task may
    take: inside, y = A^k (y_in + sum(B x / A^k)) is a running sum.  Only the
    segments' ends (a row per 256 bars) are folded in order; what each segment
    begins with goes back to its bars.  The cost is linear in the bars."""
    maps = [_affine(n) for n in spans]
    seg = F.floor(F.datediff(F.col(order), F.lit("1970-01-01").cast("date")) / SEGMENT_DAYS)
    w = Window.partitionBy(KEY, "_seg").orderBy(order)
    s = bars.select(KEY, order, value, seg.alias("_seg")).withColumn("_k", F.row_number().over(w))
    x, k = F.col(value), F.col("_k")

    def power(a: float, n) -> F.Column:
        return F.pow(F.lit(a), n)
    s = s.withColumns({f"_l{i}": (power(a, k) * F.sum(b * x / power(a, k)).over(w) if a else b * x) for i, (a, b) in enumerate(maps)})
    ends = s.groupBy(KEY, "_seg").agg(F.max("_k").alias("n"), F.min_by(value, "_k").alias("x"),
                                      *[F.max_by(f"_l{i}", "_k").alias(f"l{i}") for i in range(len(maps))])
    series = ends.groupBy(KEY).agg(F.array_sort(F.collect_list(F.struct("_seg", "n", "x", *[f"l{i}" for i in range(len(maps))]))).alias("_s"))

    def carried(start, step):
        """What stands before each segment."""
        return F.aggregate("_s", F.array(start), lambda acc, e: F.array_append(acc, step(F.element_at(acc, -1), e)))
    before = [carried(F.lit(0).cast("long"), lambda n, e: n + e["n"]).alias("_before")]
    before += [carried(F.get("_s", F.lit(0))["x"], lambda y, e, a=a, i=i: power(a, e["n"]) * y + e[f"l{i}"]).alias(f"_in{i}") for i, (a, _) in enumerate(maps)]
    names = ["_before", *[f"_in{i}" for i in range(len(maps))]]
    starts = series.select(KEY, F.transform("_s", lambda e: e["_seg"]).alias("_segs"), *before)
    at = F.explode(F.transform("_segs", lambda g, j: F.struct(g.alias("_seg"), *[F.get(n, j).alias(n) for n in names])))
    starts = starts.select(KEY, at.alias("_at")).select(KEY, "_at.*")
    return s.join(starts, [KEY, "_seg"]).select(
        KEY, order, value, (F.col("_before") + k).alias("_t"),
        *[(F.col(f"_l{i}") + power(a, k) * F.col(f"_in{i}")).alias(f"_y{i}") for i, (a, _) in enumerate(maps)])


def ema(bars: DataFrame, spans=EMA_SPANS, value: str = "close", order: str = "date") -> DataFrame:
    """Exponential moving averages of each contract's daily bars: alpha = 2 /
    (span + 1), first value = first observation, y = ((1 - alpha) y' + alpha x)
    / ((1 - alpha) + alpha) as pandas ``ewm(adjust=False)`` computes it."""
    out = _ema_scan(bars, spans, value, order)
    return out.select(KEY, order, value, *[F.col(f"_y{i}").alias(f"ema_{n}") for i, n in enumerate(spans)])


def ema_timeframes(bars: DataFrame, timeframes=None, spans=EMA_SPANS, value: str = "close", order: str = "date") -> DataFrame:
    """The averages of every timeframe, each begun at its own first bar, from
    one scan: an average begun at bar s differs from the one of the whole
    series by A^(t - s) times their difference at s."""
    frames = {k: d for k, d in (timeframes or TIMEFRAMES).items()}
    full = _ema_scan(bars, spans, value, order)
    newest = full.groupBy(KEY).agg(F.max(order).alias("_top"))
    since = F.explode(F.array(*[F.struct(F.lit(k).alias("timeframe"), (F.date_sub("_top", d) if d is not None else F.lit(None).cast("date")).alias("_from"))
                                for k, d in frames.items()]))
    rows = (full.join(newest.select(KEY, since.alias("_f")).select(KEY, "_f.*"), KEY)
            .where(F.col("_from").isNull() | (F.col(order) >= F.col("_from"))).drop("_from"))
    first = F.min_by(F.struct("_t", value, *[f"_y{i}" for i in range(len(spans))]), "_t")
    begun = rows.groupBy(KEY, "timeframe").agg(first.alias("_s"))
    gap = F.col("_t") - F.col("_s._t")
    return rows.join(begun, [KEY, "timeframe"]).select(
        KEY, "timeframe", order, value,
        *[(F.col(f"_y{i}") + F.pow(F.lit(_affine(n)[0]), gap) * (F.col(f"_s.{value}") - F.col(f"_s._y{i}"))).alias(f"ema_{n}")
          for i, n in enumerate(spans)])


def oi_change(opts: DataFrame, days: int | None = None) -> DataFrame:
    """Afternoon (settled) OI per snapshot, change against the previous
    afternoon snapshot of the contract (after the timeframe cut), and its
    direction (first row counts as ``up``)."""
    pm = last_days(opts.filter(pm_only("snapshot_time")), days)
    # ``lag`` needs each contract's afternoon snapshots in order: at most one
    # or two per trading day of the contract's life, so the window is bounded
    w = Window.partitionBy(KEY).orderBy(*[c for c in TIME_ORDER if c in pm.columns])
    prev = F.lag("openInterest").over(w)
    out = pm.select(KEY, "snapshot_time", "volume", "openInterest", prev.alias("oi_prev"))
    chg = F.col("openInterest") - F.col("oi_prev")
    return out.select("*", chg.alias("oi_change"),
                      F.when(F.coalesce(chg, F.lit(0)) >= 0, "up").otherwise("down").alias("oi_direction"))


def trackable(opts: DataFrame, min_snapshots: int = 2) -> DataFrame:
    """Contracts seen in at least ``min_snapshots`` distinct runs."""
    return (opts.groupBy("ticker", KEY, "expiry", "option_type", "strike")
            .agg(F.countDistinct("snapshot_str").alias("snapshots"))
            .filter(F.col("snapshots") >= min_snapshots))


def _exact_avg_round(c, digits: int):
    """Mean rounded half away from zero, averaged in DECIMAL so the result
    does not depend on the order partial sums are merged in (a double sum
    can land either side of a rounding tie)."""
    return F.round(F.avg(c.cast("decimal(24,10)")), digits).cast("double")


def contract_summary(opts: DataFrame, min_snapshots: int = 3, iv_floor: float = 0.01) -> DataFrame:
    """Per contract with valid prints (lastPrice > 0, IV > floor) in at least
    ``min_snapshots`` runs: price range, mean IV in %, mean delta."""
    rows = opts.filter((F.col("lastPrice") > 0) & (F.col("impliedVolatility") > iv_floor))
    return (rows.groupBy("ticker", KEY, F.col("expiry").cast("string").alias("expiry"),
                         "option_type", "strike")
            .agg(F.countDistinct("snapshot_str").alias("snapshots"),
                 F.round(F.min("lastPrice"), 2).alias("price_min"),
                 F.round(F.max("lastPrice"), 2).alias("price_max"),
                 _exact_avg_round(F.col("impliedVolatility") * 100, 2).alias("iv_avg_pct"),
                 _exact_avg_round(F.col("delta"), 3).alias("delta_avg"))
            .filter(F.col("snapshots") >= min_snapshots))


def contract_detail(opts: DataFrame, iv_floor: float = 0.01) -> DataFrame:
    """Every valid snapshot of every contract, rounded for reading the way
    pandas rounds, IV in percent."""
    rows = opts.filter((F.col("lastPrice") > 0) & (F.col("impliedVolatility") > iv_floor))
    return rows.select(
        KEY, "snapshot_time", pandas_round("lastPrice", 2).alias("last_price"),
        pandas_round(F.col("impliedVolatility") * 100, 2).alias("iv_pct"),
        pandas_round("delta", 4).alias("delta"), pandas_round("gamma", 4).alias("gamma"),
        pandas_round("theta", 4).alias("theta"), "volume", "openInterest", "bid", "ask")


def contract_detail_footer(opts: DataFrame, iv_floor: float = 0.01) -> DataFrame:
    rows = opts.filter((F.col("lastPrice") > 0) & (F.col("impliedVolatility") > iv_floor))
    return rows.groupBy(KEY).agg(F.min("lastPrice").alias("price_min"),
                                 F.max("lastPrice").alias("price_max"),
                                 F.count(F.lit(1)).alias("snapshots"))


def high_low(opts: DataFrame, hours=(9, 18)) -> DataFrame:
    """Lifetime high and low lastPrice (> 0, market hours) of every
    contract; a contract with no such row gets a NULL pair."""
    ok = (F.col("lastPrice") > 0) & market_hours("snapshot_time", *hours)
    p = F.when(ok, F.col("lastPrice"))
    return opts.groupBy(KEY).agg(F.max(p).alias("contract_high"), F.min(p).alias("contract_low"))


def current_greeks(opts: DataFrame, hours=(9, 18)) -> DataFrame:
    """Delta, theta, gamma of each contract's newest market-hours snapshot:
    a grouped ``max_by`` (partial aggregation), not a LIMIT per contract."""
    rows = opts.filter(market_hours("snapshot_time", *hours))
    newest = F.max_by(F.struct("delta", "theta", "gamma", "snapshot_time"), _order_key(rows))
    return rows.groupBy(KEY).agg(newest.alias("_n")).select(
        KEY, F.col("_n.delta").alias("delta"), F.col("_n.theta").alias("theta"),
        F.col("_n.gamma").alias("gamma"), F.col("_n.snapshot_time").alias("snapshot_time"))


def days_with_sides(opts: DataFrame, noon: int = 12) -> DataFrame:
    """Contract-days with a morning side, an afternoon side, or both."""
    am = F.hour("snapshot_time") < noon
    return (opts.groupBy(KEY, F.to_date("snapshot_time").alias("date"))
            .agg(count_if(am).alias("am_rows"), count_if(~am).alias("pm_rows")))
