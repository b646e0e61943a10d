import datetime as dt

import pandas as pd
import pytest

from chainlake.operators import tracker

SCHEMA = ("contractSymbol string, snapshot_time timestamp_ntz, lastPrice double, impliedVolatility double, "
          "openInterest long, _source_file string")


def test_ohlc_missing_side_and_oi(spark):
    d = dt.datetime
    data = [("A", d(2024, 1, 2, 9, 35), 2.0, 0.3, 10, "a"), ("A", d(2024, 1, 2, 10, 0), 2.5, 0.3, None, "b"),
            ("A", d(2024, 1, 2, 16, 15), 3.0, 0.3, None, "c"),
            ("A", d(2024, 1, 3, 16, 15), 4.0, 0.3, 12, "d"),          # PM only
            ("A", d(2024, 1, 4, 9, 35), 0.0, 0.3, 1, "e")]            # lastPrice 0 -> no bar
    bars = {r.date: r for r in tracker.ohlc(spark.createDataFrame(data, SCHEMA)).collect()}
    b1 = bars[dt.date(2024, 1, 2)]
    assert (b1.open, b1.close, b1.high, b1.low, b1.oi) == (2.0, 3.0, 3.0, 2.0, 10)
    b2 = bars[dt.date(2024, 1, 3)]
    assert (b2.open, b2.close, b2.high, b2.low) == (4.0, 4.0, 4.0, 4.0)
    assert dt.date(2024, 1, 4) not in bars


def test_ema_matches_pandas(spark):
    closes = [1.0, 2.0, 1.5, 3.0, 2.5, 2.7, 4.0]
    days = [dt.date(2024, 1, i + 1) for i in range(len(closes))]
    df = spark.createDataFrame([("A", d, c) for d, c in zip(days, closes)][::-1],
                               "contractSymbol string, date date, close double")
    got = tracker.ema(df).orderBy("date").toPandas()
    for s in tracker.EMA_SPANS:
        want = pd.Series(closes).ewm(span=s, adjust=False).mean()
        assert got[f"ema_{s}"].tolist() == pytest.approx(want.tolist(), rel=1e-12)


def test_overrides_last_write_wins_and_validation(spark):
    d, t = dt.date(2024, 1, 2), dt.datetime
    log = spark.createDataFrame(
        [("A", d, 5.0, 4.0, t(2024, 1, 2, 10)), ("A", d, 6.0, 4.5, t(2024, 1, 2, 11)),
         ("A", d, 3.0, 4.0, t(2024, 1, 2, 12))],  # high < low: rejected
        "symbol string, date date, high double, low double, updated_at timestamp_ntz")
    ok, bad = tracker.validate_overrides(log)
    assert bad.count() == 1
    (r,) = tracker.latest_overrides(ok).collect()
    assert (r.high, r.low) == (6.0, 4.5)
    bars = spark.createDataFrame([("A", d, 4.8, 5.5, 4.8, 5.5, 1), ("A", dt.date(2024, 1, 1), 1.0, 2.0, 1.0, 2.0, 1)],
                                 "contractSymbol string, date date, open double, high double, low double, "
                                 "close double, oi long")
    (today,) = tracker.today_ohlc(bars, tracker.latest_overrides(ok)).collect()
    assert today.date == d and (today.high, today.low, today.overridden) == (6.0, 4.5, True)


def test_oi_change_first_row_up(spark):
    d = dt.datetime
    df = spark.createDataFrame([("A", d(2024, 1, 2, 16), 1, 100, "a"), ("A", d(2024, 1, 3, 16), 1, 90, "b"),
                                ("A", d(2024, 1, 3, 9), 1, 5, "c")],
                               "contractSymbol string, snapshot_time timestamp_ntz, volume long, "
                               "openInterest long, _source_file string")
    out = tracker.oi_change(df).orderBy("snapshot_time").collect()
    assert [(r.oi_change, r.oi_direction) for r in out] == [(None, "up"), (-10, "down")]


def test_timeframe_relative_to_series_max(spark):
    d = dt.datetime
    df = spark.createDataFrame([("A", d(2024, 1, 1)), ("A", d(2024, 1, 8)), ("A", d(2024, 1, 10)),
                                ("B", d(2023, 1, 1))], "contractSymbol string, snapshot_time timestamp_ntz")
    kept = sorted((r.contractSymbol, r.snapshot_time) for r in tracker.last_days(df, 7).collect())
    assert kept == [("A", d(2024, 1, 8)), ("A", d(2024, 1, 10)), ("B", d(2023, 1, 1))]


def test_ema_of_a_long_series_spreads_over_tasks(spark):
    """A million daily bars of one contract, with gaps, beside a short one."""
    from pyspark.sql import functions as F

    i = F.col("id")
    days = spark.range(1_000_000, numPartitions=8).where("id % 7 <> 3")
    price = (F.lit(100.0) + (i * 7919) % 1009 + 50 * F.sin(i / 1000.0))
    bars = days.select(F.lit("LONG").alias("contractSymbol"), F.date_add(F.lit("0001-01-01").cast("date"), i.cast("int")).alias("date"), price.alias("close"))
    short = spark.createDataFrame([("S", dt.date(2024, 1, k + 1), float(k)) for k in range(5)], "contractSymbol string, date date, close double")
    got = tracker.ema(bars.unionByName(short))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        per_task = got.where("contractSymbol = 'LONG'").groupBy(F.spark_partition_id()).agg(F.count("ema_8").alias("n")).collect()
        assert len(per_task) > 4 and max(r.n for r in per_task) < 400_000
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    row = got.where("contractSymbol = 'LONG'").select(F.datediff("date", F.lit("0001-01-01").cast("date")).alias("i"), "close", "ema_8", "ema_27", "ema_200")
    pdf = row.toPandas().sort_values("i")
    assert len(pdf) == 857_143
    for s in tracker.EMA_SPANS:
        assert (pdf["close"].ewm(span=s, adjust=False).mean() - pdf[f"ema_{s}"]).abs().max() < 1e-9
    assert got.where("contractSymbol = 'S'").count() == 5


def test_ema_of_all_timeframes_at_once(spark):
    from pyspark.sql import functions as F

    rows = [(c, dt.date(2020, 1, 1) + dt.timedelta(days=k * step), 10.0 + (k * 37) % 11 - k / 50)
            for c, n, step in (("A", 700, 1), ("B", 3, 40), ("C", 1, 1)) for k in range(n)]
    df = spark.createDataFrame(rows, "contractSymbol string, date date, close double")
    got = tracker.ema_timeframes(df)
    for name, days in tracker.TIMEFRAMES.items():
        want = sorted(map(tuple, tracker.ema_over(df, days).collect()))
        have = sorted(map(tuple, got.where(F.col("timeframe") == name).drop("timeframe").collect()))
        assert [w[:3] for w in want] == [h[:3] for h in have]
        assert [v for w in want for v in w[3:]] == pytest.approx([v for h in have for v in h[3:]], rel=1e-12)


def test_ema_timeframe_warmup(spark):
    closes = [1.0, 2.0, 4.0, 8.0, 16.0]
    days = [dt.date(2024, 1, i + 1) for i in range(5)]
    df = spark.createDataFrame([("A", d, c) for d, c in zip(days, closes)],
                               "contractSymbol string, date date, close double")
    cut = tracker.ema_over(df, 2, spans=(3,)).orderBy("date").collect()
    warm = tracker.ema_over(df, 2, warmup=True, spans=(3,)).orderBy("date").collect()
    assert [r.date for r in cut] == days[2:] and [r.date for r in warm] == days[2:]
    assert cut[0].ema_3 == 4.0  # restarts at the first bar of the window
    full = pd.Series(closes).ewm(span=3, adjust=False).mean().tolist()
    assert [r.ema_3 for r in warm] == pytest.approx(full[2:])
