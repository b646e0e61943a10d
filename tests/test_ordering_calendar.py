import datetime as dt

from pyspark.sql import functions as F

from chainlake.operators import calendar
from chainlake.operators.ordering import numbered


def test_row_numbers_are_those_of_a_sort(spark):
    rows = [(i * 7919 % 101 if i % 9 else None, f"s{i % 13}") for i in range(5_000)]
    df = spark.createDataFrame(rows, "a int, b string").repartition(7)
    got = sorted(((r.row_no, r.a, r.b) for r in numbered(df, ["a", "b"]).collect()), key=lambda r: r[0])
    want = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    assert [r[0] for r in got] == list(range(1, 5_001)) and [r[1:] for r in got] == want
    assert numbered(df.limit(0), ["a"]).collect() == []


def test_ranges_are_numbered_in_several_tasks(spark):
    keep = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = numbered(spark.range(10_000).select((-F.col("id")).alias("x")), ["x"])
        assert got.where("row_no <> x + 10000").count() == 0
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", keep)


def holidays(spark, year, **kw):
    days = spark.range(366).select(F.date_add(F.lit(f"{year}-01-01").cast("date"), F.col("id").cast("int")).alias("day")).where(F.year("day") == year)
    return sorted(str(r.day) for r in days.where(calendar.is_market_holiday(F.col("day"), **kw)).collect())


def test_rules_give_known_years(spark):
    assert holidays(spark, 2026) == sorted(calendar.MARKET_HOLIDAYS)
    known = {  # published lists of the exchange
        2024: "01-01 01-15 02-19 03-29 05-27 06-19 07-04 09-02 11-28 12-25",
        2022: "01-17 02-21 04-15 05-30 06-20 07-04 09-05 11-24 12-26",
        2021: "01-01 01-18 02-15 04-02 05-31 07-05 09-06 11-25 12-24",
        2017: "01-02 01-16 02-20 04-14 05-29 07-04 09-04 11-23 12-25",
    }
    for year, days in known.items():
        assert holidays(spark, year, juneteenth=True, after_thanksgiving=False) == [f"{year}-{d}" for d in days.split()]


def test_trading_days_by_rule(spark):
    days = spark.createDataFrame([(dt.date(1997, 7, 4),), (dt.date(1997, 7, 5),), (dt.date(1997, 7, 7),), (None,)], "day date")
    got = {r.day: r.is_trading_day for r in calendar.trading_days(days, holidays=None).collect()}
    assert got == {dt.date(1997, 7, 4): False, dt.date(1997, 7, 5): False, dt.date(1997, 7, 7): True, None: None}
