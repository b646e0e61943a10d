"""Trading calendar and newest-time helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# US market holidays of the reference's collector (2026 only;
# ``is_market_holiday`` knows other years).
MARKET_HOLIDAYS = (
    "2026-01-01", "2026-01-19", "2026-02-16", "2026-04-03", "2026-05-25",
    "2026-07-03", "2026-09-07", "2026-11-26", "2026-11-27", "2026-12-25",
)


def _easter(y: Column) -> Column:
    """Easter Sunday of a Gregorian year (the anonymous algorithm)."""
    def div(a, b) -> Column:
        return F.floor(a / b).cast("int")
    a, b, c = y % 19, div(y, 100), y % 100
    h = (19 * a + b - div(b, 4) - div(b - div(b + 8, 25) + 1, 3) + 15) % 30
    weekday = (32 + 2 * (b % 4) + 2 * div(c, 4) - h - c % 4) % 7
    n = h + weekday - 7 * div(a + 11 * h + 22 * weekday, 451) + 114
    return F.make_date(y, div(n, 31), n % 31 + 1)


def is_market_holiday(day: Column, juneteenth: bool = False, after_thanksgiving: bool = True) -> Column:
    """US market holidays of any year by rule.  A holiday of a fixed date on a
    Sunday is observed on the Monday, one on a Saturday on the Friday (New
    Year's Day is not).  The defaults give the reference's list, which has the
    day after Thanksgiving and lacks Juneteenth (kept since 2022)."""
    year, month, dom, dow = F.year(day), F.month(day), F.dayofmonth(day), F.dayofweek(day)  # dow: 1 is Sunday
    nth = F.ceil(dom / 7)

    def fixed(m: int, d: int, saturday: bool = True) -> Column:
        on = F.make_date(year, F.lit(m), F.lit(d))
        shift = F.when(F.dayofweek(on) == 1, 1).when(F.dayofweek(on) == 7, -1 if saturday else None).otherwise(0)
        return F.coalesce(day == F.date_add(on, shift), F.lit(False))
    thanksgiving = F.lit(22) + (5 - F.dayofweek(F.make_date(year, F.lit(11), F.lit(1))) + 7) % 7
    out = (fixed(1, 1, saturday=False) | fixed(7, 4) | fixed(12, 25)
           | ((dow == 2) & (month == 1) & (nth == 3)) | ((dow == 2) & (month == 2) & (nth == 3))
           | ((dow == 2) & (month == 5) & (dom >= 25)) | ((dow == 2) & (month == 9) & (nth == 1))
           | (day == F.date_sub(_easter(year), 2)) | ((month == 11) & (dom == thanksgiving)))
    if after_thanksgiving:
        out = out | ((month == 11) & (dom == thanksgiving + 1))
    return out | ((year >= 2022) & fixed(6, 19)) if juneteenth else out


def trading_days(days: DataFrame, col: str = "day", holidays=MARKET_HOLIDAYS) -> DataFrame:
    """Flag each date: weekday (Mon..Fri), holiday, and trading day =
    weekday and not a holiday.  ``holidays`` is a list of a few dates, matched
    with an equality test against an in-memory set (``isin``), so there is no
    join at all; None takes the rules of ``is_market_holiday`` for any year."""
    d = F.col(col)
    weekday = F.dayofweek(d).between(2, 6)
    if holidays is None:
        holiday = is_market_holiday(d)
    else:
        holiday = d.isin(*[F.lit(h).cast("date") for h in holidays]) if holidays else F.lit(False)
    return days.select(d.alias("day"), weekday.alias("weekday"), holiday.alias("holiday"),
                       (weekday & ~holiday).alias("is_trading_day"))


def newest_with_total(df: DataFrame, name: str, key: str = "ticker",
                      ts: str = "snapshot_time") -> DataFrame:
    """Newest ``ts`` per key plus one ``'ALL'`` row: a partial aggregation
    and a second aggregation over its (one row per key) result."""
    per = df.groupBy(key).agg(F.max(ts).alias(name))
    total = per.agg(F.max(name).alias(name)).select(F.lit("ALL").alias(key), name)
    return per.unionByName(total)
