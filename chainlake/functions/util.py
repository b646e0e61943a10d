"""Small Column helpers shared by the operator modules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lit_date(d) -> Column:
    """A date literal from text/date, or a Column cast to DATE."""
    if isinstance(d, Column):
        return d.cast("date")
    return F.lit(str(d)).cast("date")


def lit_ts(ts) -> Column:
    """A naive timestamp literal from text/datetime, or a Column cast."""
    if isinstance(ts, Column):
        return ts.cast("timestamp_ntz")
    return F.lit(str(ts)).cast("timestamp_ntz")


def safe_div(num, den) -> Column:
    """num / den with a zero or NULL denominator giving NULL (never raises
    under ANSI)."""
    d = as_col(den)
    return as_col(num) / F.when(d != 0, d)


def null_double() -> Column:
    return F.lit(None).cast("double")


def count_if(cond: Column) -> Column:
    """Count of rows where ``cond`` is TRUE (NULL is not counted)."""
    return F.count(F.when(cond, F.lit(1)))


def select_existing(df: DataFrame, keep) -> DataFrame:
    """Keep the listed columns that exist, in the listed order; a missing
    column is dropped silently."""
    present = set(df.columns)
    return df.select([c for c in keep if c in present])


def pandas_round(c, digits: int) -> Column:
    """Round as pandas/numpy ``round(digits)`` does: scale by 10**digits,
    round half to even, scale back (so 2.675 -> 2.67, because 2.675 * 100 is
    267.49999999999997 in binary)."""
    p = float(10 ** digits)
    return F.bround(as_col(c) * p, 0) / p
