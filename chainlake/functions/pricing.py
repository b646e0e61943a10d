"""Black-Scholes pricing as native Column expressions.

Nothing here is a UDF: every function returns a ``Column`` that Catalyst
folds into the surrounding projection, so the Greeks run inside whole-stage
codegen next to the scan for every contract at once.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainlake.functions.util import as_col

# ---------------------------------------------------------------------------
# The rational approximation of the standard normal tail
# published by Hart (1968) in the form given by G. West, "Better approximations
# to cumulative normal functions" (2005).  Coefficients in natural order,
# highest power first, as published.
# ---------------------------------------------------------------------------
CDF_NUM = (
    3.52624965998911e-02,
    0.700383064443688,
    6.37396220353165,
    33.912866078383,
    112.079291497871,
    221.213596169931,
    220.206867912376,
)
CDF_DEN = (
    8.83883476483184e-02,
    1.75566716318264,
    16.064177579207,
    86.7807322029461,
    296.564248779674,
    637.333633378831,
    793.826512519948,
    440.413735824752,
)
CDF_SWITCH = 7.07106781186547
CDF_ZERO_BEYOND = 37.0
SQRT_2PI = 2.506628274631
# Default risk-free rate and the market close used as expiry instant.
RISK_FREE = 0.05
EXPIRY_CLOSE_HOUR = 16
SECONDS_PER_YEAR = 365 * 24 * 3600


def _horner(coeffs, x: Column) -> Column:
    acc = F.lit(coeffs[0])
    for c in coeffs[1:]:
        acc = acc * x + F.lit(c)
    return acc


def normal_tail(a) -> Column:
    """P(Z > a) for a >= 0 (the upper tail), absolute error ~1e-16."""
    a = as_col(a)
    e = F.exp(-a * a / 2.0)
    near = e * _horner(CDF_NUM, a) / _horner(CDF_DEN, a)
    b = a + 0.65
    for k in (4.0, 3.0, 2.0, 1.0):
        b = a + F.lit(k) / b
    far = e / b / SQRT_2PI
    return (F.when(a > CDF_ZERO_BEYOND, F.lit(0.0))
            .when(a < CDF_SWITCH, near)
            .otherwise(far))


def cdf_from_tail(x, tail) -> Column:
    """N(x) given ``tail`` = P(Z > |x|)."""
    x, tail = as_col(x), as_col(tail)
    return F.when(x.isNull(), F.lit(None).cast("double")) \
        .when(x > 0, 1.0 - tail).otherwise(tail)


def norm_cdf(x) -> Column:
    """Standard normal CDF, absolute error ~1e-16, without ``erf``."""
    x = as_col(x)
    return cdf_from_tail(x, normal_tail(F.abs(x)))


def norm_pdf(x) -> Column:
    x = as_col(x)
    return F.exp(-x * x / 2.0) / math.sqrt(2.0 * math.pi)


def to_utc_wall(ts, tz: str) -> Column:
    """A naive wall-clock timestamp in ``tz`` as naive UTC.  Works on
    TIMESTAMP_NTZ only, so the session time zone never enters."""
    ntz = as_col(ts).cast("timestamp_ntz")
    if tz.upper() in ("UTC", "Z", "GMT"):
        return ntz
    return F.convert_timezone(F.lit(tz), F.lit("UTC"), ntz)


def time_to_expiry(expiry, as_of, market_tz: str = "America/New_York") -> Column:
    """Years from ``as_of`` to the market close of ``expiry``, floored at one
    day.  The close is the expiry's midnight in ``market_tz`` plus 16 hours of
    elapsed time (so on a DST-switch day it falls at 15:00 or 17:00 local),
    ``as_of`` is a wall-clock time in ``market_tz``, and the difference is
    taken in absolute seconds."""
    midnight = as_col(expiry).cast("date").cast("timestamp_ntz")
    close_utc = to_utc_wall(midnight, market_tz) + F.expr(f"INTERVAL {EXPIRY_CLOSE_HOUR} HOURS")
    micros = F.timestamp_diff("MICROSECOND", to_utc_wall(as_of, market_tz), close_utc)
    years = micros.cast("double") / 1e6 / SECONDS_PER_YEAR
    return F.greatest(years, F.lit(1.0 / 365.0))


def with_greeks(df: DataFrame, spot, strike, sigma, option_type, t_years,
                r: float = RISK_FREE, prefix: str = "") -> DataFrame:
    """Add delta, gamma, theta (per day) and vega (per vol point), rounded
    to 4 (half-even).  Invalid inputs (strike, sigma or spot <= 0, NULLs)
    give NULL for all four.  Any type other than ``'call'`` is priced as a
    put.

    Built in two projections: d1/d2 first, then the CDFs over those columns.
    The optimizer keeps them apart (collapsing would duplicate the
    expensive d1 expression), so the generated code stays small enough for
    whole-stage codegen.
    """
    S, K, sig, T = (as_col(spot).cast("double"), as_col(strike).cast("double"),
                    as_col(sigma).cast("double"), as_col(t_years))
    valid = (sig > 0) & (K > 0) & (S > 0)
    staged = df.select(
        "*", S.alias("_gS"), K.alias("_gK"), sig.alias("_gsig"), T.alias("_gT"),
        (as_col(option_type) == F.lit("call")).alias("_gcall"), valid.alias("_gok"))
    S, K, sig, T = F.col("_gS"), F.col("_gK"), F.col("_gsig"), F.col("_gT")
    sqrt_t = F.sqrt(T)
    d1 = (F.log(S / K) + (F.lit(r) + sig * sig / 2.0) * T) / (sig * sqrt_t)
    staged = staged.withColumn("_gd1", F.when(F.col("_gok"), d1))
    staged = staged.withColumn("_gd2", F.col("_gd1") - sig * sqrt_t)
    # the two normal tails and the density, once each: N(d1), N(d2) and
    # N(-d2) all follow from P(Z > |d1|) and P(Z > |d2|)
    staged = (staged.withColumn("_gt1", normal_tail(F.abs(F.col("_gd1"))))
              .withColumn("_gt2", normal_tail(F.abs(F.col("_gd2"))))
              .withColumn("_gp1", norm_pdf(F.col("_gd1"))))
    d1, d2, is_call = F.col("_gd1"), F.col("_gd2"), F.col("_gcall")
    pdf1 = F.col("_gp1")
    cdf1 = cdf_from_tail(d1, "_gt1")
    delta = F.when(is_call, cdf1).otherwise(cdf1 - 1.0)
    gamma = pdf1 / (S * sig * sqrt_t)
    decay = -S * pdf1 * sig / (2.0 * sqrt_t)
    carry = F.lit(r) * K * F.exp(-F.lit(r) * T)
    theta = F.when(is_call, decay - carry * cdf_from_tail(d2, "_gt2")) \
        .otherwise(decay + carry * cdf_from_tail(-d2, "_gt2")) / 365.0
    vega = S * pdf1 * sqrt_t / 100.0
    out = staged
    for name, c in (("delta", delta), ("gamma", gamma), ("theta", theta), ("vega", vega)):
        out = out.withColumn(prefix + name,
                             F.when(F.col("_gok"), F.bround(c, 4)).otherwise(F.lit(None).cast("double")))
    return out.drop("_gS", "_gK", "_gsig", "_gT", "_gcall", "_gok", "_gd1", "_gd2", "_gt1", "_gt2",
                    "_gp1")
