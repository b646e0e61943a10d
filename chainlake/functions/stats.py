"""Distribution helpers as Column expressions: the inverse normal CDF and the
tail of Student's t."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainlake.functions.util import as_col

# ---------------------------------------------------------------------------
# M. J. Wichura, "Algorithm AS 241: The percentage points of the
# normal distribution", Applied Statistics 37 (1988), PPND16.  Coefficients in
# natural order (constant term first), as published.
# ---------------------------------------------------------------------------
PPF_SPLIT1, PPF_SPLIT2 = 0.425, 5.0
PPF_CONST1, PPF_CONST2 = 0.180625, 1.6
PPF_A = (3.387132872796366608, 133.14166789178437745, 1971.5909503065514427,
         13731.693765509461125, 45921.953931549871457, 67265.770927008700853,
         33430.575583588128105, 2509.0809287301226727)
PPF_B = (1.0, 42.313330701600911252, 687.1870074920579083, 5394.1960214247511077,
         21213.794301586595867, 39307.89580009271061, 28729.085735721942674,
         5226.495278852545925)
PPF_C = (1.42343711074968357734, 4.6303378461565452959, 5.7694972214606914055,
         3.64784832476320460504, 1.27045825245236838258, 0.24178072517745061177,
         0.0227238449892691845833, 7.7454501427834140764e-4)
PPF_D = (1.0, 2.05319162663775882187, 1.6763848301838038494, 0.68976733498510000455,
         0.14810397642748007459, 0.0151986665636164571966, 5.475938084995344946e-4,
         1.05075007164441684324e-9)
PPF_E = (6.6579046435011037772, 5.4637849111641143699, 1.7848265399172913358,
         0.29656057182850489123, 0.026532189526576123093, 0.0012426609473880784386,
         2.71155556874348757815e-5, 2.01033439929228813265e-7)
PPF_F = (1.0, 0.59983220655588793769, 0.13692988092273580531, 0.0148753612908506148525,
         7.868691311456132591e-4, 1.8463183175100546818e-5, 1.4215117583164458887e-7,
         2.04426310338993978564e-15)


def poly(coeffs, x: Column) -> Column:
    """sum(c_k x^k), Horner from the highest power."""
    acc = F.lit(coeffs[-1])
    for c in reversed(coeffs[:-1]):
        acc = acc * x + F.lit(c)
    return acc


def norm_ppf(p) -> Column:
    """Inverse standard normal CDF (relative accuracy about 1e-16)."""
    p = as_col(p)
    q = p - 0.5
    r1 = F.lit(PPF_CONST1) - q * q
    central = q * poly(PPF_A, r1) / poly(PPF_B, r1)
    r = F.sqrt(-F.log(F.when(q < 0, p).otherwise(1.0 - p)))
    mid = poly(PPF_C, r - PPF_CONST2) / poly(PPF_D, r - PPF_CONST2)
    far = poly(PPF_E, r - PPF_SPLIT2) / poly(PPF_F, r - PPF_SPLIT2)
    tail = F.when(r <= PPF_SPLIT2, mid).otherwise(far)
    tail = F.when(q < 0, -tail).otherwise(tail)
    return (F.when((p <= 0) | (p >= 1) | p.isNull(), F.lit(None).cast("double"))
            .when(F.abs(q) <= PPF_SPLIT1, central).otherwise(tail))


def with_norm_ppf(df, p: str, out: str):
    """``norm_ppf`` in stages: p, then q and r as columns, then the rational
    functions over those columns -- the optimizer keeps the projections
    apart, so each input is computed once and codegen stays small."""
    pc = F.col(p)
    staged = df.withColumn("_pq", pc - 0.5)
    staged = staged.withColumn(
        "_pr", F.when(F.abs(F.col("_pq")) > PPF_SPLIT1,
                      F.sqrt(-F.log(F.when(F.col("_pq") < 0, pc).otherwise(1.0 - pc)))))
    staged = staged.withColumn("_pr1", F.lit(PPF_CONST1) - F.col("_pq") * F.col("_pq"))
    q, r, r1 = F.col("_pq"), F.col("_pr"), F.col("_pr1")
    central = q * poly(PPF_A, r1) / poly(PPF_B, r1)
    mid = poly(PPF_C, r - PPF_CONST2) / poly(PPF_D, r - PPF_CONST2)
    far = poly(PPF_E, r - PPF_SPLIT2) / poly(PPF_F, r - PPF_SPLIT2)
    tail = F.when(r <= PPF_SPLIT2, mid).otherwise(far)
    tail = F.when(q < 0, -tail).otherwise(tail)
    val = (F.when((pc <= 0) | (pc >= 1) | pc.isNull(), F.lit(None).cast("double"))
           .when(F.abs(q) <= PPF_SPLIT1, central).otherwise(tail))
    return staged.withColumn(out, val).drop("_pq", "_pr", "_pr1")


# ---------------------------------------------------------------------------
# Student t tail as a Column expression: Gauss-Legendre quadrature of the
# density over [|t|, inf), mapped to (0, 1).
# ---------------------------------------------------------------------------

T_NODES = 96
_SHIFT = 20  # steps of the recurrence before the asymptotic series


def _log_gamma_ratio(df: Column) -> Column:
    """ln(Gamma((df + 1) / 2) / Gamma(df / 2)): the recurrence
    R(n) = R(n + 2) n / (n + 1), then the asymptotic series of R, so nothing
    cancels for large ``df``."""
    n = df + 2 * _SHIFT
    series = 0.5 * F.log(n / 2) - 1 / (4 * n) + 1 / (24 * n * n * n) - 1 / (20 * n * n * n * n * n)
    steps = F.aggregate(F.sequence(F.lit(0), F.lit(_SHIFT - 1)), F.lit(0.0),
                        lambda acc, k: acc - F.log1p(1 / (df + 2 * k)))
    return series + steps


def with_t_two_sided(df: DataFrame, keys, t: str, dof: str, out: str) -> DataFrame:
    """``df``, one row per ``keys``, with P(|T| >= |t|) for Student's t in
    ``out``; NULL unless ``dof`` > 0 and both are numbers.  ``dof`` may be
    fractional and of any size.

    Gauss-Legendre quadrature as rows: the few result rows meet the nodes, and
    the terms are summed.  As one expression of all nodes it would cost the
    planner seconds."""
    d = F.when((F.col(dof) > 0) & ~F.isnan(dof), F.col(dof))
    lo = F.abs(F.col(t))
    x, w = np.polynomial.legendre.leggauss(T_NODES)
    nodes = F.array(*[F.struct(F.lit(float((a + 1) / 2)).alias("v"), F.lit(float(b / 2)).alias("w")) for a, b in zip(x, w)])
    # four times the length over which the density falls off beyond t
    far = 4 / (1 / (1 + lo) + (d + 1) * lo / (d + lo * lo))
    norm = _log_gamma_ratio(d) - 0.5 * F.log(d * math.pi)
    rows = df.withColumns({"_d": d, "_lo": lo, "_far": far, "_norm": norm}).select("*", F.inline(nodes))
    u = F.col("_lo") + F.col("_far") * F.col("v") / (1 - F.col("v"))
    term = (F.col("w") * F.exp(F.col("_norm") - (F.col("_d") + 1) / 2 * F.log1p(u * u / F.col("_d")))
            * F.col("_far") / ((1 - F.col("v")) * (1 - F.col("v"))))
    rest = [c for c in df.columns if c not in keys]
    total = 2 * F.sum(F.when(~F.isnan("_lo"), term))
    p = F.when(total.isNotNull(), F.least(total, F.lit(1.0)))
    return rows.groupBy(*keys).agg(*[F.first(c).alias(c) for c in rest], p.alias(out)).select(*df.columns, out)
