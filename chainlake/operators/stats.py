"""Distribution statistics of implied volatility, per group (ticker, side).

Everything reduces with aggregations that combine partially before the
shuffle.  Order statistics (exact quartiles, Q-Q ranks) never sort a whole
group in one task: values are first counted (ties collapse), then dealt to the
ranges between approximate quantiles; range offsets come from a window over the
small table of ranges, and exact ranks from a window inside each range.  Expanding ranks back to one row per observation is
chunked, so a value repeated a billion times still spreads over many tasks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chainlake.functions.classify import market_hours
from chainlake.functions.pricing import norm_cdf
from chainlake.functions.stats import with_norm_ppf, with_t_two_sided
from chainlake.functions.util import safe_div

SQRT_2PI = math.sqrt(2.0 * math.pi)
# Chart parameters of the reference's notebook.
HIST_BINS = 50
SIDE_HIST_BINS = 60
FIT_GRID = 300
KDE_GRID = 1000
WHISKER = 1.5
ALPHA = 0.05


def iv_sample(opts: DataFrame, lo: float = 0.01, hi: float = 2.0, hours=(9, 18),
              side: str | None = None) -> DataFrame:
    """IV in percent of market-hours snapshots with lo < iv < hi."""
    iv = F.col("impliedVolatility")
    rows = opts.filter((iv > lo) & (iv < hi) & market_hours("snapshot_time", *hours))
    if side is not None:
        rows = rows.filter(F.col("option_type") == side)
    return rows.select("ticker", "option_type", (iv * 100).alias("iv"))


def near_atm_sample(opts: DataFrame, px: DataFrame, band: float = 0.05, lo: float = 0.01,
                    hi: float = 2.0, hours=(9, 18)) -> DataFrame:
    """The same sample restricted to strikes within +-band of the close of
    the snapshot's own day (days without a price row drop out)."""
    from chainlake.operators.gold import atm_band

    iv = F.col("impliedVolatility")
    rows = opts.filter((iv > lo) & (iv < hi) & market_hours("snapshot_time", *hours))
    j = atm_band(rows, px, band=band, spot_mode="same_day")
    return j.select("ticker", "option_type", (iv * 100).alias("iv"), "strike", "spot")


def moments(sample: DataFrame, by=("ticker",), x: str = "iv") -> DataFrame:
    """n, mean, sample std, bias-corrected skewness G1 and excess kurtosis G2
    (the estimators pandas reports)."""
    v = F.col(x)
    a = sample.groupBy(*by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"),
                                F.stddev_samp(v).alias("std"), F.skewness(v).alias("_g1"),
                                F.kurtosis(v).alias("_g2"))
    n = F.col("n").cast("double")
    g1 = F.when(n > 2, F.col("_g1") * F.sqrt(n * (n - 1)) / (n - 2))
    g2 = F.when(n > 3, ((n + 1) * F.col("_g2") + 6) * (n - 1) / ((n - 2) * (n - 3)))
    return a.select(*by, "n", "mean", "std", g1.alias("skew"), g2.alias("kurtosis"))


def _range(sample: DataFrame, by, x: str) -> DataFrame:
    return sample.groupBy(*by).agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"),
                                   F.count(F.col(x)).alias("_n"))


def histogram(sample: DataFrame, bins: int = HIST_BINS, by=("ticker",), x: str = "iv") -> DataFrame:
    """Equal-width bins over each group's [min, max] (last bin closed), as a
    density.  Values are bucketed where they are (one range row per group is
    broadcast), counted with partial aggregation, then joined to the full bin
    list so empty bins appear with 0."""
    rng = _range(sample, by, x)
    lo, hi = F.col("_lo"), F.col("_hi")
    width = (hi - lo) / bins
    scaled = (F.col(x) - lo) * safe_div(F.lit(float(bins)), hi - lo)
    idx = F.when(hi > lo, F.least(F.floor(scaled), F.lit(bins - 1))).otherwise(F.lit(0)).cast("long")
    counts = (sample.join(rng, list(by)).groupBy(*by, idx.alias("bin"))
              .agg(F.count(F.lit(1)).alias("count")))
    grid = rng.select(*by, "_lo", "_hi", "_n",
                      F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))).alias("bin"))
    out = grid.join(counts, [*by, "bin"], "left").fillna(0, ["count"])
    w = F.when(hi > lo, width).otherwise(F.lit(1.0))
    return out.select(*by, "bin", (lo + F.col("bin") * width).alias("bin_lo"),
                      (lo + (F.col("bin") + 1) * width).alias("bin_hi"), "count",
                      (F.col("count") / (F.col("_n") * w)).alias("density"))


def _grid(stats: DataFrame, by, points: int, lo: str, hi: str) -> DataFrame:
    """``points`` evenly spaced x values from lo to hi inclusive per group
    (numpy ``linspace``: the last point is exactly hi)."""
    k = F.col("k")
    step = (F.col(hi) - F.col(lo)) / (points - 1)
    g = stats.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(points - 1).cast("long"))).alias("k"))
    return g.withColumn("x", F.when(k == points - 1, F.col(hi)).otherwise(F.col(lo) + k * step))


def normal_fit(sample: DataFrame, by=("ticker",), x: str = "iv", points: int = FIT_GRID) -> DataFrame:
    """Normal fit (mean, sample std) and its density on a grid over [min, max];
    the density of a group without spread is NULL."""
    st = sample.groupBy(*by).agg(F.avg(x).alias("mu"), F.stddev_samp(x).alias("sigma"),
                                 F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    g = _grid(st, by, points, "_lo", "_hi")
    z = safe_div(F.col("x") - F.col("mu"), F.col("sigma"))
    pdf = safe_div(F.exp(-z * z / 2.0), F.col("sigma") * SQRT_2PI)
    return g.select(*by, "mu", "sigma", "k", "x", pdf.alias("pdf"))


def lognormal_fit(sample: DataFrame, by=("ticker",), x: str = "iv", points: int = FIT_GRID) -> DataFrame:
    """Log-normal maximum-likelihood fit with location 0: shape = population
    std of ln x, scale = exp(mean ln x); density on the same grid, NULL for a
    group without spread."""
    lx = F.log(F.col(x))
    st = sample.filter(F.col(x) > 0).groupBy(*by).agg(
        F.stddev_pop(lx).alias("shape"), F.exp(F.avg(lx)).alias("scale"),
        F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    g = _grid(st, by, points, "_lo", "_hi")
    s, xx = F.col("shape"), F.col("x")
    u = safe_div(F.log(xx / F.col("scale")), s)
    pdf = F.when(xx > 0, safe_div(F.exp(-u * u / 2.0), xx * s * SQRT_2PI)).otherwise(F.lit(0.0))
    return g.select(*by, "shape", F.lit(0.0).alias("loc"), "scale", "k", "x", pdf.alias("pdf"))


# Cut points per group for the distributed rank.
RANK_CUTS = 1023


def _bucket(cuts: Column, x: Column, most: int) -> Column:
    """Number of cut points, of at most ``most``, below ``x``, by halving steps."""
    steps = [1 << k for k in range(most.bit_length() - 1, -1, -1)]
    return F.aggregate(F.array(*[F.lit(k) for k in steps]), F.lit(0), lambda pos, k: F.when(
        (pos + k <= F.size(cuts)) & (F.element_at(cuts, F.least(pos + k, F.size(cuts))) < x), pos + k).otherwise(pos))


def ranked_values(sample: DataFrame, by=("ticker",), x: str = "iv", cuts: int = RANK_CUTS) -> DataFrame:
    """Distinct values per group with their multiplicity ``m`` and first
    1-based rank ``start`` in ascending order, plus the group size ``n``.

    Values are counted (ties collapse) and dealt to the ranges between
    ``cuts`` approximate quantiles of their group, a parameter that does not
    depend on the data.  Ranks inside a range come from a window over (group,
    range), offsets from a window over the small table of ranges.  The cut
    points only balance the ranges; the ranks are exact."""
    vals = (sample.filter(F.col(x).isNotNull()).groupBy(*by, x).agg(F.count(F.lit(1)).alias("m"))
            .filter(F.col("m") > 0))  # keeps ``m`` in every use, so that they share one exchange
    probs = [i / (cuts + 1) for i in range(1, cuts + 1)]
    at = vals.groupBy(*by).agg(F.percentile_approx(x, probs, 10 * cuts).alias("_cuts"), F.sum("m").alias("n"))
    b = vals.join(at, list(by)).withColumn("_b", _bucket(F.col("_cuts"), F.col(x), cuts)).drop("_cuts")
    per_b = b.groupBy(*by, "_b").agg(F.sum("m").alias("_bm"))
    off = F.coalesce(F.sum("_bm").over(Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per_b = per_b.select(*by, "_b", off.alias("_off"))
    wi = Window.partitionBy(*by, "_b").orderBy(x)
    start = F.col("_off") + F.sum("m").over(wi) - F.col("m") + 1
    return b.join(per_b, [*by, "_b"]).select(*by, x, "m", start.alias("start"), "n")


def expand_ranks(ranked: DataFrame, chunk: int = 1 << 20) -> DataFrame:
    """One row per observation (``i`` = rank) from (value, m, start).  A
    heavy value is first split into chunks of at most ``chunk`` ranks and
    the chunks are spread by a repartition before they are exploded."""
    n_chunks = F.ceil(F.col("m") / F.lit(chunk)).cast("int")
    parts = ranked.select("*", F.explode(F.sequence(F.lit(0), n_chunks - 1)).alias("_c"))
    lo = F.col("start") + F.col("_c") * chunk
    hi = F.least(lo + chunk - 1, F.col("start") + F.col("m") - 1)
    parts = parts.select("*", lo.alias("_lo"), hi.alias("_hi")).repartition("_lo")
    return parts.select("*", F.explode(F.sequence("_lo", "_hi")).alias("i")) \
        .drop("_c", "_lo", "_hi")


def filliben(i, n) -> F.Column:
    """Filliben's order-statistic medians of the uniform distribution."""
    i, n = F.col(i).cast("double"), F.col(n).cast("double")
    last = F.pow(F.lit(0.5), 1.0 / n)
    return (F.when(i == n, last).when(i == 1, 1.0 - last)
            .otherwise((i - 0.3175) / (n + 0.365)))


def qq_points(sample: DataFrame, by=("ticker",), x: str = "iv", cuts: int = RANK_CUTS) -> DataFrame:
    """Normal probability plot points: theoretical quantile ``osm`` (inverse
    normal of Filliben's medians) against the ordered sample ``osr``."""
    r = expand_ranks(ranked_values(sample, by, x, cuts))
    r = r.select(*by, "i", "n", filliben("i", "n").alias("_m"), F.col(x).alias("osr"))
    return with_norm_ppf(r, "_m", "osm").select(*by, "i", "n", "osm", "osr")


def qq_fit(points: DataFrame, by=("ticker",)) -> DataFrame:
    """Least-squares line through the Q-Q points and its correlation r."""
    return points.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.regr_slope("osr", "osm").alias("slope"),
        F.regr_intercept("osr", "osm").alias("intercept"), F.corr("osm", "osr").alias("r"))


def box_stats(sample: DataFrame, by=("ticker",), x: str = "iv", whisker: float = WHISKER,
              cuts: int = RANK_CUTS) -> DataFrame:
    """Quartiles (linear interpolation between order statistics), whiskers
    at the most extreme points within ``whisker`` x IQR of the box, and the
    outlier count -- exact, all from the (value, count, rank) rows."""
    ranked = ranked_values(sample, by, x, cuts)
    v, n = F.col(x), F.col("n")

    def holds(k: Column) -> Column:
        return F.max(F.when((k >= F.col("start")) & (k < F.col("start") + F.col("m")), v))
    aggs = []
    for name, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75)):
        h = (n - 1) * p + 1  # between the order statistics floor(h) and ceil(h)
        lo, hi = holds(F.floor(h).cast("long")), holds(F.least(F.ceil(h), n).cast("long"))
        aggs.append((lo + F.max(h - F.floor(h)) * (hi - lo)).alias(name))
    iqr = F.col("q3") - F.col("q1")
    fences = ranked.groupBy(*by).agg(*aggs).select("*", (F.col("q1") - whisker * iqr).alias("_lf"),
                                                   (F.col("q3") + whisker * iqr).alias("_uf"))
    inside = (v >= F.col("_lf")) & (v <= F.col("_uf"))
    return (ranked.join(fences, list(by)).groupBy(*by, "q1", "median", "q3")
            .agg(F.min(F.when(inside, v)).alias("whisker_lo"), F.max(F.when(inside, v)).alias("whisker_hi"),
                 F.coalesce(F.sum(F.when(~inside, F.col("m"))), F.lit(0)).alias("outliers"))
            .select(*by, "q1", "median", "q3", iqr.alias("iqr"), "whisker_lo", "whisker_hi", "outliers"))


def kde(sample: DataFrame, by=("ticker",), x: str = "iv", grid: int = KDE_GRID,
        bins: int = 4096, log: bool = False) -> DataFrame:
    """Gaussian kernel density estimate (Scott's bandwidth: sample std x
    n^(-1/5)) on ``grid`` points spanning [min - range/2, max + range/2].
    ``log=True`` estimates the density of ln x.  A group without spread has
    NULL densities.

    Binned form: values are counted (ties collapse), then counted into ``bins``
    equal bins of their group; each bin adds its share of the kernel to every
    grid point, ``bins`` x ``grid`` steps a group whatever its size."""
    return _kde(sample.select(*by, (F.log(x) if log else F.col(x)).alias("_v")), by, grid, bins)


def kde_series(sample: DataFrame, by=("ticker",), x: str = "iv", **kw) -> DataFrame:
    """``kde`` of x and of ln x (column ``series``), in one pass."""
    both = F.inline(F.array(F.struct(F.lit(x).alias("series"), F.col(x).alias("_v")),
                            F.struct(F.lit(f"log_{x}").alias("series"), F.log(x).alias("_v"))))
    return _kde(sample.select(*by, both), (*by, "series"), **kw)


def _kde(s: DataFrame, by, grid: int = KDE_GRID, bins: int = 4096) -> DataFrame:
    vals = (s.filter(F.col("_v").isNotNull()).groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("m"))
            .filter(F.col("m") > 0))  # keeps ``m`` in every use, so that they share one exchange
    v, m, lo, hi = F.col("_v"), F.col("m"), F.col("_lo"), F.col("_hi")
    st = vals.groupBy(*by).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.sum("m").cast("double").alias("_n"),
                               (F.sum(m * v) / F.sum("m")).alias("_mean"))
    idx = F.when(hi > lo, F.least(F.floor((v - lo) * (F.lit(float(bins)) / (hi - lo))), F.lit(bins - 1))).otherwise(F.lit(0)).cast("int")
    counts = (vals.join(st, list(by)).groupBy(*by, "_lo", "_hi", "_n", idx.alias("_b"))
              .agg(F.sum("m").cast("double").alias("_c"), F.sum(m * (v - F.col("_mean")) * (v - F.col("_mean"))).alias("_d")))
    # at most ``bins`` rows of a group
    var = safe_div(F.sum("_d").over(Window.partitionBy(*by)), F.col("_n") - 1)
    width = (hi - lo) / bins
    counts = counts.select(*by, "_n", "_c", (lo + (F.col("_b") + 0.5) * width).alias("_x"), (lo - 0.5 * (hi - lo)).alias("_from"),
                           (hi + 0.5 * (hi - lo)).alias("_to"), F.when(hi > lo, F.sqrt(var) * F.pow("_n", F.lit(-0.2))).alias("h"))
    k = F.col("k")
    at = F.when(k == grid - 1, F.col("_to")).otherwise(k * ((F.col("_to") - F.col("_from")) / (grid - 1)) + F.col("_from"))
    points = counts.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(grid - 1).cast("long"))).alias("k")).withColumn("x", at)
    z = (F.col("x") - F.col("_x")) / F.col("h")
    out = points.groupBy(*by, "k").agg(F.first("x").alias("x"), F.first("h").alias("bandwidth"), F.first("_n").alias("_n"),
                                       F.sum(F.col("_c") * F.exp(-0.5 * z * z)).alias("_sum"))
    return out.select(*by, "k", "x", safe_div(F.col("_sum"), F.col("_n") * F.col("bandwidth") * SQRT_2PI).alias("density"), "bandwidth")


def two_sample(sample: DataFrame, by=("ticker",), side: str = "option_type", x: str = "iv",
               a: str = "call", b: str = "put") -> DataFrame:
    """Per group: n, mean and sample variance of both sides in one
    aggregation (conditional aggregates, no self-join)."""
    v = F.col(x)
    aggs = []
    for tag, val in (("a", a), ("b", b)):
        sv = F.when(F.col(side) == val, v)
        aggs += [F.count(sv).alias(f"n_{tag}"), F.avg(sv).alias(f"mean_{tag}"),
                 F.var_samp(sv).alias(f"var_{tag}")]
    return sample.groupBy(*by).agg(*aggs)


def welch_ttest(sample: DataFrame, by=("ticker",), alpha: float = ALPHA, with_p: bool = True) -> DataFrame:
    """Welch's unequal-variance t-test, calls minus puts: t, Welch-Satterthwaite
    df, and (``with_p``) two-sided p.  A side of fewer than two rows, or no variance on either
    side, gives NULL t, df and p."""
    s = two_sample(sample, by)
    va, vb = safe_div("var_a", F.col("n_a")), safe_div("var_b", F.col("n_b"))
    t = safe_div(F.col("mean_a") - F.col("mean_b"), F.sqrt(va + vb))
    dof = safe_div((va + vb) * (va + vb), safe_div(va * va, F.col("n_a") - 1) + safe_div(vb * vb, F.col("n_b") - 1))
    out = s.select(*by, F.col("n_a").alias("n_calls"), F.col("n_b").alias("n_puts"),
                   F.col("mean_a").alias("mean_calls"), F.col("mean_b").alias("mean_puts"),
                   t.alias("t"), dof.alias("df"))
    if not with_p:
        return out
    return with_t_two_sided(out, by, "t", "df", "p").withColumn("significant", F.col("p") < alpha)


def ztest(sample: DataFrame, by=("ticker",), alpha: float = ALPHA) -> DataFrame:
    """Two-sample z-test with pooled variance, calls minus puts, two-sided p
    from the normal CDF expression.  Without variance z and p are NULL."""
    s = two_sample(sample, by)
    na, nb = F.col("n_a"), F.col("n_b")
    pooled = safe_div((na - 1) * F.col("var_a") + (nb - 1) * F.col("var_b"), na + nb - 2)
    z = safe_div(F.col("mean_a") - F.col("mean_b"), F.sqrt(pooled * (safe_div(F.lit(1.0), na) + safe_div(F.lit(1.0), nb))))
    out = s.select(*by, na.alias("n_calls"), nb.alias("n_puts"), z.alias("z"))
    p = 2.0 * norm_cdf(-F.abs(F.col("z")))
    return out.withColumn("p", p).withColumn("significant", F.col("p") < alpha)


def mean_gap(sample: DataFrame, by=("ticker",)) -> DataFrame:
    """Put mean minus call mean (percentage points)."""
    s = two_sample(sample, by)
    return s.select(*by, F.col("mean_a").alias("mean_calls"), F.col("mean_b").alias("mean_puts"),
                    (F.col("mean_b") - F.col("mean_a")).alias("put_minus_call"))
