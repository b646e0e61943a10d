"""Registered queries: IV distribution statistics per ticker (the notebook's
analysis, for every ticker at once)."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from chainlake.operators import stats as S
from chainlake.plans.catalog import register
from chainlake.plans.oracle import f, norm_cdf_sql, norm_ppf_sql, sql
from chainlake.plans.tables import Tables

SAMPLE_SQL = """
iv_sample AS (
  SELECT ticker, option_type, impliedVolatility * 100 AS iv FROM bronze_options_raw
  WHERE impliedVolatility > 0.01 AND impliedVolatility < 2 AND hour(snapshot_time) BETWEEN 9 AND 18),
near_sample AS (
  SELECT b.ticker, b.option_type, b.impliedVolatility * 100 AS iv, b.strike, p."Close" AS spot
  FROM bronze_options_raw b
  JOIN silver_price_daily p ON p.ticker = b.ticker AND p."Date" = CAST(b.snapshot_time AS DATE)
  WHERE b.impliedVolatility > 0.01 AND b.impliedVolatility < 2 AND hour(b.snapshot_time) BETWEEN 9 AND 18
    AND b.strike BETWEEN p."Close" * CAST(0.95 AS DOUBLE) AND p."Close" * CAST(1.05 AS DOUBLE))"""


def _sample(spark, sf_dir):
    return S.iv_sample(Tables(spark, sf_dir).bronze_options())


def _near(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return S.near_atm_sample(t.bronze_options(), t.silver_price())


def _r(df, cols, digits=8):
    for c in cols:
        df = df.withColumn(c, F.round(c, digits))
    return df


@register("iv_sample", sql("SELECT * FROM iv_sample", extra=SAMPLE_SQL))
def q_iv_sample(spark, sf_dir):
    return _sample(spark, sf_dir)


@register("iv_moments", sql("""
SELECT ticker, count(iv) AS n, round(avg(iv), 8) AS mean, round(stddev_samp(iv), 8) AS std,
       round(skewness(iv), 8) AS skew, round(kurtosis(iv), 8) AS kurtosis
FROM iv_sample GROUP BY ticker""", extra=SAMPLE_SQL))
def q_iv_moments(spark, sf_dir):
    return _r(S.moments(_sample(spark, sf_dir)), ["mean", "std", "skew", "kurtosis"])


def _hist_sql(src: str, keys: str, bins: int) -> str:
    jk = " AND ".join(f"s.{k} = r.{k}" for k in keys.split(", "))
    return f"""
h_rng AS (SELECT {keys}, min(iv) AS lo, max(iv) AS hi, count(iv) AS n FROM {src} GROUP BY {keys}),
h_cnt AS (
  SELECT {", ".join("s." + k for k in keys.split(", "))},
         CASE WHEN r.hi > r.lo THEN least(CAST(floor((s.iv - r.lo) * (CAST({bins} AS DOUBLE) / (r.hi - r.lo))) AS INTEGER), {bins - 1})
              ELSE 0 END AS bin, count(*) AS c
  FROM {src} s JOIN h_rng r ON {jk} GROUP BY ALL),
h_grid AS (SELECT *, unnest(range(0, {bins})) AS bin FROM h_rng),
hist AS (
  SELECT {", ".join("g." + k for k in keys.split(", "))}, g.bin,
         round(g.lo + g.bin * ((g.hi - g.lo) / {bins}), 10) AS bin_lo,
         round(g.lo + (g.bin + 1) * ((g.hi - g.lo) / {bins}), 10) AS bin_hi,
         coalesce(c.c, 0) AS "count",
         round(coalesce(c.c, 0) / (g.n * CASE WHEN g.hi > g.lo THEN (g.hi - g.lo) / {bins} ELSE 1.0 END), 10)
           AS density
  FROM h_grid g LEFT JOIN h_cnt c ON {" AND ".join(f"c.{k} = g.{k}" for k in keys.split(", "))} AND c.bin = g.bin)"""


@register("iv_histogram", sql("SELECT * FROM hist", extra=SAMPLE_SQL + "," + _hist_sql("iv_sample", "ticker", S.HIST_BINS)))
def q_iv_histogram(spark, sf_dir):
    return _r(S.histogram(_sample(spark, sf_dir), S.HIST_BINS), ["bin_lo", "bin_hi", "density"], 10)


@register("iv_histogram_sides", sql("SELECT * FROM hist", extra=SAMPLE_SQL + "," + _hist_sql(
    "near_sample", "ticker, option_type", S.SIDE_HIST_BINS)))
def q_iv_histogram_sides(spark, sf_dir):
    h = S.histogram(_near(spark, sf_dir), S.SIDE_HIST_BINS, by=("ticker", "option_type"))
    return _r(h, ["bin_lo", "bin_hi", "density"], 10)


def _grid_sql(points: int, lo: str, hi: str) -> str:
    return (f"CASE WHEN k = {points - 1} THEN {hi} "
            f"ELSE {lo} + k * (({hi} - {lo}) / {points - 1}) END")


@register("normal_fit", sql(f"""
SELECT ticker, round(mu, 8) AS mu, round(sigma, 8) AS sigma, k, round(x, 8) AS x,
       round(exp(-((x - mu) / sigma) * ((x - mu) / sigma) / 2.0) / (sigma * {f(math.sqrt(2 * math.pi))}), 10) AS pdf
FROM (SELECT *, {_grid_sql(S.FIT_GRID, 'lo', 'hi')} AS x
      FROM (SELECT ticker, avg(iv) AS mu, stddev_samp(iv) AS sigma, min(iv) AS lo, max(iv) AS hi
            FROM iv_sample GROUP BY ticker), range(0, {S.FIT_GRID}) t(k))""", extra=SAMPLE_SQL))
def q_normal_fit(spark, sf_dir):
    return _r(_r(S.normal_fit(_sample(spark, sf_dir)), ["mu", "sigma", "x"]), ["pdf"], 10)


@register("lognormal_fit", sql(f"""
SELECT ticker, round(shape, 8) AS shape, CAST(0.0 AS DOUBLE) AS loc, round(scale, 8) AS scale, k, round(x, 8) AS x,
       round(CASE WHEN x > 0 THEN exp(-(ln(x / scale) / shape) * (ln(x / scale) / shape) / 2.0)
                  / (x * shape * {f(math.sqrt(2 * math.pi))}) ELSE 0.0 END, 10) AS pdf
FROM (SELECT *, {_grid_sql(S.FIT_GRID, 'lo', 'hi')} AS x
      FROM (SELECT ticker, stddev_pop(ln(iv)) AS shape, exp(avg(ln(iv))) AS scale, min(iv) AS lo,
                   max(iv) AS hi FROM iv_sample WHERE iv > 0 GROUP BY ticker), range(0, {S.FIT_GRID}) t(k))""",
                               extra=SAMPLE_SQL))
def q_lognormal_fit(spark, sf_dir):
    return _r(_r(S.lognormal_fit(_sample(spark, sf_dir)), ["shape", "scale", "x"]), ["pdf"], 10)


FILLIBEN_SQL = ("CASE WHEN i = n THEN pow(0.5, 1.0 / n) WHEN i = 1 THEN 1.0 - pow(0.5, 1.0 / n) "
                "ELSE (i - 0.3175) / (n + 0.365) END")
QQ_SQL = f"""
qq_rank AS (SELECT ticker, iv, CAST(row_number() OVER (PARTITION BY ticker ORDER BY iv) AS DOUBLE) AS i,
                   CAST(count(*) OVER (PARTITION BY ticker) AS DOUBLE) AS n FROM iv_sample),
qq AS (SELECT ticker, CAST(i AS BIGINT) AS i, CAST(n AS BIGINT) AS n, {norm_ppf_sql(f'({FILLIBEN_SQL})')} AS osm,
              iv AS osr FROM qq_rank)"""


@register("qq_plot", sql("SELECT ticker, i, n, round(osm, 10) AS osm, osr FROM qq",
                         extra=SAMPLE_SQL + "," + QQ_SQL))
def q_qq_plot(spark, sf_dir):
    return _r(S.qq_points(_sample(spark, sf_dir)), ["osm"], 10)


@register("qq_fit", sql("""
SELECT ticker, count(*) AS n, round(regr_slope(osr, osm), 8) AS slope,
       round(regr_intercept(osr, osm), 8) AS intercept, round(corr(osm, osr), 8) AS r
FROM qq GROUP BY ticker""", extra=SAMPLE_SQL + "," + QQ_SQL))
def q_qq_fit(spark, sf_dir):
    pts = S.qq_points(_sample(spark, sf_dir))
    return _r(S.qq_fit(pts), ["slope", "intercept", "r"])


@register("box_plot", sql("""
SELECT q.ticker, round(q1, 8) AS q1, round(median, 8) AS median, round(q3, 8) AS q3,
       round(q3 - q1, 8) AS iqr,
       round(min(s.iv) FILTER (WHERE s.iv >= q1 - 1.5 * (q3 - q1) AND s.iv <= q3 + 1.5 * (q3 - q1)), 8) AS whisker_lo,
       round(max(s.iv) FILTER (WHERE s.iv >= q1 - 1.5 * (q3 - q1) AND s.iv <= q3 + 1.5 * (q3 - q1)), 8) AS whisker_hi,
       count(*) FILTER (WHERE NOT (s.iv >= q1 - 1.5 * (q3 - q1) AND s.iv <= q3 + 1.5 * (q3 - q1))) AS outliers
FROM (SELECT ticker, quantile_cont(iv, 0.25) AS q1, quantile_cont(iv, 0.5) AS median,
             quantile_cont(iv, 0.75) AS q3 FROM iv_sample GROUP BY ticker) q
JOIN iv_sample s ON s.ticker = q.ticker GROUP BY q.ticker, q1, median, q3""", extra=SAMPLE_SQL))
def q_box_plot(spark, sf_dir):
    b = S.box_stats(_sample(spark, sf_dir))
    return _r(b, ["q1", "median", "q3", "iqr", "whisker_lo", "whisker_hi"])


def _kde_sql(series: str, expr: str, bins: int = 4096, grid: int = S.KDE_GRID, src: str = "iv_sample", where: str = "TRUE") -> str:
    src = f"(SELECT * FROM {src} WHERE {where})"
    return f"""
SELECT ticker, '{series}' AS series, k, round(x, 8) AS x,
       round(sum(c * exp(-0.5 * ((x - ctr) / h) * ((x - ctr) / h))) / (n * h * {f(math.sqrt(2 * math.pi))}), 9)
         AS density, round(h, 10) AS bandwidth
FROM (
  SELECT g.ticker, g.k, g.n, g.h,
         CASE WHEN g.k = {grid - 1} THEN g.hi + 0.5 * (g.hi - g.lo)
              ELSE g.k * (((g.hi + 0.5 * (g.hi - g.lo)) - (g.lo - 0.5 * (g.hi - g.lo))) / {grid - 1})
                   + (g.lo - 0.5 * (g.hi - g.lo)) END AS x,
         b.c, g.lo + (b.bin + 0.5) * ((g.hi - g.lo) / {bins}) AS ctr
  FROM (SELECT *, sd * pow(n, -0.2) AS h FROM (
          SELECT ticker, min(v) AS lo, max(v) AS hi, CAST(count(*) AS DOUBLE) AS n, stddev_samp(v) AS sd
          FROM (SELECT ticker, {expr} AS v FROM {src}) GROUP BY ticker), range(0, {grid}) t(k)) g
  JOIN (SELECT s.ticker, CASE WHEN r.hi > r.lo THEN least(CAST(floor((s.v - r.lo) * (CAST({bins} AS DOUBLE) / (r.hi - r.lo))) AS INTEGER), {bins - 1}) ELSE 0 END AS bin,
               count(*) AS c
        FROM (SELECT ticker, {expr} AS v FROM {src}) s
        JOIN (SELECT ticker, min({expr}) AS lo, max({expr}) AS hi FROM {src} GROUP BY ticker) r
          ON r.ticker = s.ticker GROUP BY 1, 2) b ON b.ticker = g.ticker)
GROUP BY ticker, k, x, n, h"""


@register("kde", sql(_kde_sql("iv", "iv") + "\nUNION ALL\n" + _kde_sql("log_iv", "ln(iv)"), extra=SAMPLE_SQL))
def q_kde(spark, sf_dir):
    out = S.kde_series(_sample(spark, sf_dir))
    return _r(_r(out.select("ticker", "series", "k", "x", "density", "bandwidth"), ["x"]), ["density"], 9).withColumn(
        "bandwidth", F.round("bandwidth", 10))


@register("kde_sides", sql(_kde_sql("call", "iv", src="near_sample", where="option_type = 'call'") + "\nUNION ALL\n"
                           + _kde_sql("put", "iv", src="near_sample", where="option_type = 'put'"), extra=SAMPLE_SQL))
def q_kde_sides(spark, sf_dir):
    """Near-the-money calls vs puts."""
    out = S.kde(_near(spark, sf_dir), by=("ticker", "option_type")).withColumnRenamed("option_type", "series")
    return _r(_r(out.select("ticker", "series", "k", "x", "density", "bandwidth"), ["x"]), ["density"], 9).withColumn(
        "bandwidth", F.round("bandwidth", 10))


def _two_sample_sql(src: str, label: str) -> str:
    return f"""
SELECT ticker, '{label}' AS sample,
       count(iv) FILTER (WHERE option_type = 'call') AS n_a, avg(iv) FILTER (WHERE option_type = 'call') AS mean_a,
       var_samp(iv) FILTER (WHERE option_type = 'call') AS var_a,
       count(iv) FILTER (WHERE option_type = 'put') AS n_b, avg(iv) FILTER (WHERE option_type = 'put') AS mean_b,
       var_samp(iv) FILTER (WHERE option_type = 'put') AS var_b
FROM {src} GROUP BY ticker"""


TWO_SQL = SAMPLE_SQL + f""",
two AS ({_two_sample_sql('iv_sample', 'all')} UNION ALL {_two_sample_sql('near_sample', 'near_atm')})"""


def _both(spark, sf_dir, fn):
    a = fn(_sample(spark, sf_dir)).withColumn("sample", F.lit("all"))
    b = fn(_near(spark, sf_dir)).withColumn("sample", F.lit("near_atm"))
    return a.unionByName(b)


@register("welch_ttest", sql("""
SELECT ticker, sample, n_a AS n_calls, n_b AS n_puts, round(mean_a, 8) AS mean_calls, round(mean_b, 8) AS mean_puts,
       round((mean_a - mean_b) / sqrt(var_a / n_a + var_b / n_b), 8) AS t,
       round((var_a / n_a + var_b / n_b) * (var_a / n_a + var_b / n_b)
             / ((var_a / n_a) * (var_a / n_a) / (n_a - 1) + (var_b / n_b) * (var_b / n_b) / (n_b - 1)), 6) AS df
FROM two""", extra=TWO_SQL))
def q_welch_ttest(spark, sf_dir):
    w = _both(spark, sf_dir, lambda s: S.welch_ttest(s, with_p=False))
    return _r(_r(w, ["mean_calls", "mean_puts", "t"]), ["df"], 6)


# The p-value by Simpson's rule on the angle form of the density: with
# t = tan(a) sqrt(df), P(|T| >= |t|) is the share of cos(a)^(df - 1) beyond a.
SIMPSON = 20_000
WELCH_P_SQL = f"""
w AS (SELECT ticker, sample, n_a, n_b, mean_a, mean_b, (mean_a - mean_b) / sqrt(var_a / n_a + var_b / n_b) AS t,
             (var_a / n_a + var_b / n_b) * (var_a / n_a + var_b / n_b)
             / ((var_a / n_a) * (var_a / n_a) / (n_a - 1) + (var_b / n_b) * (var_b / n_b) / (n_b - 1)) AS df FROM two),
a AS (SELECT *, atan(abs(t) / sqrt(df)) AS a FROM w),
g AS (SELECT a.*, CASE WHEN k IN (0, {SIMPSON}) THEN 1.0 WHEN k % 2 = 1 THEN 4.0 ELSE 2.0 END AS c,
             a + k * (pi() / 2 - a) / {SIMPSON} AS tail, k * a / {SIMPSON} AS body FROM a, range(0, {SIMPSON} + 1) r(k)),
s AS (SELECT ticker, sample, sum(c * pow(greatest(cos(tail), 0), df - 1)) * any_value(pi() / 2 - a) AS tail,
             sum(c * pow(cos(body), df - 1)) * any_value(a) AS body FROM g GROUP BY ticker, sample)"""


@register("welch_ttest_p", sql("""
SELECT w.ticker, w.sample, w.n_a AS n_calls, w.n_b AS n_puts, round(mean_a, 8) AS mean_calls, round(mean_b, 8) AS mean_puts,
       round(t, 8) AS t, round(df, 6) AS df, round(s.tail / (s.tail + s.body), 8) AS p,
       s.tail / (s.tail + s.body) < 0.05 AS significant
FROM w JOIN s ON w.ticker = s.ticker AND w.sample = s.sample""", extra=TWO_SQL + "," + WELCH_P_SQL))
def q_welch_ttest_p(spark, sf_dir):
    """The same test with its p-value."""
    return _r(_r(_both(spark, sf_dir, S.welch_ttest), ["mean_calls", "mean_puts", "t", "p"]), ["df"], 6)


@register("ztest", sql(f"""
SELECT ticker, sample, n_calls, n_puts, round(z, 8) AS z, round(2.0 * {norm_cdf_sql('(-abs(z))')}, 10) AS p,
       2.0 * {norm_cdf_sql('(-abs(z))')} < 0.05 AS significant
FROM (SELECT ticker, sample, n_a AS n_calls, n_b AS n_puts,
             (mean_a - mean_b) / sqrt(((n_a - 1) * var_a + (n_b - 1) * var_b) / (n_a + n_b - 2)
                                      * (1.0 / n_a + 1.0 / n_b)) AS z FROM two)""", extra=TWO_SQL))
def q_ztest(spark, sf_dir):
    z = _both(spark, sf_dir, S.ztest)
    return _r(_r(z, ["z"]), ["p"], 10)


@register("mean_gap", sql("""
SELECT ticker, sample, round(mean_a, 8) AS mean_calls, round(mean_b, 8) AS mean_puts,
       round(mean_b - mean_a, 8) AS put_minus_call FROM two""", extra=TWO_SQL))
def q_mean_gap(spark, sf_dir):
    return _r(_both(spark, sf_dir, S.mean_gap), ["mean_calls", "mean_puts", "put_minus_call"])
