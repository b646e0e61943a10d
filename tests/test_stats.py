import math
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from chainlake.functions.stats import with_t_two_sided
from chainlake.operators import stats as S

VALUES = [12.0, 15.5, 15.5, 15.5, 18.0, 21.25, 30.0, 33.0, 33.0, 90.0, 8.5, 14.0, 16.0, 17.5]


@pytest.fixture(scope="module")
def sample(spark):
    rows = [("T", "call" if i % 2 else "put", v) for i, v in enumerate(VALUES)]
    return spark.createDataFrame(rows, "ticker string, option_type string, iv double")


def test_moments_match_pandas(sample):
    (r,) = S.moments(sample).collect()
    s = pd.Series(VALUES)
    assert r.n == len(VALUES)
    assert r.mean == pytest.approx(s.mean()) and r.std == pytest.approx(s.std())
    assert r.skew == pytest.approx(s.skew()) and r.kurtosis == pytest.approx(s.kurtosis())


@pytest.mark.parametrize("cuts", [1, 3, 64, 1023])
def test_box_stats_exact_for_any_number_of_cuts(sample, cuts):
    (r,) = S.box_stats(sample, cuts=cuts).collect()
    q1, med, q3 = np.percentile(VALUES, [25, 50, 75])
    assert (r.q1, r.median, r.q3) == pytest.approx((q1, med, q3))
    iqr = q3 - q1
    inside = [v for v in VALUES if q1 - 1.5 * iqr <= v <= q3 + 1.5 * iqr]
    assert (r.whisker_lo, r.whisker_hi) == (min(inside), max(inside))
    assert r.outliers == len(VALUES) - len(inside)


@pytest.mark.parametrize("cuts", [1, 4])
def test_qq_points_and_fit(sample, cuts):
    norm_ppf_py = NormalDist().inv_cdf  # the standard library's own algorithm

    pts = S.qq_points(sample, cuts=cuts).orderBy("i").collect()
    n = len(VALUES)
    xs = sorted(VALUES)
    assert [p.osr for p in pts] == xs and [p.i for p in pts] == list(range(1, n + 1))
    m = [1 - 0.5 ** (1 / n)] + [(i - 0.3175) / (n + 0.365) for i in range(2, n)] + [0.5 ** (1 / n)]
    assert [p.osm for p in pts] == pytest.approx([norm_ppf_py(v) for v in m], abs=1e-9)
    (fit,) = S.qq_fit(S.qq_points(sample, cuts=cuts)).collect()
    slope, intercept = np.polyfit([norm_ppf_py(v) for v in m], xs, 1)
    assert (fit.slope, fit.intercept) == pytest.approx((slope, intercept))


def test_expand_ranks_splits_heavy_values(spark):
    ranked = spark.createDataFrame([("T", 1.0, 10, 1, 12), ("T", 2.0, 2, 11, 12)],
                                   "ticker string, iv double, m long, start long, n long")
    out = S.expand_ranks(ranked, chunk=3).orderBy("i").collect()
    assert [r.i for r in out] == list(range(1, 13))
    assert [r.iv for r in out] == [1.0] * 10 + [2.0] * 2


def test_histogram_density_integrates_to_one(sample):
    h = S.histogram(sample, bins=5).orderBy("bin").collect()
    assert [r.bin for r in h] == list(range(5))
    assert sum(r["count"] for r in h) == len(VALUES)
    assert sum(r.density * (r.bin_hi - r.bin_lo) for r in h) == pytest.approx(1.0)
    counts, _ = np.histogram(VALUES, bins=5)
    assert [r["count"] for r in h] == counts.tolist()


def test_kde_close_to_exact_gaussian_kde(sample):
    out = S.kde(sample, grid=50, bins=4096).orderBy("k").collect()
    x = np.array(VALUES)
    h = x.std(ddof=1) * len(x) ** (-0.2)
    for r in out[::7]:
        exact = np.exp(-0.5 * ((r.x - x) / h) ** 2).sum() / (len(x) * h * math.sqrt(2 * math.pi))
        assert r.density == pytest.approx(exact, rel=1e-3, abs=1e-6)


def test_kde_of_both_series_in_one_pass(spark, sample):
    both = S.kde_series(sample, grid=40)
    plan = both._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan

    def rows(df):
        return [v for r in sorted((r.k, r.x, r.density, r.bandwidth) for r in df.collect()) for v in r]
    assert rows(both.where("series = 'iv'")) == pytest.approx(rows(S.kde(sample, grid=40)))
    assert rows(both.where("series = 'log_iv'")) == pytest.approx(rows(S.kde(sample, grid=40, log=True)))
    flat = spark.createDataFrame([("T", "call", 5.0)] * 3, sample.schema)
    assert {r.density for r in S.kde(flat, grid=5).collect()} == {None}


def test_ranges_of_the_rank_follow_their_parameter(spark):
    d = spark.range(20_000).select(F.lit("T").alias("ticker"), F.col("id").cast("double").alias("iv"))
    for cuts in (7, 1023, 4095):
        got = S.ranked_values(d, cuts=cuts)
        assert got.where("start <> iv + 1 OR n <> 20000").count() == 0
        at = F.array(*[F.lit(i * 20_000 / cuts) for i in range(cuts)])
        most = d.select(S._bucket(at, F.col("iv"), cuts).alias("b")).groupBy("b").count().agg(F.max("count")).first()[0]
        assert most <= 2 * 20_000 // cuts + 2


def test_welch_and_z(sample):
    (w,) = S.welch_ttest(sample).collect()
    calls = [v for i, v in enumerate(VALUES) if i % 2]
    puts = [v for i, v in enumerate(VALUES) if not i % 2]
    va, vb = np.var(calls, ddof=1) / len(calls), np.var(puts, ddof=1) / len(puts)
    t = (np.mean(calls) - np.mean(puts)) / math.sqrt(va + vb)
    df = (va + vb) ** 2 / (va ** 2 / (len(calls) - 1) + vb ** 2 / (len(puts) - 1))
    assert w.t == pytest.approx(t) and w.df == pytest.approx(df)
    assert w.p == pytest.approx(simpson_p(t, df), abs=1e-9)
    (z,) = S.ztest(sample).collect()
    pooled = ((len(calls) - 1) * np.var(calls, ddof=1) + (len(puts) - 1) * np.var(puts, ddof=1)) / (len(VALUES) - 2)
    zz = (np.mean(calls) - np.mean(puts)) / math.sqrt(pooled * (1 / len(calls) + 1 / len(puts)))
    assert z.z == pytest.approx(zz)
    assert z.p == pytest.approx(math.erfc(abs(zz) / math.sqrt(2)))


def simpson_p(t, df, n=20_000):
    """P(|T| >= |t|) from the angle form of the density."""
    a = math.atan(abs(t) / math.sqrt(df))
    c = np.where(np.arange(n + 1) % 2 == 1, 4.0, 2.0)
    c[[0, -1]] = 1
    part = [(c * np.maximum(np.cos(np.linspace(lo, hi, n + 1)), 0) ** (df - 1)).sum() * (hi - lo) for lo, hi in ((a, math.pi / 2), (0, a))]
    return float(part[0] / sum(part))


def test_t_p_value_known_points(spark):
    known = [(2.0, 10.0, 0.0733880347707), (1.0, 1.0, 0.5), (0.0, 5.0, 1.0), (3.0, 2.0, 1 - 3 / math.sqrt(11)),
             (-40.0, 1.0, 1 - 2 / math.pi * math.atan(40)), (2.5, 7.3, simpson_p(2.5, 7.3)), (0.01, 300.0, simpson_p(0.01, 300.0))]
    for big in (1e10, 1e12, 1e15):
        known += [(t, big, math.erfc(t / math.sqrt(2))) for t in (0.0, 0.3, 1.0, 4.0)]
    rows = spark.createDataFrame(known, "t double, df double, p double")
    for r in with_t_two_sided(rows, ["t", "df"], "t", "df", "got").collect():
        assert r.got == pytest.approx(r.p, abs=1e-9), r
    none = spark.createDataFrame([(1.0, 0.0), (None, 3.0), (1.0, None), (math.nan, 3.0)], "t double, df double")
    assert [r.got for r in with_t_two_sided(none, ["t", "df"], "t", "df", "got").collect()] == [None] * 4


@pytest.fixture(scope="module")
def uneven(spark, sample):
    """A flat group, a group of one side, and one without spread per side."""
    rows = ([("FLAT", "call", 5.0)] * 4 + [("FLAT", "put", 5.0)] * 3 + [("ONE", "call", 2.0), ("ONE", "call", 3.0)]
            + [("ZERO", "call", 1.0)] * 3 + [("ZERO", "put", 2.0)] * 3 + [("SINGLE", "put", 9.0)])
    return sample.unionByName(spark.createDataFrame(rows, sample.schema))


def test_degenerate_groups_do_not_stop_the_others(sample, uneven):
    def of(df, ticker):
        return sorted(map(tuple, df.filter(f"ticker = '{ticker}'").drop("ticker").collect()), key=repr)
    for fn in (S.normal_fit, S.lognormal_fit, S.welch_ttest, S.ztest, S.histogram, S.box_stats, S.moments, S.qq_points, S.mean_gap):
        both = fn(uneven)
        assert of(both, "T") == of(fn(sample), "T"), fn
    for ticker in ("FLAT", "ONE", "ZERO", "SINGLE"):
        (w,) = S.welch_ttest(uneven).filter(f"ticker = '{ticker}'").collect()
        (z,) = S.ztest(uneven).filter(f"ticker = '{ticker}'").collect()
        assert w.t is None and w.p is None and z.z is None and z.p is None
    assert {r.pdf for r in S.normal_fit(uneven).filter("ticker = 'FLAT'").collect()} == {None}
    (b,) = S.box_stats(uneven).filter("ticker = 'FLAT'").collect()
    assert (b.q1, b.q3, b.whisker_lo, b.whisker_hi, b.outliers) == (5.0, 5.0, 5.0, 5.0, 0)
