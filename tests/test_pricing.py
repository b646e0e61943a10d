import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from chainlake.functions.pricing import norm_cdf, time_to_expiry, with_greeks
from chainlake.functions.stats import norm_ppf


def test_norm_cdf_matches_erfc(spark):
    xs = [i / 10.0 for i in range(-120, 121)] + [-40.0, 40.0, 7.07106781186547, -7.0710678118655]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = df.select("x", norm_cdf("x").alias("p")).collect()
    for r in got:
        want = 0.5 * math.erfc(-r.x / math.sqrt(2))
        assert abs(r.p - want) < 1e-14, r


def test_norm_ppf_inverts_cdf(spark):
    ps = [1e-12, 1e-6, 0.01, 0.2, 0.5, 0.7, 0.975, 0.999999]
    df = spark.createDataFrame([(p,) for p in ps], "p double")
    got = df.select("p", norm_cdf(norm_ppf("p")).alias("back")).collect()
    for r in got:
        assert abs(r.back - r.p) <= 1e-12 * max(r.p, 1e-300) + 1e-15


def _priced(spark, rows):
    df = spark.createDataFrame(rows, "S double, K double, iv double, typ string, yrs double")
    return with_greeks(df, "S", "K", "iv", "typ", F.col("yrs")).collect()


def test_put_call_parity_delta_and_equal_gamma(spark):
    out = _priced(spark, [(100.0, 95.0, 0.3, "call", 0.5), (100.0, 95.0, 0.3, "put", 0.5)])
    call, put = out
    assert abs((call.delta - put.delta) - 1.0) <= 2e-4
    assert call.gamma == put.gamma and call.vega == put.vega


def test_known_black_scholes_values(spark):
    # S=100, K=100, sigma=0.2, T=1, r=0.05: call delta N(0.35)=0.6368
    (r,) = _priced(spark, [(100.0, 100.0, 0.2, "call", 1.0)])
    assert r.delta == pytest.approx(0.6368, abs=1e-4)
    assert r.gamma == pytest.approx(0.0188, abs=1e-4)
    assert r.vega == pytest.approx(0.3752, abs=1e-4)
    assert r.theta == pytest.approx(-6.414 / 365, abs=1e-4)


def test_invalid_inputs_give_nulls(spark):
    out = _priced(spark, [(100.0, 0.0, 0.2, "call", 1.0), (100.0, 100.0, 0.0, "put", 1.0),
                          (100.0, 100.0, None, "put", 1.0)])
    for r in out:
        assert (r.delta, r.gamma, r.theta, r.vega) == (None, None, None, None)


def test_other_type_priced_as_put(spark):
    a, b = _priced(spark, [(100.0, 100.0, 0.2, "weird", 1.0), (100.0, 100.0, 0.2, "put", 1.0)])
    assert (a.delta, a.theta) == (b.delta, b.theta)


def test_time_to_expiry_floor_and_dst(spark):
    df = spark.createDataFrame(
        [(dt.date(2024, 3, 15), dt.datetime(2024, 3, 8, 16, 0, 0)),   # spans the DST switch
         (dt.date(2024, 1, 5), dt.datetime(2024, 1, 10, 10, 0, 0))],  # expired -> 1 day floor
        "expiry date, asof timestamp_ntz")
    out = df.select(time_to_expiry("expiry", "asof", "America/New_York").alias("t"),
                    time_to_expiry("expiry", "asof", "UTC").alias("u")).collect()
    # 7 calendar days, but one hour less in New York (clocks went forward)
    assert out[0].u * 365 == pytest.approx(7.0)
    assert out[0].t * 365 * 24 == pytest.approx(7 * 24 - 1)
    assert out[1].t == pytest.approx(1 / 365) and out[1].u == pytest.approx(1 / 365)
