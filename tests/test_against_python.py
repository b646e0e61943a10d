"""Operators against independent pandas / Python computations."""

import datetime as dt
import math
import random

import numpy as np
import pandas as pd
import pytest

from chainlake.functions.occ import contract_label
from chainlake.functions.pricing import time_to_expiry, with_greeks
from chainlake.operators.prices import hv
from pyspark.sql import functions as F


def test_hv_matches_pandas_rolling(spark):
    rnd = random.Random(7)
    closes = [100.0]
    for _ in range(300):
        closes.append(closes[-1] * math.exp(rnd.gauss(0, 0.02)))
    d0 = dt.date(2020, 1, 1)
    df = spark.createDataFrame([(d0 + dt.timedelta(days=i), "T", c) for i, c in enumerate(closes)],
                               "Date date, ticker string, Close double")
    got = hv(df).orderBy("Date").toPandas()
    s = pd.Series(closes)
    lr = np.log(s / s.shift(1))
    for n in (20, 252):
        want = (lr.rolling(window=n).std() * np.sqrt(252)).round(4)
        assert got[f"HV_{n}"].isna().tolist() == want.isna().tolist()
        assert got[f"HV_{n}"].dropna().tolist() == pytest.approx(want.dropna().tolist(), abs=1e-4)


def test_greeks_agree_with_the_price(spark):
    """Delta, gamma, theta and vega are the derivatives of the price: checked
    by finite differences of an integral over the log-normal end price, which
    shares no formula with the closed form."""
    z = np.linspace(-9, 9, 40_001)
    weight = np.exp(-z * z / 2)
    weight /= weight.sum()

    def price(spot, strike, vol, kind, years, rate=0.05):
        end = spot * np.exp((rate - vol * vol / 2) * years + vol * math.sqrt(years) * z)
        gain = np.maximum(end - strike, 0) if kind == "call" else np.maximum(strike - end, 0)
        return math.exp(-rate * years) * float(weight @ gain)

    cases = [(100.0, 100.0, 0.2, "call", 1.0), (100.0, 110.0, 0.35, "put", 0.5), (60.0, 45.0, 0.8, "call", 0.25),
             (150.0, 180.0, 0.5, "put", 1.5), (30.0, 30.0, 0.3, "put", 0.1)]
    df = spark.createDataFrame(cases, "S double, K double, iv double, typ string, yrs double")
    for r in with_greeks(df, "S", "K", "iv", "typ", F.col("yrs")).collect():
        p = lambda s=r.S, v=r.iv, y=r.yrs: price(s, r.K, v, r.typ, y)
        h = r.S * 0.01
        assert r.delta == pytest.approx((p(s=r.S + h) - p(s=r.S - h)) / (2 * h), abs=5e-3)
        assert r.gamma == pytest.approx((p(s=r.S + h) - 2 * p() + p(s=r.S - h)) / (h * h), abs=2e-3)
        assert r.vega == pytest.approx((p(v=r.iv + 0.01) - p(v=r.iv - 0.01)) / 2, abs=2e-3)
        assert r.theta == pytest.approx(-(p(y=r.yrs + 1 / 730) - p(y=r.yrs - 1 / 730)), abs=2e-3)


def test_greeks_parity_and_published_values(spark):
    pairs = [(s, k, v, t) for s in (40.0, 100.0) for k in (35.0, 100.0) for v in (0.1, 0.6) for t in (0.05, 1.0)]
    df = spark.createDataFrame([(*p, kind) for p in pairs for kind in ("call", "put")], "S double, K double, iv double, yrs double, typ string")
    got = {(r.S, r.K, r.iv, r.yrs, r.typ): r for r in with_greeks(df, "S", "K", "iv", "typ", F.col("yrs")).collect()}
    for p in pairs:
        call, put = got[(*p, "call")], got[(*p, "put")]
        assert call.delta - put.delta == pytest.approx(1, abs=1.01e-4)
        assert (call.gamma, call.vega) == (put.gamma, put.vega)
        carry = -0.05 * p[1] * math.exp(-0.05 * p[3]) / 365
        assert call.theta - put.theta == pytest.approx(carry, abs=1.01e-4)
    # textbook case: spot 49, strike 50, rate 5 %, volatility 20 %, 20 weeks
    one = spark.createDataFrame([(49.0, 50.0, 0.2, "call", 0.3846)], "S double, K double, iv double, typ string, yrs double")
    (r,) = with_greeks(one, "S", "K", "iv", "typ", F.col("yrs")).collect()
    assert (r.delta, r.gamma, r.vega, r.theta * 365) == pytest.approx((0.522, 0.066, 0.121, -4.31), abs=6e-3)


def test_time_to_expiry_matches_python_zoneinfo(spark):
    from zoneinfo import ZoneInfo

    tz = ZoneInfo("America/New_York")
    rnd = random.Random(5)
    rows = []
    for _ in range(100):
        exp = dt.date(2024, 1, 1) + dt.timedelta(days=rnd.randrange(0, 700))
        asof = dt.datetime(2024, 1, 1) + dt.timedelta(minutes=rnd.randrange(0, 700 * 1440))
        rows.append((exp, asof))
    df = spark.createDataFrame(rows, "e date, a timestamp_ntz")
    got = df.select("e", "a", time_to_expiry("e", "a").alias("t")).collect()
    utc = dt.timezone.utc
    for r in got:
        if r.a.hour == 2:
            continue  # wall-clock times inside a DST gap have no single reading
        # midnight in New York plus 16 hours of elapsed time, minus as_of read in New York
        close = dt.datetime(r.e.year, r.e.month, r.e.day, tzinfo=tz).astimezone(utc) + dt.timedelta(hours=16)
        start = r.a.replace(tzinfo=tz).astimezone(utc)
        want = max((close - start).total_seconds() / (365 * 24 * 3600), 1 / 365)
        assert r.t == pytest.approx(want, rel=1e-12)


LABELS = [  # symbol, short, full, minimal
    ("ZQX270917P00040000", "$40P 09/17/27", "ZQX $40 Put  Sep 17 '27", "$40P"),
    ("A000101C00000000", "$0C 01/01/00", "A $0 Call  Jan 01 '00", "$0C"),
    ("BCD991231C99999999", "$100000.00C 12/31/99", "BCD $100000.00 Call  Dec 31 '99", "$100000.00C"),
    ("BCD240229C00007500", "$7.50C 02/29/24", "BCD $7.50 Call  Feb 29 '24", "$7.50C"),
    ("BCD240229P00012125", "$12.12P 02/29/24", "BCD $12.12 Put  Feb 29 '24", "$12.12P"),
    ("BCD240229P00012375", "$12.38P 02/29/24", "BCD $12.38 Put  Feb 29 '24", "$12.38P"),
    ("BCD240229P00001005", "$1.00P 02/29/24", "BCD $1.00 Put  Feb 29 '24", "$1.00P"),
    ("BCD240229P00001015", "$1.01P 02/29/24", "BCD $1.01 Put  Feb 29 '24", "$1.01P"),
    ("BCD240229P00000999", "$1.00P 02/29/24", "BCD $1.00 Put  Feb 29 '24", "$1.00P"),
    ("BCD240229P00000001", "$0.00P 02/29/24", "BCD $0.00 Put  Feb 29 '24", "$0.00P"),
] + [(s, s, s, s) for s in ("BCD230229C00007500", "BCD241301C00007500", "bcd240229C00007500", "BCD240229X00007500", "", "BCD24022C00007500")]


def test_labels_of_a_table(spark):
    df = spark.createDataFrame(LABELS, "s string, short string, full string, minimal string")
    for r in df.select("*", *[contract_label("s", k).alias(f"got_{k}") for k in ("short", "full", "minimal")]).collect():
        assert (r.got_short, r.got_full, r.got_minimal) == (r.short, r.full, r.minimal), r.s
