"""Property tests: invariants over generated inputs."""

import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from chainlake.operators import gold, silver, tracker

SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
T0 = dt.datetime(2024, 1, 2, 9, 0)

snap = st.tuples(st.integers(0, 3), st.integers(0, 20), st.floats(0.05, 20.0, allow_nan=False),
                 st.one_of(st.none(), st.integers(0, 500)))


@SETTINGS
@given(st.lists(snap, min_size=1, max_size=40))
def test_ohlc_bounds_and_newest_row_idempotent(spark, rows):
    data = [(f"C{c}", T0 + dt.timedelta(hours=h), p, 0.3, oi, f"f{i}") for i, (c, h, p, oi) in enumerate(rows)]
    df = spark.createDataFrame(data, "contractSymbol string, snapshot_time timestamp_ntz, lastPrice double, "
                                     "impliedVolatility double, openInterest long, _source_file string")
    for b in tracker.ohlc(df).collect():
        assert b.low <= b.open <= b.high and b.low <= b.close <= b.high
    full = df.selectExpr("*", "'TKA' AS ticker", "CAST(NULL AS double) AS bid", "CAST(NULL AS double) AS ask",
                         "'r' AS snapshot_str")
    once = silver.newest_per_key(full, ["contractSymbol"])
    twice = silver.newest_per_key(once, ["contractSymbol"])
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect()))
    assert once.count() == len({r[0] for r in rows})


@SETTINGS
@given(st.lists(st.floats(0.01, 4.0, allow_nan=False), min_size=1, max_size=30))
def test_percentile_bounds(spark, ivs):
    per = spark.createDataFrame([("T", f"r{i}", T0 + dt.timedelta(minutes=i), v) for i, v in enumerate(ivs)],
                                "ticker string, snapshot_str string, snapshot_time timestamp_ntz, atm_iv double")
    (r,) = gold.iv_rank(per).collect()
    n = len(ivs)
    assert 0.0 <= r.iv_percentile <= round((n - 1) / n, 4)
    assert r.iv_current == round(ivs[-1], 4)
    assert r.iv_rank is None or 0.0 <= r.iv_rank <= 1.0
