import datetime as dt

from pyspark.sql import functions as F

from chainlake.operators import gold, silver
from chainlake.sources.fixtures import BRONZE_OPTION_COLS
from tests.conftest import rows

T0 = dt.datetime(2024, 1, 2, 10, 0, 0)
T1 = dt.datetime(2024, 1, 2, 15, 0, 0)
SCHEMA = ("contractSymbol string, expiry date, option_type string, strike double, bid double, ask double, "
          "lastPrice double, volume long, openInterest long, impliedVolatility double, delta double, "
          "gamma double, theta double, vega double, inTheMoney boolean, snapshot_time timestamp_ntz, "
          "snapshot_str string, ticker string, _source_file string")


def opt(sym, typ, strike, bid, ask, vol, oi, iv, ts, f, ticker="TKA", delta=0.5, gamma=0.01,
        expiry=dt.date(2024, 2, 16)):
    return (sym, expiry, typ, strike, bid, ask, 1.0, vol, oi, iv, delta, gamma, None, None, None, ts,
            ts.strftime("%Y%m%d_%H"), ticker, f)


def test_newest_valid_row_and_ties(spark):
    data = [
        opt("A", "call", 50.0, 1.0, 1.1, 10, 5, 0.3, T0, "f1"),
        opt("A", "call", 50.0, 1.2, 1.0, 11, 5, 0.3, T1, "f2"),   # newest but crossed -> skipped
        opt("B", "put", 50.0, None, 1.0, 12, 5, 0.3, T0, "f3"),   # NULL bid passes
        opt("C", "put", 50.0, 1.0, 1.1, 1, 5, 0.3, T1, "f4"),     # tie on time: larger file wins
        opt("C", "put", 50.0, 1.0, 1.1, 2, 5, 0.3, T1, "f5"),
    ]
    s = silver.silver_options(spark.createDataFrame(data, SCHEMA))
    got = dict(rows(s, "contractSymbol", "volume"))
    assert got == {"A": 10, "B": 12, "C": 2}


def test_pcr_all_is_sum_of_expiries_and_null_rules(spark):
    e1, e2 = dt.date(2024, 2, 16), dt.date(2024, 3, 15)
    data = [opt("A", "call", 50.0, 1.0, 1.1, 100, 10, 0.3, T0, "f1", expiry=e1),
            opt("B", "put", 50.0, 1.0, 1.1, 50, None, 0.3, T0, "f2", expiry=e1),
            opt("C", "put", 50.0, 1.0, 1.1, None, 7, 0.3, T0, "f3", expiry=e2)]
    p = {r.expiry: r for r in gold.pcr(spark.createDataFrame(data, SCHEMA)).collect()}
    assert p[str(e1)].pcr_volume == 0.5 and p[str(e1)].put_oi == 0 and p[str(e1)].call_oi == 10
    # a put-only expiry whose volumes are all NULL: NULL put volume, 0 calls -> NULL ratio
    assert p[str(e2)].put_volume is None and p[str(e2)].call_volume == 0 and p[str(e2)].pcr_volume is None
    assert p["ALL"].put_volume == 50 and p["ALL"].call_volume == 100 and p["ALL"].put_oi == 7


def test_iv_rank_flat_history_and_percentile(spark):
    per = spark.createDataFrame(
        [("X", "r1", T0, 0.3), ("X", "r2", T1, 0.3), ("Y", "r1", T0, 0.2), ("Y", "r2", T1, 0.4),
         ("Y", "r0", dt.datetime(2024, 1, 1, 10), 0.1)],
        "ticker string, snapshot_str string, snapshot_time timestamp_ntz, atm_iv double")
    r = {x.ticker: x for x in gold.iv_rank(per).collect()}
    assert r["X"].iv_rank is None and r["X"].iv_zscore is None and r["X"].iv_percentile == 0.0
    assert r["Y"].iv_current == 0.4 and r["Y"].iv_rank == 1.0
    assert r["Y"].iv_percentile == round(2 / 3, 4) and r["Y"].snapshot_count == 3


def test_exposure_requires_inputs_and_net_is_sum(spark):
    data = [opt("A", "call", 50.0, 1.0, 1.1, 1, 10, 0.3, T0, "f1", delta=0.5, gamma=0.02),
            opt("B", "put", 50.0, 1.0, 1.1, 1, 20, 0.3, T0, "f2", delta=-0.25, gamma=0.01),
            opt("C", "put", 50.0, 1.0, 1.1, 1, None, 0.3, T0, "f3")]
    (g,) = gold.greeks_exposure(spark.createDataFrame(data, SCHEMA)).collect()
    assert (g.call_delta, g.put_delta, g.net_delta) == (5.0, -5.0, 0.0)
    assert g.net_gamma == g.call_gamma + g.put_gamma == 0.4
    assert g.net_gamma_notional == 0.4 * 50 * 100


def test_latest_snapshot_left_join_keeps_options(spark):
    data = [opt("A", "call", 50.0, 1.0, 1.1, 1, 10, 0.3, T0, "f1", ticker="NOPRICE")]
    px = spark.createDataFrame([(dt.date(2024, 1, 2), "TKA", 1.0, 2.0, 0.5, 1.5, 10, None, None, T0, "AM")],
                               "Date date, ticker string, Open double, High double, Low double, Close double, "
                               "Volume long, HV_20 double, HV_252 double, snapshot_time timestamp_ntz, "
                               "snapshot_str string")
    out = silver.latest_snapshot(silver.silver_options(spark.createDataFrame(data, SCHEMA)), px).collect()
    assert len(out) == 1 and out[0].price_close is None


def test_bronze_columns_constant_matches_schema():
    assert BRONZE_OPTION_COLS == [f.split()[0] for f in SCHEMA.split(", ")]


def test_silver_price_drops_null_criticals_and_hv_needs_full_window(spark):
    from chainlake.operators.prices import hv

    d0 = dt.date(2024, 1, 1)
    rows = [(d0 + dt.timedelta(days=i), "T", 100.0 + i) for i in range(25)]
    df = spark.createDataFrame(rows, "Date date, ticker string, Close double")
    out = hv(df, windows=(20,)).orderBy("Date").collect()
    assert all(r.HV_20 is None for r in out[:20]) and out[20].HV_20 is not None
    raw = spark.createDataFrame(
        [(d0, 1.0, 2.0, 0.5, None, 10, None, None, T0, "AM", "T", "f1"),
         (d0, 1.0, 2.0, 0.5, 1.5, 10, None, None, T0, "PM", "T", "f2"),
         (d0, 1.0, 2.0, 0.5, 1.6, 10, None, None, None, "PM", "T", "f3")],
        "Date date, Open double, High double, Low double, Close double, Volume long, HV_20 double, "
        "HV_252 double, snapshot_time timestamp_ntz, snapshot_str string, ticker string, _source_file string")
    (r,) = silver.silver_price(raw).collect()
    assert r.Close == 1.5
