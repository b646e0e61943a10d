import datetime as dt

from chainlake.functions import classify as C
from chainlake.operators import calendar, chain, quality

GOLD = ("contractSymbol string, expiry date, option_type string, strike double, iv double, volume long, "
        "openInterest long, price_close double, ticker string, option_last double")


def test_chain_filters(spark):
    e = dt.date(2024, 2, 16)
    g = spark.createDataFrame([
        ("A", e, "call", 100.0, 0.3, 50, 10, 100.0, "T", 1.0),
        ("B", e, "put", 110.0, 0.3, None, 100, 100.0, "T", 1.0),     # +10%: inclusive
        ("C", e, "put", 111.0, 0.3, 5, 0, 100.0, "T", 1.0),          # outside
        ("D", dt.date(2024, 1, 10), "put", 100.0, 0.3, 5, 0, 100.0, "T", 1.0),  # expired
    ], GOLD)
    got = {r.contractSymbol: r for r in chain.chain(g, "2024-01-31", pct=10).collect()}
    assert set(got) == {"A", "B"}
    assert (got["A"].vol_oi_ratio, got["A"].oi_vol_ratio) == (5.0, 0.2)
    assert (got["B"].vol_oi_ratio, got["B"].oi_vol_ratio) == (0.0, 0.0)
    assert [r.contractSymbol for r in chain.chain(g, "2024-01-31", option_type="Puts").collect()] == ["B"]
    assert [r.contractSymbol for r in chain.chain(g, "2024-01-31", flow="vol_oi_gt_1_0").collect()] == ["A"]
    assert chain.chain(g, "2024-01-31", zone="<30d").count() == 2


def test_term_structure_slope(spark):
    rows = []
    for i, (exp, iv) in enumerate([(dt.date(2024, 3, 1), 0.30), (dt.date(2024, 4, 1), 0.33),
                                   (dt.date(2024, 5, 1), 0.31), (dt.date(2024, 2, 2), 0.5)]):
        rows.append((f"K{i}", exp, "call", 100.0, iv, 20, 1, 100.0, "T", 1.0))
    t = chain.term_structure(spark.createDataFrame(rows, GOLD), "2024-01-31 10:30:00").orderBy("expiry").collect()
    assert [r.dte for r in t] == [29, 60, 90]      # 2024-02-02 is under 7 days out
    assert t[0].slope == 0.0 and t[1].shape == "contango" and t[2].shape == "backwardation"
    assert t[1].slope == (33.0 - 30.0) / 31


def test_classifiers(spark):
    df = spark.createDataFrame([(0.69, 24.9, 2.01, 29, 25.0), (0.7, 50.0, -2.5, 30, 8.0),
                                (1.0, 75.0, 0.0, 120, 8.5), (None, None, None, None, None)],
                               "pcr double, rank double, z double, dte int, hours double")
    out = df.select(C.pcr_class("pcr"), C.iv_regime("rank"), C.zscore_label("z"), C.dte_bucket("dte"),
                    C.freshness("hours")).collect()
    assert [tuple(r) for r in out] == [("bullish", "low", "Expensive", "<30d", "stale"),
                                       ("neutral", "elevated", "Cheap", "30-60d", "ok"),
                                       ("neutral", "high", "Normal", "120d+", "warning"),
                                       (None, None, None, None, None)]


def test_trading_days(spark):
    days = spark.createDataFrame([(dt.date(2026, 11, 27),), (dt.date(2026, 11, 28),), (dt.date(2026, 11, 30),)],
                                 "day date")
    got = {r.day: r.is_trading_day for r in calendar.trading_days(days).collect()}
    assert got == {dt.date(2026, 11, 27): False, dt.date(2026, 11, 28): False, dt.date(2026, 11, 30): True}


def test_dq_counts_and_null_is_not_violation(spark):
    gex = spark.createDataFrame([("T", 0.0, 1.0, 1.0, 1.0, 1.0), ("T", 5.0, None, 1.0, 1.0, 1.0)],
                                "ticker string, strike double, net_delta double, net_gamma double, "
                                "net_delta_notional double, net_gamma_notional double")
    r = {x.check: x for x in quality.dq_greeks_exposure(gex).collect()}
    assert r["has_rows"].violations == 0 and r["bad_strikes"].violations == 1
    assert r["null_net_fields"].violations == 1 and not r["null_net_fields"].ok
    empty = spark.createDataFrame([], gex.schema)
    r2 = {x.check: x.violations for x in quality.dq_greeks_exposure(empty).collect()}
    assert r2 == {"has_rows": 1, "null_net_fields": 0, "bad_strikes": 0}
