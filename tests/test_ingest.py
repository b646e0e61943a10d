import datetime as dt
import os

from pyspark.sql import functions as F

from chainlake.sources import ingest
from chainlake.streaming import ingest as stream

HEADER = ("contractSymbol,expiry,option_type,strike,bid,ask,lastPrice,volume,openInterest,impliedVolatility,"
          "delta,gamma,theta,vega,inTheMoney,snapshot_time,snapshot_str,ticker\n")


def _write(path, name, lines):
    os.makedirs(path, exist_ok=True)
    with open(os.path.join(path, name), "w") as fh:
        fh.write(HEADER + "".join(lines))


def _line(sym, vol, itm, ts, run, bid=1.0, ask=1.1):
    return (f"{sym},2024-02-16,call,50.0,{bid},{ask},1.05,{vol},3.0,0.3,0.5,0.01,-0.02,0.1,{itm},"
            f"{ts}.000000,{run},TKA\n")


def test_stream_ingest_once_and_typing(spark, tmp_path):
    landing, bronze, ckpt = str(tmp_path / "landing"), str(tmp_path / "bronze"), str(tmp_path / "ckpt")
    _write(landing, "a.csv", [_line("A", "12.0", "True", "2024-01-02 10:00:00", "r1"),
                              _line("B", "2.5", "1.0", "2024-01-02 10:00:00", "r1"),
                              _line("C", "3.5", "false", "2024-01-02 10:00:00", "r1"),
                              _line("D", "", "maybe", "2024-01-02 10:00:00", "r1")])
    stream.ingest_to_bronze(spark, landing, "options", bronze, ckpt)
    stream.ingest_to_bronze(spark, landing, "options", bronze, ckpt)  # same files again: nothing added
    b = {r.contractSymbol: r for r in stream.read_bronze(spark, bronze).collect()}
    assert len(b) == 4
    assert (b["A"].volume, b["B"].volume, b["C"].volume, b["D"].volume) == (12, 2, 4, None)  # half-even
    assert (b["A"].inTheMoney, b["B"].inTheMoney, b["C"].inTheMoney, b["D"].inTheMoney) == (True, True, False, None)
    assert b["A"].snapshot_time == dt.datetime(2024, 1, 2, 10, 0) and b["A"]._source_file.endswith("a.csv")
    _write(landing, "b.csv", [_line("A", "1.0", "True", "2024-01-03 10:00:00", "r2")])
    stream.ingest_to_bronze(spark, landing, "options", bronze, ckpt)
    assert stream.read_bronze(spark, bronze).count() == 5


def test_stream_silver_merge_equals_batch_and_handles_late_files(spark, tmp_path):
    landing, silver_dir, ckpt = str(tmp_path / "l"), str(tmp_path / "s"), str(tmp_path / "c")
    _write(landing, "late_first.csv", [_line("A", "5.0", "True", "2024-01-03 16:00:00", "r2"),
                                       _line("B", "6.0", "True", "2024-01-03 16:00:00", "r2", bid=2.0, ask=1.0)])
    stream.stream_silver_merge(spark, landing, "options", silver_dir, ckpt)
    _write(landing, "older.csv", [_line("A", "1.0", "True", "2024-01-02 10:00:00", "r1"),
                                  _line("B", "2.0", "True", "2024-01-02 10:00:00", "r1")])
    stream.stream_silver_merge(spark, landing, "options", silver_dir, ckpt)
    got = {r.contractSymbol: r.volume for r in stream.read_silver(spark, silver_dir, "options").collect()}
    # A keeps its newer row; B's newer row is crossed, so the older valid one wins
    assert got == {"A": 5, "B": 2}
    batch = ingest.read_landing(spark, landing, "options")
    from chainlake.operators.silver import silver_options
    assert {r.contractSymbol: r.volume for r in silver_options(batch).collect()} == got


def test_watchlist_explode_dedupes(spark):
    docs = spark.createDataFrame([('{"AAPL": ["X1", "X2"], "INTC": ["Y1"]}',), ('{"AAPL": ["X1"]}',)], "value string")
    got = sorted(tuple(r) for r in ingest.watchlist_explode(docs).collect())
    assert got == [("AAPL", "X1"), ("AAPL", "X2"), ("INTC", "Y1")]


def test_new_files_only_and_select_existing(spark):
    inc = spark.createDataFrame([("f1", 1), ("f2", 2)], "_source_file string, v int")
    old = spark.createDataFrame([("f1", 9)], "_source_file string, v int")
    assert [r.v for r in ingest.new_files_only(inc, old).collect()] == [2]
    from chainlake.functions.util import select_existing
    assert select_existing(inc, ["v", "missing", "_source_file"]).columns == ["v", "_source_file"]


def test_add_metadata_literal(spark):
    df = spark.range(1).select(F.lit(1).alias("x"))
    (r,) = ingest.add_metadata(df, "2026-06-01 09:35:07", "AAPL").collect()
    assert r.snapshot_str == "20260601_093507" and r.ticker == "AAPL"


PRICE_HEADER = "Date,Open,High,Low,Close,Volume,HV_20,HV_252,snapshot_time,snapshot_str,ticker\n"


def test_stream_silver_merge_price_path(spark, tmp_path):
    landing, silver_dir, ckpt = str(tmp_path / "l"), str(tmp_path / "s"), str(tmp_path / "c")
    os.makedirs(landing)

    def put(name, rows):
        with open(os.path.join(landing, name), "w") as fh:
            fh.write(PRICE_HEADER + "".join(rows))

    put("run2.csv", ["2024-01-02,1,2,0.5,1.5,10.0,,,2024-01-02 16:15:00.000000,r2,TKA\n",
                     "2023-12-29,1,2,0.5,1.1,10.0,,,2024-01-02 16:15:00.000000,r2,TKA\n"])
    stream.stream_silver_merge(spark, landing, "price", silver_dir, ckpt)
    put("run1.csv", ["2024-01-02,1,2,0.5,1.4,10.0,,,2024-01-02 09:35:00.000000,r1,TKA\n",
                     "2024-01-01,1,2,0.5,,10.0,,,2024-01-02 09:35:00.000000,r1,TKA\n"])   # NULL close: dropped
    stream.stream_silver_merge(spark, landing, "price", silver_dir, ckpt)
    got = {r.Date: r.Close for r in stream.read_silver(spark, silver_dir, "price").collect()}
    assert got == {dt.date(2024, 1, 2): 1.5, dt.date(2023, 12, 29): 1.1}


def test_columns_are_read_by_header(spark, tmp_path):
    import pytest

    landing = str(tmp_path / "landing")
    os.makedirs(landing)

    def put(name, text):
        with open(os.path.join(landing, name), "w") as fh:
            fh.write(text)
    put("a.csv", "Close,Date,Open,ticker,snapshot_time,snapshot_str,Extra\n2.0,2024-01-02,1.0,TKA,2024-01-02 16:00:00.000000,r1,zz\n")
    put("b.csv", "ticker,snapshot_str,snapshot_time,Date,Close,High,Volume\r\n\"T,K\",r1,2024-01-02 16:00:00.000000,2024-01-03,7.5,oops,12.0\r\n")
    want = {("TKA", 1.0, None, 2.0, None), ("T,K", None, None, 7.5, 12)}

    def rows(df):
        return {(r.ticker, r.Open, r.High, r.Close, r.Volume) for r in df.collect()}
    assert rows(ingest.read_landing(spark, landing, "price")) == want
    bronze, ckpt = str(tmp_path / "bronze"), str(tmp_path / "ckpt")
    stream.ingest_to_bronze(spark, landing, "price", bronze, ckpt, max_files=1)
    assert rows(stream.read_bronze(spark, bronze)) == want
    put("c.csv", "Date,Open,ticker,snapshot_time,snapshot_str\n2024-01-02,1.0,TKA,2024-01-02 16:00:00.000000,r1\n")
    with pytest.raises(Exception, match="lacks required columns: Close"):
        ingest.read_landing(spark, landing, "price").collect()
    with pytest.raises(Exception, match="lacks required columns: Close"):
        stream.ingest_to_bronze(spark, landing, "price", bronze, ckpt)


def _merge(spark, tmp_path, kind, header, runs):
    """Incremental Silver after each run, and the rebuild from all files."""
    landing, silver_dir, ckpt = (str(tmp_path / x) for x in "lsc")
    os.makedirs(landing)
    for name, lines in runs:
        with open(os.path.join(landing, name), "w") as fh:
            fh.write(header + "".join(lines))
        stream.stream_silver_merge(spark, landing, kind, silver_dir, ckpt)
    from chainlake.operators import silver as S

    bronze = ingest.read_landing(spark, landing, kind)
    full = S.silver_options(bronze) if kind == "options" else S.silver_price(bronze)
    got = stream.read_silver(spark, silver_dir, kind).select(*full.columns)
    same = sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, full.collect()), key=repr)
    return got, same


def test_merge_keeps_rows_without_expiry(spark, tmp_path):
    bare = [_line(s, 1, 1, f"2024-01-0{d} 10:00:00", f"r{d}").replace("2024-02-16", "") for s, d in (("X", 2), ("Y", 2), ("Y", 3), ("Z", 3))]
    got, same = _merge(spark, tmp_path, "options", HEADER, [("a.csv", bare[:2]), ("b.csv", bare[2:])])
    assert same and {r.contractSymbol for r in got.collect()} == {"X", "Y", "Z"}


def test_merge_follows_a_corrected_expiry(spark, tmp_path):
    old = _line("A", 1, 1, "2024-01-02 10:00:00", "r1")
    new = _line("A", 1, 1, "2024-01-03 10:00:00", "r2").replace("2024-02-16", "2024-03-15")
    got, same = _merge(spark, tmp_path, "options", HEADER, [("a.csv", [old]), ("b.csv", [new])])
    assert same and [r.expiry for r in got.collect()] == [dt.date(2024, 3, 15)]


def test_merge_breaks_price_ties_as_the_rebuild_does(spark, tmp_path):
    line = "2024-01-02,1,2,0.5,{},10.0,,,2024-01-02 16:15:00.000000,r1,TKA\n"
    got, same = _merge(spark, tmp_path, "price", PRICE_HEADER, [("z.csv", [line.format(9.0)]), ("a.csv", [line.format(1.0)])])
    assert same and [r.Close for r in got.collect()] == [9.0]


def test_snapshot_sink_is_idempotent(spark, tmp_path):
    df = spark.createDataFrame([("A", "2024-01-02 10:00:00", "r1"), ("B", "2024-01-02 10:00:00", "r1"), ("A", "2024-01-02 16:00:00", "r2")],
                               "ticker string, t string, snapshot_str string").selectExpr("ticker", "CAST(t AS TIMESTAMP_NTZ) AS snapshot_time", "snapshot_str")
    for part in (df.filter("snapshot_str = 'r1'"), df.filter("snapshot_str = 'r1'"), df.filter("snapshot_str = 'r2'")):
        ingest.csv_snapshot_sink(part, str(tmp_path / "sink"))
    assert spark.read.parquet(str(tmp_path / "sink")).count() == 3
