"""Landing files of any width and size, quarantine, manifest, bucketed Silver."""
import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from chainlake.operators import gold, quality
from chainlake.plans import medallion
from chainlake.sources import files, ingest
from chainlake.streaming import buckets
from chainlake.streaming import ingest as stream

COLS = ["Date", "Open", "High", "Low", "Close", "Volume", "HV_20", "HV_252", "snapshot_time", "snapshot_str", "ticker"]


def put(folder, name, text):
    os.makedirs(os.path.join(folder, os.path.dirname(name)), exist_ok=True)
    with open(os.path.join(folder, name), "w", newline="") as fh:
        fh.write(text)


def price(date="2024-01-02", close="2.0", ticker="TKA", ts="2024-01-02 16:00:00.000000", run="r1", **other):
    row = {"Date": date, "Open": "1.5", "High": "9", "Low": "1", "Close": close, "Volume": "10.0", "HV_20": "", "HV_252": "",
           "snapshot_time": ts, "snapshot_str": run, "ticker": ticker} | other
    return ",".join(row[c] for c in COLS) + "\n"


HEAD = ",".join(COLS) + "\n"


def test_columns_beyond_any_width(spark, tmp_path):
    names = [f"x{i}" for i in range(100)] + COLS + [f"y{i}" for i in range(40)]
    values = ["q"] * 100 + price().strip().split(",") + ["z"] * 40
    put(str(tmp_path / "l"), "wide.csv", ",".join(names) + "\n" + ",".join(values) + "\n")
    put(str(tmp_path / "l"), "narrow.csv", "﻿ticker,Close,Date,snapshot_time,snapshot_str\nTKB,3.5,2024-01-03,2024-01-03 10:00:00.000000,r2\n")
    got = {r.ticker: r for r in ingest.read_landing(spark, str(tmp_path / "l"), "price").collect()}
    assert (got["TKA"].Open, got["TKA"].Close, got["TKA"].Volume, got["TKA"].snapshot_str) == (1.5, 2.0, 10, "r1")
    assert (got["TKB"].Open, got["TKB"].Close, got["TKB"].Date) == (None, 3.5, dt.date(2024, 1, 3))
    assert ingest.read_quarantine(spark, str(tmp_path / "l"), "price").collect() == []


def test_landing_files_grow_with_rows_not_with_tasks(spark, tmp_path):
    """Rows of every folder in every task: a file per folder, not per task and
    folder; of a folder that holds nearly all rows, a file per piece."""
    rows = spark.range(0, 4000, 1, 20).select(F.col("id").cast("string").alias("v"), (F.col("id") % 8).cast("string").alias("part"))
    stream.write_landing(rows, str(tmp_path / "l"), by=("part",))
    found = [f for _, _, fs in os.walk(tmp_path / "l") for f in fs if f.endswith(".csv")]
    assert len(found) == 8 and spark.read.option("header", True).csv(str(tmp_path / "l")).distinct().count() == 4000
    size = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    try:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "4096")
        stream.write_landing(rows.withColumn("part", F.lit("one")), str(tmp_path / "m"), by=("part",))
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", size)
    assert len([f for f in os.listdir(tmp_path / "m" / "part=one") if f.endswith(".csv")]) > 2


ODD = ["", ",", "a", "a,b", ",a,", " a , b ", "a,,b,c", "a\\,b", "\\,", "\ta,#b", "#a,b", "a,b,c,d,e,f,g,h", "'a,b'", "é,ü 文", "a\u0002,b", "\u0002,b", "-,\u00a0"]
QUOTED = ['"a",b', '"a,b",c', '"",b', 'a,""', '"a""b",c', '"a\\"b",c', 'a"b,c', '"open,b', 'a,"open', '\0a,b', 'a\0,"b"']


def test_split_lines_are_as_parsed(spark):
    """Lines split at their commas, and lines with quotes, give what the CSV
    parser gives: the fields, and where the line ends."""
    n = 6
    d = spark.createDataFrame([(i, v) for i, v in enumerate(ODD + QUOTED) if v], "i int, value string")
    names = [f"f{i}" for i in range(n)]
    csv = F.from_csv(F.concat("value", F.lit("," + ingest.END)), ", ".join(f"{c} string" for c in names))
    want = {r.i: tuple(r)[1:] for r in d.select("i", F.inline(F.array(csv))).collect()}
    got = {r.i: tuple([x or None for x in r.a] + [None] * n)[:n] for r in ingest._as_array(d, F.col("value"), n, "a").collect()}
    assert got == want


def test_lines_are_parsed_once_and_known_files_not(spark, tmp_path):
    """No filter repeats the parse, and lines of files in the manifest are
    dropped by the header table, before it."""
    landing, bronze = str(tmp_path / "l"), str(tmp_path / "b")
    put(landing, "a.csv", HEAD + price(ticker="old"))
    stream.ingest_to_bronze(spark, landing, "price", bronze, str(tmp_path / "c"))
    put(landing, "b.csv", HEAD + price(ticker="new") + price(ticker='"q,r"') + price(ticker="bad", ts="never"))
    new = ingest.read_landing(spark, landing, "price", stream.read_manifest(spark, bronze))
    assert sorted(r.ticker for r in new.collect()) == ["new", "q,r"]
    assert sorted(r.ticker for r in ingest.read_landing(spark, landing, "price").collect()) == ["new", "old", "q,r"]
    plan = new._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert not [x for x in plan if "Filter " in x and ("array_position" in x or "from_csv" in x)]
    at = {what: min(i for i, x in enumerate(plan) if what in x) for what in ("Generate explode", "LeftAnti")}
    assert at["LeftAnti"] > at["Generate explode"]


def test_one_file_is_read_by_several_tasks(spark, tmp_path):
    n = 20_000
    put(str(tmp_path / "l"), "big.csv", HEAD + "".join(price(close=str(i), ticker=f"T{i}") for i in range(n)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
        got = ingest.read_landing(spark, str(tmp_path / "l"), "price")
        assert got.select(F.spark_partition_id()).distinct().count() > 5
        assert got.agg(F.count(F.lit(1)), F.sum("Close"), F.countDistinct("ticker")).first()[:] == (n, n * (n - 1) / 2, n)
        stream.ingest_to_bronze(spark, str(tmp_path / "l"), "price", str(tmp_path / "b"), str(tmp_path / "c"))
        assert stream.read_bronze(spark, str(tmp_path / "b")).count() == n
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_bad_rows_are_counted_and_found(spark, tmp_path):
    landing, bronze = str(tmp_path / "l"), str(tmp_path / "b")
    lines = [price(ticker="good"), price(ticker="null field", High="oops"), price(ticker="two", High="x", Low="y"),
             price(ticker="no clock", ts="yesterday"), price(ticker="a,b"), price(ticker='"open'), "1,2\n", price(ticker='"q,q"'),
             "\n", HEAD, price(ticker="empty date", date="")]
    put(landing, "a.csv", HEAD + "".join(lines))
    put(landing, "sub/b.csv", "Close,ticker,Date,snapshot_time,snapshot_str\r\n1,ok,2024-01-02,2024-01-02 10:00:00.000000,r\r\n1,cut\r\n")
    stream.ingest_to_bronze(spark, landing, "price", bronze, str(tmp_path / "c"))
    kept = {r.ticker: r for r in stream.read_bronze(spark, bronze).collect()}
    assert set(kept) == {"good", "null field", "two", "q,q", "empty date", "ok"}
    assert kept["null field"].High is None and kept["null field"].Low == 1.0 and kept["empty date"].Date is None
    bad = {(r._source_file.rsplit("/", 1)[1], tuple(r.reasons), r.loaded) for r in stream.read_quarantine(spark, bronze).collect()}
    assert bad == {("a.csv", ("High: oops",), True), ("a.csv", ("High: x", "Low: y"), True), ("a.csv", ("snapshot_time: yesterday",), False),
                   ("a.csv", ("more fields, header has 11",), False), ("a.csv", ("open quote",), False),
                   ("a.csv", ("2 fields, header has 11",), False), ("b.csv", ("2 fields, header has 5",), False)}
    found = stream.read_quarantine(spark, bronze).where("NOT loaded").select("line").collect()
    assert "1,cut" in {r.line for r in found} and price(ticker="a,b").strip() in {r.line for r in found}
    assert {(r.path.rsplit("/", 1)[1], r.n_rows, r.n_bad) for r in stream.read_manifest(spark, bronze).collect()} == {("a.csv", 5, 6), ("b.csv", 1, 1)}


def test_headers_that_cannot_be_read_are_named(spark, tmp_path):
    put(str(tmp_path / "l"), "twice.csv", "Close," + HEAD + "1," + price())
    with pytest.raises(Exception, match="twice.csv names columns twice: Close"):
        ingest.read_landing(spark, str(tmp_path / "l"), "price").collect()


def test_manifest_knows_every_file(spark, tmp_path):
    landing, bronze, ckpt = (str(tmp_path / x) for x in "lbc")
    put(landing, "a.csv", HEAD + price())
    put(landing, "nothing.csv", "")
    put(landing, "header only.csv", HEAD)
    stream.ingest_to_bronze(spark, landing, "price", bronze, ckpt)
    said = {r.path.rsplit("/", 1)[1].replace("%20", " "): (r.n_rows, r.length > 0) for r in stream.read_manifest(spark, bronze).collect()}
    assert said == {"a.csv": (1, True), "nothing.csv": (0, False), "header only.csv": (0, True)}
    # the stream's own log is lost: nothing is read twice
    stream.ingest_to_bronze(spark, landing, "price", bronze, ckpt + "-new")
    assert stream.read_bronze(spark, bronze).count() == 1 and stream.read_manifest(spark, bronze).count() == 3
    put(landing, "b.csv", HEAD + price(ticker="TKB"))
    stream.ingest_to_bronze(spark, landing, "price", bronze, ckpt + "-newer")
    assert sorted(r.ticker for r in stream.read_bronze(spark, bronze).collect()) == ["TKA", "TKB"]


def test_batch_that_died_before_its_commit_counts_once(spark, tmp_path):
    landing, bronze = str(tmp_path / "l"), str(tmp_path / "b")
    put(landing, "a.csv", HEAD + price())
    lines = ingest.with_lines(spark.read.text(landing))
    stream.commit_batch(lines, "price", bronze)
    files.delete(spark, f"{bronze}/manifest/batch=0")
    assert stream.read_bronze(spark, bronze).count() == 0  # not committed, not seen
    for _ in range(2):
        stream.commit_batch(lines, "price", bronze)
        assert stream.read_bronze(spark, bronze).count() == 1


def test_paths_meet_however_they_are_spelt(spark):
    same = ["file:///data/l/a.csv", "file:/data/l/a.csv", "/data//l/./a.csv", "l/a.csv", "./l/a.csv"]
    d = spark.createDataFrame([(p,) for p in same], "p string").select(ingest.normal_path(F.col("p"), "/data").alias("n"))
    assert {r.n for r in d.collect()} == {"/data/l/a.csv"}
    far = spark.createDataFrame([("hdfs://host/x//a.csv",)], "p string").select(ingest.normal_path(F.col("p")).alias("n"))
    assert far.first().n == "hdfs://host/x/a.csv"


def silver_prices(spark, root):
    return {(r.ticker, str(r.Date)): r.Close for r in stream.read_silver(spark, root, "price").collect()}


def batch(spark, *rows):
    data = [(dt.date.fromisoformat(d), 1.0, hi, 0.5, c, 1, None, None, dt.datetime(2024, 1, 2, h), f"r{h}", t, f"f{h}") for t, d, c, h, hi in rows]
    return spark.createDataFrame(data, stream._bronze_schema("price"))


def test_failed_check_keeps_the_old_silver(spark, tmp_path):
    root = str(tmp_path / "s")
    good = batch(spark, ("A", "2024-01-01", 1.5, 9, 5.0), ("B", "2024-01-01", 2.5, 9, 5.0))
    assert stream.merge_into_silver(good, root, "price", quality.abort_silver_price) == []
    reader = stream.read_silver(spark, root, "price")
    worse = batch(spark, ("A", "2024-01-01", 1.6, 10, 0.1), ("C", "2024-01-01", 1.0, 10, 5.0))
    assert stream.merge_into_silver(worse, root, "price", quality.abort_silver_price) == ["invalid_price_logic"]
    assert silver_prices(spark, root) == {("A", "2024-01-01"): 1.5, ("B", "2024-01-01"): 2.5}
    assert len([n for n in files.names(spark, root) if n.startswith("m-")]) == 1
    assert stream.merge_into_silver(batch(spark, ("A", "2024-01-01", 1.7, 11, 5.0)), root, "price", quality.abort_silver_price) == []
    assert silver_prices(spark, root)["A", "2024-01-01"] == 1.7
    assert reader.count() == 2  # a reader that began before the merge still finds its files


def test_merge_rewrites_touched_buckets_only(spark, tmp_path):
    root = str(tmp_path / "s")
    stream.merge_into_silver(batch(spark, *[(f"T{i}", "2024-01-01", 1.0 + i, 9, 99.0) for i in range(40)]), root, "price")
    before = files.read_commit(spark, root)
    stream.merge_into_silver(batch(spark, ("T7", "2024-01-01", 50.0, 10, 99.0)), root, "price")
    after = files.read_commit(spark, root)
    moved = {b for b in after["folders"] if after["folders"][b] != before["folders"].get(b)}
    assert len(moved) == 1 and set(after["folders"]) == set(before["folders"]) and len(before["folders"]) > 4
    assert silver_prices(spark, root)["T7", "2024-01-01"] == 50.0 and len(silver_prices(spark, root)) == 40


def test_buckets_grow_with_the_table(spark, tmp_path):
    root = str(tmp_path / "s")
    for k in range(3):
        rows = batch(spark, *[(f"T{i}", f"2024-01-0{k + 1}", 1.0 + i, 9, 99.0) for i in range(30)])
        buckets.merge(spark, root, rows, stream.SILVER_KEYS["price"], stream._newest("price"), stream._silver_schema("price"), bucket_bytes=1000)
    assert files.read_commit(spark, root)["buckets"] > buckets.LEAST_BUCKETS
    assert len(silver_prices(spark, root)) == 90


OPTION_HEAD = ("contractSymbol,expiry,option_type,strike,bid,ask,lastPrice,volume,openInterest,impliedVolatility,"
               "delta,gamma,theta,vega,inTheMoney,snapshot_time,snapshot_str,ticker\n")


def option(sym, strike, iv, ts, run, ticker="TKA"):
    return f"{sym},2024-02-16,call,{strike},1.0,1.1,1.05,5,3.0,{iv},0.5,0.01,-0.02,0.1,True,{ts}.000000,{run},{ticker}\n"


def test_second_run_reads_no_old_bronze(spark, tmp_path):
    """Old Bronze files are gone before the second run, and the results are
    those of a rebuild over everything."""
    landing, wh = str(tmp_path / "l"), str(tmp_path / "wh")
    every = []
    for day, close in ((2, 50.0), (3, 53.0), (4, 51.5)):
        ts = f"2024-01-0{day} 10:00:00"
        rows = [option(f"K{k}", k, round(0.2 + k / 1000 + day / 100, 4), ts, f"r{day}") for k in range(44, 60)]
        put(f"{landing}/options", f"d{day}.csv", OPTION_HEAD + "".join(rows))
        put(f"{landing}/price", f"d{day}.csv", HEAD + price(f"2024-01-0{day}", str(close), ts=f"{ts}.000000", run=f"r{day}", High="99"))
        every += rows
        report = {r.table: r for r in medallion.run(spark, landing, wh).collect()}
        # the rank of a first run has no range and fails its own check
        assert all(r.published for r in report.values() if day > 2 or r.table != "gold_iv_rank"), report
        for kind in ("options", "price"):
            for n in files.names(spark, f"{wh}/bronze_{kind}/data"):
                files.delete(spark, f"{wh}/bronze_{kind}/data/{n}")
    opts, px = (ingest.read_landing(spark, f"{landing}/{k}", k) for k in ("options", "price"))
    want = gold.iv_rank(gold.iv_per_snapshot(opts, px)).collect()
    got = medallion.read_table(spark, wh, "gold_iv_rank").collect()
    assert got == want and got[0].snapshot_count == 3
    assert medallion.read_table(spark, wh, "gold_latest_snapshot").count() == 16


def test_failed_price_merge_holds_what_depends_on_it(spark, tmp_path):
    landing, wh = str(tmp_path / "l"), str(tmp_path / "wh")
    put(f"{landing}/options", "a.csv", OPTION_HEAD + "".join(option("K2", 2, 0.1 * k, f"2024-01-02 1{k}:00:00", f"r{k}") for k in (1, 2)))
    put(f"{landing}/price", "a.csv", HEAD + price(High="0.1"))
    report = {r.table: r for r in medallion.run(spark, landing, wh).collect()}
    assert not report["silver_price_daily"].published and report["silver_price_daily"].failed == "invalid_price_logic"
    assert report["gold_iv_rank"].failed == "upstream:silver_price_daily" and report["gold_pcr"].published
    # a corrected snapshot of the same day supersedes the bad row in the next run
    put(f"{landing}/price", "b.csv", HEAD + price(ts="2024-01-02 17:00:00.000000", run="r2"))
    report = {r.table: r for r in medallion.run(spark, landing, wh).collect()}
    assert all(r.published for r in report.values()), report
