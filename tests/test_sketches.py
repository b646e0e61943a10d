"""Reports from kept daily sketches against the exact forms."""
from pyspark.sql import functions as F

from chainlake.operators import quality, sketches, stats, tracker
from chainlake.plans.tables import Tables

SF = "/root/testdata/sf0.001"


def many(spark, n=60_000):
    """Snapshots of one ticker over 40 days, a run of its own each minute."""
    i = F.col("id")
    t = F.timestamp_seconds(F.lit(1_704_067_200) + i * 60).cast("timestamp_ntz")
    return spark.range(n).select(
        F.lit("TK").alias("ticker"), F.concat(F.lit("C"), (i % 3).cast("string")).alias("contractSymbol"),
        F.lit("2024-06-21").cast("date").alias("expiry"), F.lit("call").alias("option_type"), F.lit(50.0).alias("strike"),
        (1.0 + i % 17).alias("lastPrice"), ((i * 7919 % 100_003) / 100_003.0 + 0.02).alias("impliedVolatility"),
        F.lit(0.25).alias("delta"), t.alias("snapshot_time"), F.date_format(t, "yyyyMMdd_HHmmss").alias("snapshot_str"))


def in_parts(df, make):
    """Sketches of three batches, put together as a kept table is."""
    return make(df.where("hash(snapshot_str) % 3 = 0")).unionByName(make(df.where("hash(snapshot_str) % 3 = 1"))).unionByName(
        make(df.where("hash(snapshot_str) % 3 NOT IN (0, 1)")))


def test_health_within_the_stated_error(spark):
    b = many(spark)
    (got,), (want,) = sketches.health_bronze(in_parts(b, sketches.run_sketches)).collect(), quality.health_bronze(b).collect()
    assert abs(got.total_snapshots - want.total_snapshots) <= sketches.COUNT_ERROR * want.total_snapshots
    assert (got.last_snapshot, got.total_rows) == (want.last_snapshot, want.total_rows)


def test_contracts_within_the_stated_error(spark):
    b = many(spark)
    kept = in_parts(b, sketches.contract_sketches)
    want = {r.contractSymbol: r for r in tracker.contract_summary(b).collect()}
    for r in sketches.contract_summary(kept).collect():
        w = want.pop(r.contractSymbol)
        assert abs(r.snapshots - w.snapshots) <= sketches.COUNT_ERROR * w.snapshots
        assert (r.price_min, r.price_max, r.iv_avg_pct, r.delta_avg) == (w.price_min, w.price_max, w.iv_avg_pct, w.delta_avg)
    assert not want
    assert {r.contractSymbol for r in sketches.trackable(kept, 15_000).collect()} == {r.contractSymbol for r in tracker.trackable(b, 15_000).collect()}


def test_small_counts_are_exact(spark):
    b = Tables(spark, SF).bronze_options()
    want = sorted(map(tuple, tracker.contract_summary(b).collect()))
    assert sorted(map(tuple, sketches.contract_summary(sketches.contract_sketches(b)).select(*tracker.contract_summary(b).columns).collect())) == want


def test_rank_error_of_the_quantile_sketch(spark):
    b = many(spark)
    pts = sketches.qq_points(in_parts(b, sketches.iv_sketches), points=500).collect()
    iv = sorted(r.iv for r in stats.iv_sample(b).collect())
    assert [r.j for r in sorted(pts, key=lambda r: r.j)] == list(range(1, 501)) and {r.n for r in pts} == {len(iv)}
    import bisect
    err = max(max(bisect.bisect_left(iv, r.osr) / len(iv) - r.p, r.p - bisect.bisect_right(iv, r.osr) / len(iv)) for r in pts)
    assert err <= sketches.RANK_ERROR, err
    exact = {r.i: r.osm for r in stats.qq_points(stats.iv_sample(b)).where("i % 100 = 0").collect()}
    assert exact  # the exact form stays


def test_reports_read_sketches_only(spark, tmp_path):
    sketches.run_sketches(many(spark, 500)).write.parquet(str(tmp_path / "kept"))
    kept = spark.read.parquet(str(tmp_path / "kept"))
    assert sketches.health_bronze(kept).inputFiles() == kept.inputFiles()
    assert sketches.health_bronze(kept.limit(0)).collect() == []
