from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidegrid.operators import checks, features, leakage, split, temporal, windows
from tidegrid.schema import FEATURE_COLUMNS, TIMEFRAMES

T0 = datetime(2020, 1, 1)
STEP = {"15m": timedelta(minutes=15), "1h": timedelta(hours=1), "4h": timedelta(hours=4), "1d": timedelta(days=1)}
BASE = {"1h": 1000.0, "15m": 100.0, "4h": 5000.0, "1d": 20000.0}
COLS = "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double"


def frame(spark, rows):
    return spark.createDataFrame(rows, COLS)


def four(spark, days=2, skip=()):
    out = {}
    for tf, step in STEP.items():
        rows = []
        for i in range(int(timedelta(days=days) / step)):
            ts = T0 + i * step
            if tf in ("1h", "15m") and ts.replace(minute=0) in skip:
                continue
            o = BASE[tf] + i
            rows.append(("a", ts, o, o + 1.5, o - 1.0, o + 0.5, 10.0))
        out[tf] = frame(spark, rows)
    return out


def test_resample_takes_first_high_low_last_sum(spark):
    rows = [("a", T0 + k * STEP["15m"], 1.0 + k, 1.5 + k, 0.5 + k, 1.2 + k, 10.0) for k in range(4)]
    r = temporal.resample(frame(spark, rows), "1h").first()
    assert (r.open, r.high, r.low, r.close, r.volume) == (1.0, 4.5, 0.5, 4.2, 40.0)


def test_master_values_by_hand(spark):
    rows = {r.ts: r for r in temporal.master(four(spark)).collect()}
    assert len(rows) == 48
    for h in (0, 5, 30, 47):
        r = rows[T0 + timedelta(hours=h)]
        assert r.open_1h == 1000 + h and r.open_15m == 100 + 4 * h and r.close_15m == 103.5 + 4 * h and r.volume_15m == 40
        assert r.open_4h == 5000 + h // 4 and r.open_1d == 20000 + h // 24


def test_outage_carries_prices_and_zeroes_volume(spark):
    hole = T0 + timedelta(hours=10)
    rows = {r.ts: r for r in temporal.master(four(spark, skip=(hole,))).collect()}
    a, b = rows[hole - STEP["1h"]], rows[hole]
    assert len(rows) == 48 and b.volume_1h == 0 and b.volume_15m == 0
    assert (b.open_1h, b.close_1h, b.close_15m) == (a.open_1h, a.close_1h, a.close_15m)


def test_missing_timeframe_is_an_error(spark):
    s = four(spark)
    del s["4h"]
    with pytest.raises(ValueError, match="4h"):
        temporal.master(s)


def test_asof_equals_master_and_bounds_age(spark):
    s = four(spark)
    grid = temporal.hour_grid(s["1h"])
    got = {r.ts: r.open for r in temporal.asof(grid, s["4h"], ["open"], max_age="1 hour").collect()}
    assert got[T0 + timedelta(hours=5)] == 5001 and got[T0 + timedelta(hours=7)] is None


def test_lookahead_detector_finds_a_future_open(spark):
    s = four(spark)
    table = temporal.master(s)
    assert leakage.lookahead(table, s["4h"], "4h").filter(~F.col("passed")).count() == 0
    wrong = table.withColumn("open_4h", F.when(F.hour("ts") == 0, F.col("open_4h") + 1).otherwise(F.col("open_4h")))
    assert leakage.lookahead(wrong, s["4h"], "4h").filter(~F.col("passed")).count() == 2
    with pytest.raises(ValueError):
        leakage.lookahead(table, s["1h"], "1h")


def test_unfinished_bars_only_without_close_times(spark):
    s = four(spark)
    count = lambda how: leakage.unfinished_bars(temporal.master(s, availability=how), s["4h"], "4h").first().n_unfinished
    assert count("open") == 36 and count("close") == 0


def test_features_by_hand(spark):
    rows = [("a", T0 + k * STEP["1h"], 100.0 + k, 103.0 + k, 98.0 + k, 101.0 + k, 10.0 + k) for k in range(30)]
    t = frame(spark, rows).select("symbol", "ts", *[F.col(c).alias(f"{c}_1h") for c in ("open", "high", "low", "close", "volume")])
    got = features.features(t, ("1h",)).orderBy("ts").collect()
    assert got[0].open_return_1h is None and got[18].volume_zscore_1h is None
    r = got[29]
    assert r.open_return_1h == 0 and abs(r.hl_range_1h - 5 / 129) < 1e-12 and abs(r.body_ratio_1h - 0.2) < 1e-8
    assert abs(r.volume_zscore_1h - 1.605793) < 1e-6
    assert features.complete(features.features(t, ("1h",)), [c for c in FEATURE_COLUMNS if c.endswith("_1h")]).count() == 11
    halo = features.features(t, ("1h",), bucket=24).orderBy("ts").collect()
    assert [tuple(x) for x in halo] == [tuple(x) for x in got]
    with pytest.raises(ValueError, match="halo"):
        features.features(t, ("1h",), bucket=7)
    flat = features.features(t.withColumn("volume_1h", F.lit(0.1)), ("1h",)).orderBy("ts").collect()
    assert flat[25].volume_zscore_1h == 0


def test_carry_in_buckets_equals_one_window(spark):
    rows = [("a", T0 + k * STEP["1h"], float(k) if k % 11 == 3 else None, 1.0, 1.0, 1.0, 1.0) for k in range(60)]
    df = frame(spark, rows)
    want = {r.ts: r.open for r in df.select("ts", *temporal.carry(["open"], ("symbol",))).collect()}
    assert {r.ts: r.open for r in temporal.carry_in_buckets(df, ["open"], 8).collect()} == want


def test_checks_pass_and_fail(spark):
    good = four(spark)["1h"]
    assert checks.report(good, "1h").filter(~F.col("passed")).count() == 0
    bad = good.withColumn("high", F.when(F.hour("ts") == 3, F.lit(1.0)).otherwise(F.col("high"))).withColumn("close", F.when(F.hour("ts") == 4, F.lit(-1.0)).otherwise(F.col("close")))
    failed = {r.check for r in checks.report(bad, "1h").filter(~F.col("passed")).collect()}
    assert failed == {"ohlc_integrity", "positive_prices"}
    with pytest.raises(checks.ValidationError, match="ohlc"):
        checks.enforce(checks.report(bad, "1h"))
    holes = good.filter(~F.hour("ts").between(3, 8))
    failed = {r.check for r in checks.report(holes, "1h").filter(~F.col("passed")).collect()}
    assert failed == {"gap_ratio", "no_excessive_single_gap"}
    assert checks.report(good.limit(1), "1h").filter("check = 'gap_ratio'").first().metric == 0
    twice = good.unionByName(good.limit(1))
    assert "no_duplicate_timestamps" in {r.check for r in checks.report(twice, "1h").filter(~F.col("passed")).collect()}
    assert checks.report(good.drop("close"), "1h").first().check == "columns_present"
    assert checks.report(good, "1h", "2020-01-01", "2020-01-02").filter("check = 'date_range_coverage'").first().passed
    assert not checks.report(good, "1h", "2020-01-01", "2020-01-03").filter("check = 'date_range_coverage'").first().passed


def test_split_boundary_and_leaks(spark):
    rows = [("a", datetime(2022, 12, 31, 20) + k * STEP["1h"], 1.0, 1.0, 1.0, 1.0, 1.0) for k in range(8)]
    df = split.split(frame(spark, rows).withColumn("volume_zscore_1h", F.lit(0.0)))
    assert {r.split: r["count"] for r in df.groupBy("split").count().collect()} == {"train": 4, "test": 4}
    assert split.check_boundary(df).first().passed and split.overlap(df).count() == 0
    wrong = df.withColumn("split", F.lit("train"))
    assert not split.check_boundary(wrong).first().passed and split.leaks(wrong).first().n_train_late == 4


@pytest.fixture(scope="module")
def matrix(spark):
    rows = spark.range(120).select(F.lit("a").alias("symbol"), (F.lit(datetime(2022, 12, 30)).cast("timestamp_ntz") + F.expr("make_interval(0, 0, 0, 0, id, 0, 0)")).alias("ts"), "id")
    return rows.select("symbol", "ts", *[(F.sin(F.col("id") * (k + 1)) + k).alias(c) for k, c in enumerate(FEATURE_COLUMNS)])


def test_windows_counts_overlap_and_local_statistics(spark, matrix):
    raw = windows.extract(matrix, "1h")
    assert raw.count() == 73 and windows.extract(matrix.limit(47), "1h").count() == 0
    w = windows.categorise(raw)
    assert windows.boundary_overlap(w).first().n_overlap == 47 and windows.check_periods(w).first().passed
    assert windows.without_overlap(w).filter("split = 'test'").count() == 25
    done = windows.normalise(raw)
    assert windows.check_local(raw, done).first().n_off == 0
    globally = raw.withColumn("x", F.struct(*[F.transform(f"x.{f}", lambda v: (v - 0.3).cast("float")).alias(f) for f in raw.schema["x"].dataType.names]))
    assert windows.check_local(raw, globally).first().n_off > 0
    late = w.withColumn("split", F.lit("train"))
    assert not windows.check_periods(late).first().passed
    assert windows.check_shape(raw).first().n_bad == 0 and windows.check_shape(raw, 47).first().n_bad == 73
    halo = windows.extract(matrix, "1h", bucket=50)
    assert halo.exceptAll(raw).count() == 0 and halo.count() == 73


def test_no_single_partition_with_buckets(spark, matrix):
    plan = windows.extract(matrix, "1h", bucket=50)._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan


def test_all_timeframes_have_features():
    assert len(FEATURE_COLUMNS) == 28 and set(TIMEFRAMES) == set(STEP)
