"""Gates give their tables on, or raise by the name of the check; acquisition, validation results and bundles."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from test_temporal import four

from tidegrid.operators import checks, gates
from tidegrid.schema import FEATURE_COLUMNS, TIMEFRAMES, WINDOW
from tidegrid.sources import runs

BOUNDS = ("2020-01-02 11:00:00", "2020-01-02 12:00:00")


def test_master_gate_passes_whole_series_and_names_failures(spark, tmp_path):
    series = four(spark)
    table = gates.build_master(series, 48, path=str(tmp_path / "master"))
    assert table.count() == 48
    with pytest.raises(gates.GateError) as e:
        gates.require(gates.master_report(table, series, 60), "master")
    assert e.value.failed == ["rows"]
    shifted = table.withColumn("open_4h", F.col("open_4h") + 1)
    holed = table.filter(F.hour("ts") != 5).drop("volume_1d")
    found = {r.check for r in gates.master_report(shifted, series).filter("not passed").collect()}
    assert found == {"lookahead_4h"}
    assert {r.check for r in gates.master_schema(holed).filter("not passed").collect()} == {"columns", "hourly"}
    twice = table.union(table.limit(1))
    assert "distinct_times" in {r.check for r in gates.master_schema(twice).filter("not passed").collect()}


def _matrix(spark, n=120):
    t0 = datetime(2020, 1, 1)
    rows = [("a", t0 + timedelta(hours=i), *[float((i * 7 + k * 3) % 11) for k in range(len(FEATURE_COLUMNS))]) for i in range(n)]
    return spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, " + ", ".join(f"{c} double" for c in FEATURE_COLUMNS))


def test_feature_report_finds_bad_values_rows_and_start(spark):
    m = _matrix(spark)
    assert not gates.features_report(m, 120, "2020-01-01 00:00:00").filter("not passed").count()
    bad = m.withColumn("hl_range_4h", F.when(F.hour("ts") == 3, float("inf")).otherwise(F.col("hl_range_4h"))).withColumn("body_ratio_1d", F.when(F.hour("ts") == 4, float("nan")).otherwise(1.0))
    got = {r.check: r for r in gates.features_report(bad, 119, "2020-01-01 01:00:00").collect()}
    assert got["finite"].metric == 10 and [k for k, r in got.items() if not r.passed] == ["finite", "rows", "first_time"]


def test_feature_gate_needs_a_first_full_window(spark):
    table = gates.build_master(four(spark))
    with pytest.raises(gates.GateError):
        gates.build_features(table, expected=1)


def test_split_gate(spark):
    m = _matrix(spark)
    parts = gates.build_split(m, *BOUNDS, {"train": 36, "test": 84}, 0)
    assert parts.count() == 120
    late = parts.withColumn("split", F.when(F.col("ts") == F.lit("2020-01-02 13:00:00").cast("timestamp_ntz"), "train").otherwise(F.col("split")))
    failed = {r.check for r in gates.split_report(late, *BOUNDS, {"train": 36, "test": 84}, 0).filter("not passed").collect()}
    assert failed == {"boundary", "no_leak", "sizes"}
    both = parts.unionByName(parts.filter("split = 'test'").limit(1).withColumn("split", F.lit("train")))
    assert "no_overlap" in {r.check for r in gates.split_report(both, *BOUNDS).filter("not passed").collect()}
    with pytest.raises(gates.GateError):
        gates.build_split(m.filter(F.col("ts") < F.lit("2020-01-02").cast("timestamp_ntz")), *BOUNDS)


def test_windows_gate(spark, tmp_path):
    bounds = ("2020-01-03 11:00:00", "2020-01-03 12:00:00")
    w = gates.build_windows(_matrix(spark), ("1h", "4h"), *bounds, path=str(tmp_path / "w"))
    assert {(r.tf, r.split): r["count"] for r in w.groupBy("tf", "split").count().collect()} == {(tf, s): n for tf in ("1h", "4h") for s, n in (("train", 60 - WINDOW + 1), ("test", 60))}
    with pytest.raises(gates.GateError) as e:
        gates.require(gates.windows_report(w.filter("tf = '1h'").withColumn("split", F.lit("train")), None, *bounds), "windows")
    assert e.value.failed == ["periods"]
    with pytest.raises(gates.GateError):
        split_raw = w.filter("tf = '1h'").withColumn("x", F.struct(*[F.slice(f"x.{f}", 1, 47).alias(f) for f in w.schema["x"].dataType.names]))
        gates.require(gates.windows_report(split_raw, None, *bounds), "windows")


def test_acquire_keeps_what_is_current(spark, tmp_path):
    folder, asked = str(tmp_path / "raw"), []
    series = four(spark)

    def fetch(tf):
        asked.append(tf)
        return series[tf].unionByName(series[tf].limit(3))

    first = {r.timeframe: r for r in runs.acquire(spark, fetch, folder, "2020-01-01", "2020-01-01").collect()}
    assert {r.status for r in first.values()} == {"written"} and first["1h"].rows == 24 and first["15m"].last == "2020-01-01T23:45:00"
    second = runs.acquire(spark, fetch, folder, "2020-01-01", "2020-01-01").collect()
    assert {r.status for r in second} == {"kept"} and asked == list(TIMEFRAMES)
    spark.range(1).write.mode("append").parquet(f"{folder}/bars_4h")  # a changed folder is fetched again
    third = {r.timeframe: r.status for r in runs.acquire(spark, fetch, folder, "2020-01-01", "2020-01-01").collect()}
    assert third == {"15m": "kept", "1h": "kept", "4h": "written", "1d": "kept"}
    assert {r.status for r in runs.acquire(spark, fetch, folder, "2020-01-01", "2020-01-01", force=True).collect()} == {"written"}


def test_validation_results_add_up_by_run(spark, tmp_path):
    report = checks.report(four(spark)["1h"].withColumn("volume", F.lit(-1.0)), "1h")
    runs.append_validation(report, str(tmp_path), "one")
    got = {r.run: r for r in runs.append_validation(report, str(tmp_path), "two").collect()}
    assert set(got) == {"one", "two"} and got["two"].errors == 1 and got["one"].checks == 10


def test_bundle_tells_changes(spark, tmp_path):
    folder = tmp_path / "bundle"
    (folder / "in").mkdir(parents=True)
    for name in ("a.txt", "in/b.txt", "c.txt"):
        (folder / name).write_text(name)
    assert runs.bundle(spark, str(folder), str(tmp_path / "manifest")).count() == 3
    (folder / "a.txt").write_text("other")
    (folder / "c.txt").unlink()
    (folder / "d.txt").write_text("new")
    got = {r.file: r.status for r in runs.verify_bundle(spark, str(folder), str(tmp_path / "manifest")).collect()}
    assert got == {"a.txt": "changed", "in/b.txt": "same", "c.txt": "missing", "d.txt": "new"}
    with pytest.raises(ValueError):
        runs.bundle(spark, str(folder), str(folder / "manifest"))


def test_an_empty_table_fails(spark):
    with pytest.raises(gates.GateError) as e:
        gates.build_split(_matrix(spark).limit(0), *BOUNDS)
    assert e.value.failed == ["no rows"]
