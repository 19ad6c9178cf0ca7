"""Registered queries against their SQL on the smallest tables, which have holes."""

from pathlib import Path

import pytest

DATA = Path("/root/testdata/sf0.001")
NAMES = ["b_report", "b_report_faults", "c11_master_gate", "c3_asof", "c4_fill_gaps", "c6_master", "c8_lookahead", "d10_complete", "f8_boundary_overlap", "l2_silhouette", "l9_holm", "m10_persistence", "j6_cluster_artifact"]


@pytest.fixture(scope="module")
def duck():
    if not DATA.exists():
        pytest.skip("no test tables here")
    import duckdb

    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    return con


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple("null" if v is None or v != v else str(v) for v in r) for r in df.astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    from tidegrid.plans import registry

    got = registry.queries()[name](spark, str(DATA)).toPandas()
    want = duck.execute(registry.oracle_sql()[name]).df()
    assert rows(got) == rows(want) and len(got)


@pytest.mark.parametrize("name", ["j6_cluster_artifact_all", "j7_ohlcv_with_return_all"])
def test_queries_of_all_series_equal_sql(spark, duck, name):
    test_query_equals_sql(spark, duck, name)


def test_markov_models_of_all_series(spark):
    if not DATA.exists():
        pytest.skip("no test tables here")
    from tidegrid.plans import models, registry

    want = {r.symbol for r in models._matrix(spark, str(DATA)).select("symbol").distinct().collect()}
    got = registry.queries()["k2_hmm"](spark, str(DATA)).collect()
    assert {r.symbol for r in got} == want and len(want) > 1


def test_density_grid_takes_every_setting(spark):
    if not DATA.exists():
        pytest.skip("no test tables here")
    from tidegrid.operators.clustering import SAMPLES, SIZES
    from tidegrid.plans import registry

    got = registry.queries()["j3_density_grid"](spark, str(DATA)).collect()
    assert {(r.min_cluster_size, r.min_samples) for r in got} == {(a, b) for a in SIZES for b in SAMPLES}


def test_every_oracle_has_a_query():
    from tidegrid.plans import registry

    assert set(registry.oracle_sql()) <= set(registry.queries())


def test_stream_bars_equal_batch_bars(spark, tmp_path):
    if not DATA.exists():
        pytest.skip("no test tables here")
    from pyspark.sql import functions as F

    from tidegrid.operators.temporal import bars
    from tidegrid.sources.tables import ticks
    from tidegrid.streaming.bars import stream_bars

    src = str(tmp_path / "in")
    batch = ticks(spark, str(DATA)).filter(F.col("ts") < F.lit("2024-01-02").cast("timestamp_ntz"))
    batch.coalesce(1).write.parquet(src)
    stream = spark.readStream.schema(batch.schema).parquet(src)
    q = stream_bars(stream, "1h").writeStream.outputMode("complete").format("memory").queryName("bars").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("bars").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    want = bars(batch, "1h")
    key = lambda df: sorted((r.symbol, r.ts, r.open, r.high, r.low, r.close, round(r.volume, 6)) for r in df.collect())
    assert key(got) == key(want)
