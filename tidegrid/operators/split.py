"""Split by calendar, with its checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The reference period's boundary.
TRAIN_END, TEST_START = "2022-12-31 23:00:00", "2023-01-01 00:00:00"


def _at(x: str):
    return F.lit(x).cast("timestamp_ntz")


def split(df: DataFrame, train_end: str = TRAIN_END, test_start: str = TEST_START, ts: str = "ts") -> DataFrame:
    """``df`` with ``split``: train up to ``train_end``, test from ``test_start``; rows strictly between are dropped."""
    part = F.when(F.col(ts) <= _at(train_end), "train").when(F.col(ts) >= _at(test_start), "test")
    return df.withColumn("split", part).filter(F.col("split").isNotNull())


def check_boundary(df: DataFrame, train_end: str = TRAIN_END, test_start: str = TEST_START, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, train_last, test_first, passed): the sides end and begin exactly at the boundary; an empty side fails."""
    last, first = F.max(F.when(F.col("split") == "train", F.col("ts"))), F.min(F.when(F.col("split") == "test", F.col("ts")))
    got = df.groupBy(*keys).agg(last.alias("train_last"), first.alias("test_first"))
    return got.withColumn("passed", F.coalesce((F.col("train_last") == _at(train_end)) & (F.col("test_first") == _at(test_start)), F.lit(False)))


def overlap(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, ts) that stand on both sides; none, if the split is right."""
    side = lambda s: df.filter(F.col("split") == s).select(*keys, "ts")
    return side("train").intersect(side("test"))


def sizes(df: DataFrame, expected: dict[str, int] | None = None, within: int = 50, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, split, n, passed): rows of each side, held against what is expected, if anything."""
    got = df.groupBy(*keys, "split").agg(F.count("*").alias("n"))
    if not expected:
        return got.withColumn("passed", F.lit(True))
    want = F.create_map(*[x for k, v in expected.items() for x in (F.lit(k), F.lit(v))])
    return got.withColumn("passed", F.coalesce(F.abs(F.col("n") - want[F.col("split")]) <= within, F.lit(True)))


def leaks(df: DataFrame, train_end: str = TRAIN_END, test_start: str = TEST_START, note: str = "volume_zscore_1h", keys: Sequence[str] = ()) -> DataFrame:
    """(keys, n_train_late, n_test_early, passed, first_test_value): rows on the wrong side; the first test row's rolling
    value is for information, as it looks back over the boundary by design."""
    train, test = F.col("split") == "train", F.col("split") == "test"
    got = df.groupBy(*keys).agg(
        F.count_if(train & (F.col("ts") > _at(train_end))).alias("n_train_late"),
        F.count_if(test & (F.col("ts") < _at(test_start))).alias("n_test_early"),
        F.min_by(note, F.when(test, F.col("ts"))).alias("first_test_value"),
    )
    return got.withColumn("passed", (F.col("n_train_late") == 0) & (F.col("n_test_early") == 0))
