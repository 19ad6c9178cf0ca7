"""Stages that raise: each makes its table, checks it, and gives it on only if every check passes.

A report has (keys, check, passed, metric).  With ``path`` a stage's table is written first and read again, so that the checks
and whatever follows read the same rows and nothing is computed twice.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.operators import checks, features, leakage, split, temporal, windows
from tidegrid.operators.temporal import KEYS
from tidegrid.schema import FEATURE_COLUMNS, FEATURES, MASTER_COLUMNS, TIMEFRAMES, WINDOW

ROWS_WITHIN = 5


class GateError(ValueError):
    """A stage's table failed checks; ``failed`` lists them."""

    def __init__(self, stage: str, failed: Sequence[str]):
        super().__init__(f"{stage}: {', '.join(failed)}")
        self.failed = list(failed)


def require(found: DataFrame, stage: str) -> None:
    """An error that names failed checks, if there are any; a check without a result has failed, and so has an empty report,
    which an empty table gives."""
    got = found.groupBy("check").agg(F.bool_and(F.coalesce("passed", F.lit(False))).alias("passed")).orderBy("check").collect()
    if not got:
        raise GateError(stage, ["no rows"])
    if bad := [r.check for r in got if not r.passed]:
        raise GateError(stage, bad)


def _kept(df: DataFrame, path: str | None) -> DataFrame:
    if path is None:
        return df
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def _lines(got: DataFrame, keys: Sequence[str], found: dict[str, tuple[Column, Column]]) -> DataFrame:
    """One aggregate row as a row for each check."""
    rows = [F.struct(F.lit(k).alias("check"), p.alias("passed"), F.coalesce(x.cast("double"), F.lit(0.0)).alias("metric")) for k, (p, x) in found.items()]
    return got.select(*keys, F.explode(F.array(*rows)).alias("_r")).select(*keys, "_r.*")


def _columns(df: DataFrame, wanted: Sequence[str]) -> tuple[Column, Column]:
    gone = [c for c in wanted if c not in df.columns]
    return F.lit(not gone), F.lit(len(gone))


def master_schema(table: DataFrame, expected: int | None = None, within: int = ROWS_WITHIN, keys: Sequence[str] = KEYS) -> DataFrame:
    """Report on a master table: columns, UTC, distinct times an hour apart, and the number of rows if one is expected."""
    grid = checks.grid_complete(table, keys).join(table.groupBy(*keys).agg(F.countDistinct("ts").alias("n_distinct")), list(keys))
    found = {
        "columns": _columns(table, ["ts", *MASTER_COLUMNS]),
        "utc": (F.lit(checks.utc(table)), F.lit(0)),
        "distinct_times": (F.col("n") == F.col("n_distinct"), F.col("n") - F.col("n_distinct")),
        "hourly": (F.col("complete"), F.col("n_breaks")),
    }
    if expected is not None:
        found["rows"] = (F.abs(F.col("n") - expected) <= within, F.col("n"))
    return _lines(grid, keys, found)


def master_report(table: DataFrame, series: dict[str, DataFrame], expected: int | None = None, keys: Sequence[str] = KEYS) -> DataFrame:
    """``master_schema`` and, over every row, the look-ahead checks of the coarse timeframes."""
    out = master_schema(table, expected, keys=keys)
    for tf in ("4h", "1d"):
        seen = leakage.lookahead(table, series[tf], tf, keys).groupBy(*keys).agg(F.count_if(~F.col("passed")).alias("n"))
        out = out.unionByName(_lines(seen, keys, {f"lookahead_{tf}": (F.col("n") == 0, F.col("n"))}))
    return out


def build_master(series: dict[str, DataFrame], expected: int | None = None, keys: Sequence[str] = KEYS, path: str | None = None) -> DataFrame:
    """The master table, if it passes ``master_report``."""
    table = _kept(temporal.master(series, keys), path)
    require(master_report(table, series, expected, keys), "master")
    return table


def features_report(matrix: DataFrame, expected: int | None = None, first: str | None = None, keys: Sequence[str] = KEYS) -> DataFrame:
    """Report on a feature matrix: columns, no null, NaN or infinite value, and rows and first time if they are expected."""
    here = [c for c in FEATURE_COLUMNS if c in matrix.columns]
    bad = lambda c: F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == float("inf"))
    got = matrix.groupBy(*keys).agg(F.count("*").alias("n"), F.min("ts").alias("first"), sum((F.count_if(bad(c)) for c in here), F.lit(0)).alias("n_bad"))
    found = {"columns": _columns(matrix, ["ts", *FEATURE_COLUMNS]), "finite": (F.col("n_bad") == 0, F.col("n_bad"))}
    if expected is not None:
        found["rows"] = (F.col("n") == expected, F.col("n"))
    if first is not None:
        found["first_time"] = (F.col("first") == F.lit(first).cast("timestamp_ntz"), F.lit(0))
    return _lines(got, keys, found)


def build_features(table: DataFrame, expected: int | None = None, first: str | None = None, keys: Sequence[str] = KEYS, bucket: int | None = None, path: str | None = None) -> DataFrame:
    """The complete rows of the feature matrix, if they pass ``features_report``."""
    matrix = _kept(features.complete(features.features(table, keys=keys, bucket=bucket)), path)
    require(features_report(matrix, expected, first, keys), "features")
    return matrix


def split_report(parts: DataFrame, train_end: str = split.TRAIN_END, test_start: str = split.TEST_START, expected: dict[str, int] | None = None, within: int = 50, keys: Sequence[str] = KEYS) -> DataFrame:
    """Report on a split: ends at the boundary, no time on both sides, sizes, no row on the wrong side."""
    both = parts.groupBy(*keys, "ts").agg(F.countDistinct("split").alias("k")).groupBy(*keys).agg(F.count_if(F.col("k") > 1).alias("n"))
    size = split.sizes(parts, expected, within, keys).groupBy(*keys).agg(F.count_if("passed").alias("n_right"), F.sum("n").alias("n"))
    ends = split.check_boundary(parts, train_end, test_start, keys)
    late = split.leaks(parts, train_end, test_start, keys=keys)
    every = [
        _lines(ends, keys, {"boundary": (F.col("passed"), F.lit(0))}),
        _lines(both, keys, {"no_overlap": (F.col("n") == 0, F.col("n"))}),
        _lines(size, keys, {"sizes": (F.col("n_right") == 2, F.col("n"))}),
        _lines(late, keys, {"no_leak": (F.col("passed"), F.col("n_train_late") + F.col("n_test_early"))}),
    ]
    return reduce(DataFrame.unionByName, every)


def build_split(matrix: DataFrame, train_end: str = split.TRAIN_END, test_start: str = split.TEST_START, expected: dict[str, int] | None = None, within: int = 50, keys: Sequence[str] = KEYS, path: str | None = None) -> DataFrame:
    """The matrix with ``split``, if it passes ``split_report``."""
    parts = _kept(split.split(matrix, train_end, test_start), path)
    require(split_report(parts, train_end, test_start, expected, within, keys), "split")
    return parts


def windows_report(done: DataFrame, raw: DataFrame | None = None, train_end: str = split.TRAIN_END, test_start: str = split.TEST_START, keys: Sequence[str] = KEYS) -> DataFrame:
    """Report on one timeframe's windows, in one pass: whole and finite, anchors on their side, and at most a window's length
    less one of test windows that reach back.  With ``raw`` windows also whether values follow each window's own statistics,
    held against a second computation over all cells."""
    odd = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    bad = reduce(lambda a, b: a | b, [(F.size(f"x.{f}") != WINDOW) | F.exists(f"x.{f}", odd) for f in FEATURES])
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    train, test = F.col("split") == "train", F.col("split") == "test"
    got = done.groupBy(*keys).agg(
        F.count_if(bad).alias("n_bad"),
        F.count_if(train & (F.col("anchor") > at(train_end)) | test & (F.col("anchor") < at(test_start))).alias("n_astray"),
        F.countDistinct("split").alias("sides"),
        F.count_if(test & (F.col("earliest") < at(test_start))).alias("n_back"),
    )
    out = _lines(got, keys, {
        "shape": (F.col("n_bad") == 0, F.col("n_bad")),
        "periods": ((F.col("n_astray") == 0) & (F.col("sides") == 2), F.col("n_astray")),
        "boundary_overlap": (F.col("n_back") <= WINDOW - 1, F.col("n_back")),
    })
    if raw is None:
        return out
    local = _lines(windows.check_local(raw, done, keys), [], {"local_statistics": ((F.col("n_off") == 0) & (F.col("n") > 0), F.col("n_off"))})
    return out.unionByName(local, allowMissingColumns=True)


def build_windows(matrix: DataFrame, timeframes: Sequence[str] = TIMEFRAMES, train_end: str = split.TRAIN_END, test_start: str = split.TEST_START, keys: Sequence[str] = KEYS, bucket: int | None = None, path: str | None = None) -> DataFrame:
    """(tf, keys, earliest, anchor, x, split) of all timeframes, if each passes ``windows_report``; one folder for each under
    ``path``."""
    out = []
    for tf in timeframes:
        raw = windows.extract(matrix, tf, keys=keys, bucket=bucket)
        done = _kept(windows.categorise(windows.normalise(raw), train_end, test_start), path and f"{path}/{tf}")
        require(windows_report(done, raw, train_end, test_start, keys), f"windows of {tf}")
        out.append(done.select(F.lit(tf).alias("tf"), *done.columns))
    return reduce(DataFrame.unionByName, out)
