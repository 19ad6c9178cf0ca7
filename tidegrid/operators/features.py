"""The seven bar features of each timeframe, as columns over the master table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.operators.temporal import KEYS, halo
from tidegrid.schema import EPS, FEATURE_COLUMNS, FEATURES, ROLLING, TIMEFRAMES


def ratio(a: Column, b: Column) -> Column:
    """a / b; null where b is 0, which the zero_denominators check counts."""
    return F.try_divide(a, b)


def feature_columns(tf: str, order, rolling: int = ROLLING) -> list[Column]:
    """The features of one timeframe; ``order`` is the window of the series in time order."""
    o, h, l, c, v = (F.col(f"{x}_{tf}") for x in ("open", "high", "low", "close", "volume"))
    before = F.lag(c, 1).over(order)
    frame = order.rowsBetween(-(rolling - 1), 0)
    enough = F.count(v).over(frame) == rolling
    same = F.max(v).over(frame) == F.min(v).over(frame)  # else rounding of the mean shows as a deviation
    z = F.when(same, F.lit(0.0)).otherwise((v - F.avg(v).over(frame)) / (F.stddev_samp(v).over(frame) + EPS))
    got = [ratio(o - before, before), ratio(h - o, o), ratio(l - o, o), ratio(c - o, o), F.when(enough, z), ratio(h - l, o), F.abs(c - o) / (h - l + EPS)]
    return [x.alias(f"{name}_{tf}") for name, x in zip(FEATURES, got, strict=True)]


def features(table: DataFrame, timeframes: Sequence[str] = TIMEFRAMES, keys: Sequence[str] = KEYS, bucket: int | None = None) -> DataFrame:
    """(keys, ts, 7 features for each timeframe) over all rows of the master table.

    ``bucket`` switches to halo buckets of so many rows, for series too long for one task; results are the same.
    """
    if bucket:
        table = halo(table, ROLLING - 1, bucket, keys)
        order = Window.partitionBy(*keys, "_bucket").orderBy("ts")
        out = table.select(*keys, "ts", "_own", *[c for tf in timeframes for c in feature_columns(tf, order)])
        return out.filter("_own").drop("_own")
    order = Window.partitionBy(*keys).orderBy("ts")
    return table.select(*keys, "ts", *[c for tf in timeframes for c in feature_columns(tf, order)])


def complete(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Rows without a null or NaN feature; infinite values stay, for the integrity check to find."""
    return df.dropna(how="any", subset=list(cols or [c for c in FEATURE_COLUMNS if c in df.columns]))


def integrity(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, n_null, n_infinite), one row for each column."""
    aggs = []
    for c in cols:
        aggs += [F.count_if(F.col(c).isNull() | F.isnan(c)).alias(f"n_{c}"), F.count_if(F.abs(F.col(c)) == float("inf")).alias(f"i_{c}")]
    pairs = ", ".join(f"'{c}', n_{c}, i_{c}" for c in cols)
    return df.agg(*aggs).selectExpr(f"stack({len(cols)}, {pairs}) as (column, n_null, n_infinite)")


def zero_denominators(table: DataFrame, timeframes: Sequence[str] = TIMEFRAMES, keys: Sequence[str] = KEYS) -> DataFrame:
    """(timeframe, n): rows whose open is 0, for which ratios are null."""
    aggs = [F.count_if(F.col(f"open_{tf}") == 0).alias(f"z_{tf}") for tf in timeframes]
    pairs = ", ".join(f"'{tf}', z_{tf}" for tf in timeframes)
    return table.agg(*aggs).selectExpr(f"stack({len(timeframes)}, {pairs}) as (timeframe, n)")
