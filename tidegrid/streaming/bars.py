"""Bars from a stream of ticks, with a watermark for late ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.operators.temporal import KEYS
from tidegrid.schema import BAR, INTERVAL


def stream_bars(ticks: DataFrame, tf: str, late: str = "10 minutes", keys: Sequence[str] = KEYS, ts: str = "ts", price: str = "value", volume: str = "value", seq: str = "event_id") -> DataFrame:
    """(keys, ts, open, high, low, close, volume) of a streaming DataFrame: the batch operator's grouping behind a watermark.

    A bar is final once the watermark has passed its end; ticks that are later than ``late`` are left out.
    """
    at = F.struct(ts, seq)
    stamped = ticks.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return stamped.groupBy(*keys, F.window(F.col(ts), INTERVAL[tf]).alias("_w")).agg(
        F.min_by(price, at).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, at).alias("close"), F.sum(volume).alias("volume")
    ).select(*keys, F.col("_w.start").alias("ts"), *BAR)
