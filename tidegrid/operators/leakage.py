"""Detectors of look-ahead, each formulated apart from the operator it watches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.operators.temporal import KEYS
from tidegrid.schema import SECONDS

RTOL, ATOL = 1e-5, 1e-8


def lookahead(table: DataFrame, source: DataFrame, tf: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, ts, assigned_open_time, passed, sampled) of every master row.

    The open shown must be that of the latest bar at or before the row, and null if there is none.  The bar is found by its
    slot: bars are labelled by open time, so a row's candidates are the bars of its own slot, or else the latest earlier one,
    taken from a running maximum over bar times.  ``sampled`` marks the sixth row of each calendar year, or the last if the
    year has fewer.
    """
    if tf not in ("4h", "1d"):
        raise ValueError("look-ahead is checked for 4h and 1d")
    rows = table.select(*keys, "ts", F.col(f"open_{tf}").alias("shown"))
    events = rows.select(*keys, "ts", "shown", F.lit(1).alias("is_row")).unionByName(
        source.select(*keys, "ts", F.col("open").alias("shown"), F.lit(0).alias("is_row"))
    )
    upto = Window.partitionBy(*keys).orderBy("ts", "is_row").rowsBetween(Window.unboundedPreceding, 0)
    latest = F.max(F.when(F.col("is_row") == 0, F.struct("ts", "shown"))).over(upto)
    got = events.withColumn("bar", latest).filter("is_row = 1")
    close = F.abs(F.col("shown") - F.col("bar.shown")) <= ATOL + RTOL * F.abs(F.col("bar.shown"))
    passed = F.when(F.col("bar").isNull() | F.col("bar.shown").isNull(), F.col("shown").isNull()).otherwise(F.coalesce(close, F.lit(False)))
    year = Window.partitionBy(*keys, F.year("ts"))
    place = F.row_number().over(year.orderBy("ts")) == F.least(F.lit(6), F.count("*").over(year))
    return got.select(*keys, "ts", F.col("bar.ts").alias("assigned_open_time"), passed.alias("passed"), place.alias("sampled"))


def unfinished_bars(table: DataFrame, source: DataFrame, tf: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, n, n_unfinished): rows that show the close of a bar that is still open when the row's hour ends."""
    bar = source.select(*keys, F.col("ts").alias("_open"), F.col("close").alias("_close"))
    slot = F.window("ts", f"{SECONDS[tf]} seconds")["start"]
    rows = table.withColumn("_open", slot).join(bar, [*keys, "_open"], "left")
    still = F.col("_open") + F.expr(f"interval {SECONDS[tf]} seconds") > F.col("ts") + F.expr("interval 1 hour")
    hit = still & (F.col(f"close_{tf}") == F.col("_close"))
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(hit).alias("n_unfinished"))
