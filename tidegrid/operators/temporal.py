"""Bars, grids, as-of alignment and gap filling, per series.

Series are told apart by key columns; every window is partitioned by them.  For series too long for one task there are halo
buckets: rows are numbered on the gap-free grid by arithmetic, dealt to buckets of consecutive rows, and the last rows of each
bucket are copied to the next, so a frame of fixed length finds all its rows in one bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.schema import BAR, INTERVAL, MASTER_ORDER, OHLC, SECONDS

KEYS = ("symbol",)


def epoch(ts: str | Column) -> Column:
    """Whole seconds since 1970 of a timestamp without zone, in UTC."""
    return F.unix_micros(F.col(ts).cast("timestamp") if isinstance(ts, str) else ts.cast("timestamp")).cast("long") / F.lit(1_000_000)


def bucket_start(ts: str, tf: str) -> Column:
    return F.window(F.col(ts), INTERVAL[tf])["start"]


def bars(ticks: DataFrame, tf: str, keys: Sequence[str] = KEYS, ts: str = "ts", price: str = "value", volume: str = "value", seq: str = "event_id") -> DataFrame:
    """(keys, ts, open, high, low, close, volume): bars labelled by open time.  First and last are by (ts, seq)."""
    at = F.struct(ts, seq)
    return ticks.groupBy(*keys, F.window(F.col(ts), INTERVAL[tf]).alias("_w")).agg(
        F.min_by(price, at).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, at).alias("close"), F.sum(volume).alias("volume")
    ).select(*keys, F.col("_w.start").alias("ts"), *BAR)


def resample(fine: DataFrame, tf: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """Coarser bars from finer ones: first open, highest high, lowest low, last close, summed volume; nulls are skipped, and
    a bar exists wherever a finer one does."""
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("ts")))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("ts")))
    return fine.groupBy(*keys, F.window("ts", INTERVAL[tf]).alias("_w")).agg(
        first("open").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), last("close").alias("close"), F.coalesce(F.sum("volume"), F.lit(0.0)).alias("volume")
    ).select(*keys, F.col("_w.start").alias("ts"), *BAR)


def hour_grid(hourly: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, ts): every hour from the first to the last of the hourly series."""
    ends = hourly.groupBy(*keys).agg(F.min("ts").alias("_a"), F.max("ts").alias("_b"))
    return ends.select(*keys, F.explode(F.sequence("_a", "_b", F.expr("interval 1 hour"))).alias("ts"))


def carry(cols: Sequence[str], keys: Sequence[str], order: str = "ts") -> list[Column]:
    """Each column's last value that is not null, up to the current row."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return [F.last(c, ignorenulls=True).over(w).alias(c) for c in cols]


def asof(grid: DataFrame, source: DataFrame, cols: Sequence[str], keys: Sequence[str] = KEYS, tf: str | None = None, availability: str = "open", max_age: str | None = None) -> DataFrame:
    """Backward as-of join: for each grid row the source's latest row at or before it, null before the first.

    ``availability="open"`` shows a bar from its opening time on, though its close is known only later; ``"close"`` shows it
    once it is complete by the end of the grid hour.  ``max_age`` (an interval) bounds how old a value may be.
    """
    seen = F.col("ts")
    if availability == "close":
        seen = F.col("ts") + F.expr(f"interval {SECONDS[tf] - 3600} seconds")
    rows = source.select(*keys, seen.alias("ts"), *cols, F.col("ts").alias("_at"), F.lit(False).alias("_grid"))
    empty = [F.lit(None).cast(source.schema[c].dataType).alias(c) for c in cols]
    both = rows.unionByName(grid.select(*keys, "ts", *empty, F.lit(None).cast(source.schema["ts"].dataType).alias("_at"), F.lit(True).alias("_grid")))
    w = Window.partitionBy(*keys).orderBy("ts", "_grid").rowsBetween(Window.unboundedPreceding, 0)
    out = both.select(*keys, "ts", "_grid", *[F.last(c, ignorenulls=True).over(w).alias(c) for c in (*cols, "_at")]).filter("_grid")
    if max_age:
        fresh = F.col("_at") >= F.col("ts") - F.expr(f"interval {max_age}")
        out = out.select(*keys, "ts", *[F.when(fresh, F.col(c)).alias(c) for c in cols])
    return out.select(*keys, "ts", *cols)


def fill_gaps(grid: DataFrame, source: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Source on the grid: prices carried forward; volume 0 exactly on hours without a source row."""
    rows = grid.join(source.withColumn("_there", F.lit(True)), [*keys, "ts"], "left")
    volume = F.when(F.col("_there").isNull(), F.lit(0.0)).otherwise(F.col("volume")).alias("volume")
    return rows.select(*keys, "ts", *carry(OHLC, keys), volume)


def master(series: dict[str, DataFrame], keys: Sequence[str] = KEYS, availability: str = "open") -> DataFrame:
    """(keys, ts, 20 columns): all timeframes on the hourly grid.

    The four series are laid side by side by one grouping on (keys, time), and one ordered pass per series carries prices
    forward; no timeframe is joined on its own.
    """
    if gone := set(MASTER_ORDER) - set(series):
        raise ValueError(f"missing timeframes: {sorted(gone)}")
    parts = {"1h": series["1h"], "15m": resample(series["15m"], "1h", keys), "4h": series["4h"], "1d": series["1d"]}
    if availability == "close":
        for tf in ("4h", "1d"):
            parts[tf] = parts[tf].withColumn("ts", F.col("ts") + F.expr(f"interval {SECONDS[tf] - 3600} seconds"))
    one, tagged = None, F.struct(*BAR)
    for tf, df in parts.items():
        rows = df.select(*keys, "ts", *[(tagged if t == tf else F.lit(None).cast(df.select(tagged.alias("s")).schema["s"].dataType)).alias(f"s_{t}") for t in MASTER_ORDER])
        one = rows if one is None else one.unionByName(rows)
    grid = hour_grid(parts["1h"], keys).select(*keys, "ts", F.lit(True).alias("grid"))
    one = one.withColumn("grid", F.lit(None).cast("boolean"))
    one = one.unionByName(grid, allowMissingColumns=True)
    side = one.groupBy(*keys, "ts").agg(F.max("grid").alias("grid"), *[F.first(f"s_{t}", ignorenulls=True).alias(f"s_{t}") for t in MASTER_ORDER])
    cols = []
    w = Window.partitionBy(*keys).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    for tf in MASTER_ORDER:
        for c in BAR:
            value = F.col(f"s_{tf}.{c}")
            if c == "volume" and tf in ("1h", "15m"):
                got = F.when(F.col(f"s_{tf}").isNull(), F.lit(0.0)).otherwise(value)
            else:
                got = F.last(value, ignorenulls=True).over(w)
            cols.append(got.alias(f"{c}_{tf}"))
    return side.select(*keys, "ts", "grid", *cols).filter("grid").drop("grid")


def halo(grid: DataFrame, rows: int, size: int, keys: Sequence[str] = KEYS, step: int = 3600) -> DataFrame:
    """``grid`` with (_bucket, _own): each row in its bucket of ``size`` consecutive grid rows, and the last ``rows`` of a
    bucket once more, not its own, in the next.  The grid must be gap-free with ``step`` seconds between rows, and a bucket at
    least as long as the halo."""
    if size < rows:
        raise ValueError(f"buckets of {size} rows are shorter than the halo of {rows}")
    n = F.floor(epoch("ts") / step)
    b, left = F.floor(n / size), size - n % size
    copies = F.when(left <= rows, F.array(F.struct(b.alias("b"), F.lit(True).alias("own")), F.struct((b + 1).alias("b"), F.lit(False).alias("own")))).otherwise(F.array(F.struct(b.alias("b"), F.lit(True).alias("own"))))
    return grid.withColumn("_c", F.explode(copies)).withColumn("_bucket", F.col("_c.b")).withColumn("_own", F.col("_c.own")).drop("_c")


def carry_in_buckets(df: DataFrame, cols: Sequence[str], size: int, keys: Sequence[str] = KEYS, step: int = 3600) -> DataFrame:
    """Carry forward without an unbounded window over a whole series: inside buckets, with what came before from the buckets'
    last values, a summary of one row a bucket."""
    df = df.withColumn("_bucket", F.floor(epoch("ts") / (step * size)))
    own = Window.partitionBy(*keys, "_bucket").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    ends = df.groupBy(*keys, "_bucket").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("ts"))).alias(c) for c in cols])
    ends = ends.select(*keys, "_bucket", *[F.last(c, ignorenulls=True).over(before).alias(f"_in_{c}") for c in cols])
    rest = [c for c in df.columns if c not in cols]
    inside = df.select(*rest, *[F.last(c, ignorenulls=True).over(own).alias(c) for c in cols])
    out = inside.join(ends, [*keys, "_bucket"], "left")
    return out.select(*[c for c in rest if c != "_bucket"], *[F.coalesce(c, f"_in_{c}").alias(c) for c in cols])
