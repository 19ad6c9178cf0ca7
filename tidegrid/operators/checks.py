"""Validation of bar series: one aggregate pass over one ordered pass, as a report with a row for each check."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.operators.temporal import KEYS, epoch
from tidegrid.schema import BAR, EXPECTED_ROWS, OHLC, SECONDS

GAP_LIMIT, SINGLE_GAP_LIMIT, TOLERANCE = 0.05, 2.0, 0.05
WARNINGS = ("no_excessive_single_gap",)


class ValidationError(ValueError):
    """A check of severity error failed."""


def columns_present(df: DataFrame, required: Sequence[str] = ("ts", *BAR)) -> list[str]:
    """Required columns that are missing."""
    return [c for c in required if c not in df.columns]


def _measures(df: DataFrame, tf: str, keys: Sequence[str], seq: str | None) -> DataFrame:
    dur = SECONDS[tf]
    by_time = Window.partitionBy(*keys).orderBy("ts")
    stored = Window.partitionBy(*keys).orderBy(seq) if seq else by_time
    units = (epoch("ts") - F.lag(epoch("ts")).over(by_time)) / dur
    rows = df.withColumn("_u", units).withColumn("_back", F.lag("ts").over(stored) > F.col("ts"))
    o, h, l, c = (F.col(x) for x in OHLC)
    bad_bar = (h < o) | (h < c) | (l > o) | (l > c) | (h < l)
    ordered = ~(F.isnan(o) | F.isnan(h) | F.isnan(l) | F.isnan(c))  # NaN compares false
    above = lambda x: F.coalesce((x > 0) & ~F.isnan(x), F.lit(False))
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.count_if("_back").alias("n_back"),
        F.countDistinct("ts").alias("n_distinct"),
        F.count_if(bad_bar & ordered).alias("n_bad_bar"),
        F.count_if(~(above(o) & above(h) & above(l) & above(c))).alias("n_not_positive"),
        F.count_if(~F.coalesce((F.col("volume") >= 0) & ~F.isnan("volume"), F.lit(False))).alias("n_negative_volume"),
        *[F.count_if(F.col(x).isNull() | F.isnan(x) | (F.abs(F.col(x)) == float("inf"))).alias(f"n_bad_{x}") for x in BAR],
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        F.coalesce(F.sum(F.greatest(F.rint("_u") - 1, F.lit(0.0))), F.lit(0.0)).alias("n_missing"),
        F.coalesce(F.max("_u"), F.lit(0.0)).alias("largest_gap"),
    )


def report(df: DataFrame, tf: str, start: str | None = None, end: str | None = None, keys: Sequence[str] = KEYS, seq: str | None = None) -> DataFrame:
    """(keys, timeframe, check, passed, severity, metric): every check of one timeframe.

    Missing columns are the only row then.  ``start`` and ``end`` are days to cover; without them coverage is not checked.
    ``seq`` is the storage order that monotonicity is about (time itself if not given).
    """
    if tf not in SECONDS:
        raise ValueError(f"unknown timeframe {tf}")
    if gone := columns_present(df):
        row = [(tf, "columns_present", False, "error", float(len(gone)))]
        return df.sparkSession.createDataFrame(row, "timeframe string, check string, passed boolean, severity string, metric double")
    m = _measures(df, tf, keys, seq)
    bad = sum((F.col(f"n_bad_{x}") for x in BAR), F.lit(0))
    gap = F.when(F.col("n") <= 1, F.lit(0.0)).otherwise(F.col("n_missing") / (F.col("n") + F.col("n_missing")))
    checks = {
        "columns_present": (F.lit(True), F.lit(0.0)),
        "monotonicity": (F.col("n_back") == 0, F.col("n_back")),
        "no_duplicate_timestamps": (F.col("n_distinct") == F.col("n"), F.col("n") - F.col("n_distinct")),
        "ohlc_integrity": (F.col("n_bad_bar") == 0, F.col("n_bad_bar")),
        "positive_prices": (F.col("n_not_positive") == 0, F.col("n_not_positive")),
        "non_negative_volume": (F.col("n_negative_volume") == 0, F.col("n_negative_volume")),
        "no_nan_or_inf": (bad == 0, bad),
        "timezone_utc": (F.lit(utc(df)), F.lit(0.0)),
        "gap_ratio": (gap <= GAP_LIMIT, gap),
        "no_excessive_single_gap": (F.col("largest_gap") <= SINGLE_GAP_LIMIT, F.col("largest_gap")),
    }
    if start and end:
        covers = (F.col("first_ts") <= F.lit(start).cast("timestamp_ntz")) & (F.col("last_ts") >= F.lit(end).cast("timestamp_ntz") + F.expr(f"interval {86400 - SECONDS[tf]} seconds"))
        checks["date_range_coverage"] = (covers, F.lit(0.0))
    rows = [F.struct(F.lit(k).alias("check"), p.alias("passed"), F.lit("warning" if k in WARNINGS else "error").alias("severity"), x.cast("double").alias("metric")) for k, (p, x) in checks.items()]
    return m.select(*keys, F.lit(tf).alias("timeframe"), F.explode(F.array(*rows)).alias("r")).select(*keys, "timeframe", "r.*")


def report_all(series: dict[str, DataFrame], **how) -> DataFrame:
    """The reports of all timeframes, one below the other."""
    out = None
    for tf, df in series.items():
        one = report(df, tf, **how)
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def enforce(found: DataFrame) -> DataFrame:
    """The report itself; an error that lists failures of severity error, if there are any."""
    failed = found.filter(~F.col("passed") & (F.col("severity") == "error")).select("timeframe", "check").distinct().orderBy("timeframe", "check").limit(50).collect()
    if failed:
        raise ValidationError("; ".join(f"{r.timeframe}: {r.check}" for r in failed))
    return found


def utc(df: DataFrame) -> bool:
    """Whether times are UTC: without zone, or with zone in a UTC session."""
    kind = dict(df.dtypes).get("ts")
    return kind == "timestamp_ntz" or kind == "timestamp" and df.sparkSession.conf.get("spark.sql.session.timeZone") in ("UTC", "Etc/UTC")


def row_count_tolerance(df: DataFrame, tf: str, expected: dict[str, int] | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, timeframe, n, expected, within): whether counts are within 5 % of the expected."""
    want = (expected or EXPECTED_ROWS)[tf]
    counts = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return counts.select(*keys, F.lit(tf).alias("timeframe"), "n", F.lit(want).alias("expected"), F.col("n").between(want * (1 - TOLERANCE), want * (1 + TOLERANCE)).alias("within"))


def trim(df: DataFrame, start: str, end: str) -> DataFrame:
    """Rows from the start of one day to the last second of another, both included; the bounds reach the scan."""
    at = lambda x: F.lit(x).cast("timestamp_ntz")
    return df.filter((F.col("ts") >= at(f"{start} 00:00:00")) & (F.col("ts") <= at(f"{end} 23:59:59")))


def keep_first(df: DataFrame, seq: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """One row for each (keys, ts): that of the smallest ``seq``."""
    rest = [c for c in df.columns if c not in (*keys, "ts")]
    return df.groupBy(*keys, "ts").agg(F.min_by(F.struct(*rest), seq).alias("_r")).select(*keys, "ts", *[F.col(f"_r.{c}").alias(c) for c in rest])


def manifest(series: dict[str, DataFrame], symbol: str, exchange: str) -> DataFrame:
    """One row: a JSON manifest with rows, start and end of each timeframe."""
    one = None
    for tf, df in series.items():
        row = df.agg(F.lit(tf).alias("timeframe"), F.count("*").alias("rows"), F.date_format(F.min("ts"), "yyyy-MM-dd'T'HH:mm:ss").alias("start"), F.date_format(F.max("ts"), "yyyy-MM-dd'T'HH:mm:ss").alias("end"))
        one = row if one is None else one.unionByName(row)
    entries = F.map_from_entries(F.array_sort(F.collect_list(F.struct("timeframe", F.struct("rows", "start", "end")))))
    return one.agg(F.to_json(F.struct(F.lit(symbol).alias("symbol"), F.lit(exchange).alias("exchange"), entries.alias("timeframes"))).alias("manifest"))


def grid_complete(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, n, n_breaks, complete): whether every step is one hour."""
    step = epoch("ts") - F.lag(epoch("ts")).over(Window.partitionBy(*keys).orderBy("ts"))
    got = df.withColumn("_s", step).groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(F.col("_s") != 3600).alias("n_breaks"))
    return got.withColumn("complete", F.col("n_breaks") == 0)
