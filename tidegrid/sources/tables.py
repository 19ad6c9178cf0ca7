"""Bar series from tables, files and paged requests; sinks, checksums and run registries."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidegrid.operators.temporal import bars
from tidegrid.schema import SECONDS, TIMEFRAMES


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as ticks, a series for each event type."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("symbol"), "ts", "value", "event_id")


def series(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Bars of all timeframes."""
    rows = ticks(spark, sf_dir)
    return {tf: bars(rows, tf) for tf in TIMEFRAMES}


def read_bars(spark: SparkSession, path: str) -> DataFrame:
    """Bars of a Parquet table, prices and volumes as doubles, NaN as null."""
    df = spark.read.parquet(path)
    for c in ("open", "high", "low", "close", "volume"):
        x = F.col(c).cast("double")
        df = df.withColumn(c, F.when(~F.isnan(x), x))
    return df


def write_bars(df: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """A report as one CSV file with a header; for tables of metrics, not of rows."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of every file under a path."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def is_current(spark: SparkSession, path: str, known: dict[str, str]) -> bool:
    """Whether the files of a path have the checksums of a manifest {file name: sha256}; False if the path isn't there."""
    try:
        rows = checksums(spark, path).collect()
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return False
        raise
    return bool(rows) and {r.path.rsplit("/", 1)[-1]: r.sha256 for r in rows} == known


def pending(tasks: DataFrame, done: DataFrame, on: Sequence[str]) -> DataFrame:
    """Tasks without a completed run."""
    return tasks.join(done.filter(F.col("status") == "done").select(*on).distinct(), list(on), "left_anti")


class RateLimited(Exception):
    """The server asks to wait; worth another attempt."""


def with_retries(call: Callable, attempts: int = 5, wait: float = 2.0, factor: float = 2.0, sleep: Callable = time.sleep):
    """Call until it works; only rate limits and network errors are tried again, everything else fails at once."""
    for k in range(attempts):
        try:
            return call()
        except (RateLimited, ConnectionError, TimeoutError):
            if k == attempts - 1:
                raise
            sleep(wait * factor**k)


def pages(fetch: Callable[[int, int], list], start: int, end: int, limit: int = 1000, **retry) -> Iterator[list]:
    """Rows [ms, open, high, low, close, volume] from ``fetch(since, limit)``: on from the last time plus 1 ms, until a page is
    empty, short or brings nothing new; rows after ``end`` are left out."""
    since = start
    while since <= end:
        page = with_retries(lambda since=since: fetch(since, limit), **retry)
        if not page or page[-1][0] < since:
            return
        yield from (r for r in page if start <= r[0] <= end)
        if len(page) < limit:
            return
        since = page[-1][0] + 1


class PagedBars(DataSource):
    """``spark.read.format("paged_bars")``: paged requests to a server of bars, one partition for each range of time.

    Options: ``fetcher`` ("module:function", called with timeframe, since, limit), ``timeframes``, ``start``, ``end`` (ms),
    ``ranges`` (partitions for each timeframe).
    """

    @classmethod
    def name(cls) -> str:
        return "paged_bars"

    def schema(self) -> str:
        return "timeframe string, ts timestamp, open double, high double, low double, close double, volume double"

    def reader(self, schema) -> DataSourceReader:
        return _PagedReader(dict(self.options))


class _Range(InputPartition):
    def __init__(self, tf: str, start: int, end: int):
        self.tf, self.start, self.end = tf, start, end


class _PagedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[_Range]:
        start, end, n = int(self.options["start"]), int(self.options["end"]), int(self.options.get("ranges", 4))
        out = []
        for tf in json.loads(self.options["timeframes"]):
            step = SECONDS[tf] * 1000
            per = -(-((end - start) // step + 1) // n) * step
            out += [_Range(tf, a, min(a + per - 1, end)) for a in range(start, end + 1, per)]
        return out

    def read(self, partition: _Range):
        import importlib
        from datetime import UTC, datetime

        module, _, name = self.options["fetcher"].partition(":")
        fetch = getattr(importlib.import_module(module), name)
        for ms, *values in pages(lambda since, limit: fetch(partition.tf, since, limit), partition.start, partition.end):
            yield (partition.tf, datetime.fromtimestamp(ms / 1000, UTC), *map(float, values))
