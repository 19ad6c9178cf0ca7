"""Acquisition of all timeframes with a manifest, validation results beside it, and bundles of artifacts with checksums.

Everything is read and written by Spark, so folders may be in any store that Spark reaches.  Manifests are tables with a row for
each timeframe or file.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.operators import checks
from tidegrid.operators.temporal import KEYS
from tidegrid.schema import BAR, TIMEFRAMES
from tidegrid.sources.tables import checksums, is_current

MANIFEST = "timeframe string, status string, rows long, first string, last string, files map<string,string>"


def known_files(spark: SparkSession, folder: str) -> dict[str, dict[str, str]]:
    """Checksums by timeframe of the last manifest; none if there is no manifest."""
    try:
        rows = spark.read.schema(MANIFEST).json(f"{folder}/manifest").collect()  # one row for each timeframe
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return {}
        raise
    return {r.timeframe: dict(r.files) for r in rows}


def acquire(spark: SparkSession, fetch: Callable[[str], DataFrame], folder: str, start: str, end: str, timeframes: Sequence[str] = TIMEFRAMES, keys: Sequence[str] = KEYS, force: bool = False) -> DataFrame:
    """Fetch, trim, drop repeated bars and write every timeframe, and return the new manifest.

    A timeframe whose files have the checksums of the last manifest is kept without being fetched, unless ``force``.  Of bars
    with one time the smallest stays (by its values), so a second run gives the same table.
    """
    before, out = known_files(spark, folder), []
    for tf in timeframes:
        path = f"{folder}/bars_{tf}"
        status = "kept"
        if force or tf not in before or not is_current(spark, path, before[tf]):
            rows = checks.trim(fetch(tf), start, end).withColumns({c: F.col(c).cast("double") for c in BAR})
            checks.keep_first(rows.withColumn("_seq", F.struct(*BAR)), "_seq", keys).select(*keys, "ts", *BAR).write.mode("overwrite").parquet(path)
            status = "written"
        at = lambda f: F.date_format(f("ts"), "yyyy-MM-dd'T'HH:mm:ss")
        n, first, last = spark.read.parquet(path).agg(F.count("*"), at(F.min), at(F.max)).first()
        files = {r.path.rsplit("/", 1)[-1]: r.sha256 for r in checksums(spark, path).collect()}
        out.append((tf, status, n, first, last, files))
    got = spark.createDataFrame(out, MANIFEST)
    got.coalesce(1).write.mode("overwrite").json(f"{folder}/manifest")
    return got


def append_validation(report: DataFrame, folder: str, run: str) -> DataFrame:
    """Put a report beside the manifest under the name of a run, and return the summary of all runs:
    (run, timeframe, checks, errors, warnings)."""
    report.withColumn("run", F.lit(run)).select("run", "timeframe", "check", "passed", "severity", "metric").write.mode("append").parquet(f"{folder}/validation")
    failed = lambda s: F.count_if(~F.col("passed") & (F.col("severity") == s)).alias(f"{s}s")
    every = report.sparkSession.read.parquet(f"{folder}/validation")
    return every.groupBy("run", "timeframe").agg(F.count("*").alias("checks"), failed("error"), failed("warning"))


def bundle(spark: SparkSession, folder: str, manifest: str) -> DataFrame:
    """(file, length, sha256) of every file under ``folder``, written to ``manifest``, which lies outside it."""
    if manifest.rstrip("/").startswith(folder.rstrip("/") + "/"):
        raise ValueError("a bundle's manifest can't be a file of the bundle")
    _named(checksums(spark, folder), folder).coalesce(1).write.mode("overwrite").json(manifest)
    return spark.read.schema("file string, length long, sha256 string").json(manifest)


def _named(files: DataFrame, folder: str) -> DataFrame:
    """Paths from the bundle's folder on, however the store writes what is before it."""
    tail = folder.rstrip("/").rsplit("/", 1)[-1]
    return files.select(F.substring_index("path", f"/{tail}/", -1).alias("file"), "length", "sha256")


def verify_bundle(spark: SparkSession, folder: str, manifest: str) -> DataFrame:
    """(file, status) of every file of the manifest or the folder: same, changed, missing or new."""
    then = spark.read.schema("file string, length long, sha256 string").json(manifest).select("file", F.col("sha256").alias("then"))
    now = _named(checksums(spark, folder), folder).select("file", F.col("sha256").alias("now"))
    status = F.when(F.col("now").isNull(), "missing").when(F.col("then").isNull(), "new").when(F.col("now") == F.col("then"), "same").otherwise("changed")
    return then.join(now, "file", "full").select("file", status.alias("status"))
