"""Helpers shared by the corpus operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the near-duplicate contracts: runs of anything but ASCII white space.
WORD_SPACE = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table by Spark's own reader, so any store that Spark can open will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``.  Where none is named, one process (tests) gets a temporary one; on a
    cluster that is an error, as executors would write to disks of their own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tidegrid-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage: reliable checkpoint in the shared folder, so lost executors lose nothing."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage of an iterate: a table written to the shared folder and read again.

    A checkpoint keeps the plan's size estimate, which for a join is a product; in a loop that squares the estimate in each
    round, until the driver is busy with numbers of millions of digits.  A table has its files' size.
    """
    path = f"{checkpoint_dir(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Keys that hold more than this part of all rows are joined by broadcast; there are fewer of them than parts.
HOT_PARTS = 2000


def join_hot(rows: DataFrame, groups: DataFrame, keys: list[str], size_col: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``groups``, which has one row for each key and says how many of the ``total`` rows it holds.

    A key with more than a two-thousandth of the rows meets them where they are; all other keys are dealt out by a shuffle, in
    which none can fill a task.  Both sides are read more than once, so they should be tables.
    """
    key = F.xxhash64(*keys)
    hot = [r[0] for r in groups.filter(F.col(size_col) > total // HOT_PARTS).select(key).collect()] if total >= HOT_PARTS else []  # fewer than HOT_PARTS numbers
    if not hot:
        return rows.join(groups, keys)
    there = key.isin(hot)
    return rows.filter(there).join(F.broadcast(groups.filter(there)), keys).unionByName(rows.filter(~there).join(groups.filter(~there), keys))


def lower_ascii(col):
    """Lower-case A-Z only; other letters keep their case."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: For bytes.translate: lower-cases A-Z and leaves every other byte.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

_held: dict = {}


def slot(key, make: Callable):
    """What a Python worker keeps between tasks: one object at a time, so that the next operator's takes the last one's place."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def release() -> None:
    """Called by operators that keep nothing: what the last operator kept in this worker goes."""
    _held.clear()
