"""Late fusion of branch embeddings: concatenation from fine to coarse and a frozen random projection."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.schema import CONDITIONS, ordered_timeframes

BRANCH_DIM, FUSED_DIM = 64, 256


class FusionError(ValueError):
    """Branches don't fit together."""


def projection(width: int, out: int = FUSED_DIM, seed: int = 42) -> np.ndarray:
    """A seeded normal matrix [out, width] with rows of length 1."""
    p = np.random.Generator(np.random.PCG64(seed)).standard_normal((out, width))
    return (p / np.linalg.norm(p, axis=1, keepdims=True)).astype(np.float32)


def concatenate(branches: DataFrame, active: Sequence[str], on: Sequence[str] = ("seed", "anchor"), dim: int = BRANCH_DIM) -> DataFrame:
    """(on, e): the active branches' vectors side by side; ``branches`` is long, (on, tf, e).

    One grouping brings the branches of a row together.  A row without all branches, or a vector of another length, is an error
    that ``check_branches`` reports; here such rows have a null vector.
    """
    order = ordered_timeframes(active)
    of = lambda tf: F.first(F.when(F.col("tf") == tf, F.col("e")), ignorenulls=True)
    wide = branches.filter(F.col("tf").isin(order)).groupBy(*on).agg(*[of(tf).alias(f"e_{tf}") for tf in order])
    fine = F.lit(True)
    for tf in order:
        fine = fine & (F.coalesce(F.size(f"e_{tf}"), F.lit(-1)) == dim)
    return wide.select(*on, F.when(fine, F.concat(*[F.col(f"e_{tf}") for tf in order])).alias("e"))


def check_branches(branches: DataFrame, active: Sequence[str], on: Sequence[str] = ("seed", "anchor"), dim: int = BRANCH_DIM) -> None:
    """An error if any row lacks a branch or has a vector of another length."""
    bad = concatenate(branches, active, on, dim).agg(F.count_if(F.col("e").isNull()).alias("n")).first().n
    if bad:
        raise FusionError(f"{bad} rows without all of {ordered_timeframes(active)} at {dim} numbers")


def fuse(rows: DataFrame, width: int, seed: int = 42, out: int = FUSED_DIM) -> DataFrame:
    """``rows`` (with e of ``width`` numbers) and ``fused`` = e P'; P is at most 256 by 256 and goes to the tasks with the code."""
    p = projection(width, out, seed).T

    def run(batches):
        for batch in batches:
            k = batch.schema.get_field_index("e")
            x = np.asarray(batch.column(k).flatten(), np.float32).reshape(-1, width)
            y = pa.array((x @ p).ravel())
            fused = pa.ListArray.from_arrays(np.arange(0, len(y) + 1, out, dtype=np.int32), y)
            yield pa.RecordBatch.from_arrays([*batch.columns, fused], names=[*batch.schema.names, "fused"])

    rows = rows.filter(F.col("e").isNotNull()).withColumn("e", F.col("e").cast("array<float>"))
    return rows.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in rows.dtypes) + ", fused array<float>")


def fuse_condition(branches: DataFrame, condition: str, seed: int = 42, on: Sequence[str] = ("seed", "anchor"), dim: int = BRANCH_DIM) -> DataFrame:
    """Fused vectors of one condition from branches that are encoded once and shared by all conditions."""
    active = CONDITIONS[condition]
    return fuse(concatenate(branches, active, on, dim), dim * len(active), seed).withColumn("condition", F.lit(condition))
