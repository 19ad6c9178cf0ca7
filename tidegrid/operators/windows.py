"""Sliding windows over the feature matrix, with statistics of the window's own rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.operators.split import TEST_START, TRAIN_END, _at
from tidegrid.operators.temporal import KEYS, halo
from tidegrid.schema import EPS, FEATURES, WINDOW


def window_values(tf: str) -> list[str]:
    return [f"{f}_{tf}" for f in FEATURES]


def extract(matrix: DataFrame, tf: str, size: int = WINDOW, stride: int = 1, keys: Sequence[str] = KEYS, bucket: int | None = None) -> DataFrame:
    """(keys, earliest, anchor, x): every full window of consecutive rows of the whole matrix.

    ``x`` has one array for each channel.  Windows are cut before any split, so the first test windows reach back into the
    training period.  ``bucket`` switches to halo buckets, for a gap-free matrix only.
    """
    part = list(keys)
    rows = matrix.select(*keys, "ts", *window_values(tf))
    if bucket:
        rows = halo(rows, size - 1, bucket, keys)
        part = [*keys, "_bucket"]
    order = Window.partitionBy(*part).orderBy("ts")
    frame = order.rowsBetween(-(size - 1), 0)
    x = F.struct(*[F.collect_list(c).over(frame).alias(f) for c, f in zip(window_values(tf), FEATURES, strict=True)])
    out = rows.withColumn("earliest", F.min("ts").over(frame)).withColumn("n", F.count("*").over(frame)).withColumn("x", x)
    out = out.filter(F.col("n") == size)
    if bucket:
        out = out.filter("_own")
    if stride > 1:
        out = out.withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy("ts")) - 1).filter(F.col("k") % stride == 0)
    return out.select(*keys, "earliest", F.col("ts").alias("anchor"), "x")


def mean_of(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v) / F.size(x)


def let(x: Column, f) -> Column:
    """f(x) with x computed once: a lambda's variable holds its value."""
    return F.element_at(F.transform(F.array(x), f), 1)


def std_of(x: Column, m: Column) -> Column:
    return F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + (v - m) * (v - m)) / F.size(x))


def zscore(x: Column) -> Column:
    """An array by its own mean and population deviation, in doubles."""
    return let(mean_of(x), lambda m: let(std_of(x, m), lambda s: F.transform(x, lambda v: (v - m) / (s + EPS))))


def normalise(windows: DataFrame) -> DataFrame:
    """Each channel of each window by the window's own statistics, as floats, in one Arrow pass."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            x = batch.column(batch.schema.get_field_index("x"))
            done = []
            for f in range(len(FEATURES)):
                a = x.field(f)
                n = len(a)
                v = np.asarray(a.flatten(), float).reshape(n, -1) if n else np.zeros((0, WINDOW))
                z = (v - v.mean(axis=1, keepdims=True)) / (v.std(axis=1, keepdims=True) + EPS)
                flat = pa.array(z.ravel().astype(np.float32))
                done.append(pa.ListArray.from_arrays(np.arange(0, z.size + 1, z.shape[1] or 1, dtype=np.int32), flat))
            cols = [pa.StructArray.from_arrays(done, list(FEATURES)) if name == "x" else batch.column(k) for k, name in enumerate(batch.schema.names)]
            yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names)

    kind = "struct<" + ",".join(f"{f}:array<float>" for f in FEATURES) + ">"
    fields = ", ".join(f"{n} {kind if n == 'x' else t}" for n, t in windows.dtypes)
    return windows.mapInArrow(run, fields)


def categorise(windows: DataFrame, train_end: str = TRAIN_END, test_start: str = TEST_START) -> DataFrame:
    """``windows`` with ``split`` by their anchors."""
    return windows.withColumn("split", F.when(F.col("anchor") <= _at(train_end), "train").when(F.col("anchor") >= _at(test_start), "test")).filter("split is not null")


def generate(matrix: DataFrame, tf: str, train_end: str = TRAIN_END, test_start: str = TEST_START, keys: Sequence[str] = KEYS) -> DataFrame:
    """Extract, normalise and categorise."""
    return categorise(normalise(extract(matrix, tf, keys=keys)), train_end, test_start)


def check_shape(windows: DataFrame, size: int = WINDOW) -> DataFrame:
    """(n, n_bad): windows with a channel of another length."""
    bad = F.lit(False)
    for f in FEATURES:
        bad = bad | (F.size(f"x.{f}") != size)
    return windows.agg(F.count("*").alias("n"), F.count_if(bad).alias("n_bad"))


def check_periods(windows: DataFrame, train_end: str = TRAIN_END, test_start: str = TEST_START) -> DataFrame:
    """(train_last, test_first, passed): anchors stay on their side; an empty side fails."""
    got = windows.agg(F.max(F.when(F.col("split") == "train", F.col("anchor"))).alias("train_last"), F.min(F.when(F.col("split") == "test", F.col("anchor"))).alias("test_first"))
    return got.withColumn("passed", F.coalesce((F.col("train_last") <= _at(train_end)) & (F.col("test_first") >= _at(test_start)), F.lit(False)))


def boundary_overlap(windows: DataFrame, test_start: str = TEST_START, size: int = WINDOW, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, n_overlap, passed): test windows that begin before the test period; size - 1 at most for one series."""
    hit = (F.col("split") == "test") & (F.col("earliest") < _at(test_start))
    return windows.groupBy(*keys).agg(F.count_if(hit).alias("n_overlap")).withColumn("passed", F.col("n_overlap") <= size - 1)


def without_overlap(windows: DataFrame, test_start: str = TEST_START) -> DataFrame:
    """Test windows that begin inside the test period, and all training windows."""
    return windows.filter((F.col("split") != "test") | (F.col("earliest") >= _at(test_start)))


def check_local(raw: DataFrame, done: DataFrame, keys: Sequence[str] = KEYS, rtol: float = 1e-5, atol: float = 1e-6) -> DataFrame:
    """(n, n_off): values of ``done`` that differ from statistics of each window's own rows, made anew by exploding."""
    parts = F.explode(F.array(*[F.struct(F.lit(f).alias("channel"), F.col(f"x.{f}").alias("v")) for f in FEATURES]))
    cell = lambda df, name: df.select(*keys, "anchor", parts.alias("p")).select(*keys, "anchor", "p.channel", F.posexplode("p.v").alias("i", name))
    one = cell(raw, "v")
    stats = one.groupBy(*keys, "anchor", "channel").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    both = one.join(stats, [*keys, "anchor", "channel"]).join(cell(done, "z"), [*keys, "anchor", "channel", "i"])
    want = (F.col("v") - F.col("m")) / (F.col("s") + EPS)
    off = (F.abs(F.col("z") - want) > atol + rtol * F.abs(want)) & (F.col("s") > 1e-6 * (F.abs(F.col("m")) + 1e-9))
    return both.agg(F.count("*").alias("n"), F.count_if(off).alias("n_off"))
