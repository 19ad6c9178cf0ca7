"""Training and use of the branch encoders: one task for each (timeframe, seed) of different windows."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.functions import encoder
from tidegrid.schema import FEATURES, SEEDS
from tidegrid.sources.tables import pending

RUN = "tf string, seed int, status string, error string, epochs int, best_epoch int, best_loss double, losses array<double>, stopped boolean, weights binary"

#: Partitions that runs are dealt to: a number that Spark doesn't lower, for runs are few rows and long work.
TASKS = 512

#: Parts of a timeframe's windows that are encoded apart: a task reads the weights of few timeframes, and no series waits for one task.
SLICES = 16


def tensor(x: pd.Series) -> np.ndarray:
    """[rows, steps, channels] of a column of structs of arrays."""
    return np.stack([np.stack([np.asarray(r[f], float) for f in FEATURES], axis=1) for r in x]) if len(x) else np.zeros((0, 48, len(FEATURES)))


def training_sets(windows: DataFrame, most_rows: int, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, tf, digest, shape, data, error): each timeframe's windows of a key by their anchors, in the single precision of training, as one
    cell.  Equal digests mean equal windows; an error has a digest of its own."""

    def gather(key, pdf: pd.DataFrame) -> pd.DataFrame:
        try:
            if len(pdf) > most_rows:
                raise ValueError(f"{len(pdf)} windows; a run takes {most_rows}")
            x = np.ascontiguousarray(tensor(pdf.sort_values("anchor").x), np.float32)
            data = x.tobytes()
            row = (*key, hashlib.blake2b(data, digest_size=16, key=repr(x.shape).encode()).hexdigest(), list(x.shape), data, None)
        except Exception as e:  # the status of this timeframe's runs; the others go on
            row = (*key, f"failed {key[-1]}", None, None, str(e))
        return pd.DataFrame([row], columns=[*keys, "tf", "digest", "shape", "data", "error"])

    kinds = "".join(f"{k} {dict(windows.dtypes)[k]}, " for k in keys)
    return windows.select(*keys, "tf", "anchor", "x").groupBy(*keys, "tf").applyInPandas(gather, kinds + "tf string, digest string, shape array<int>, data binary, error string")


def train_branches(windows: DataFrame, seeds: Sequence[int] = SEEDS, done: DataFrame | None = None, most_rows: int = 200_000, keys: Sequence[str] = (), **settings) -> DataFrame:
    """The runs table: weights and history of each (keys, tf, seed), or its error; runs in ``done`` are skipped.

    ``windows`` has (keys, tf, anchor, x).  A task trains on one timeframe's windows of one key, so these are bounded by ``most_rows``; a run
    with more fails as such, and the others go on.  A run depends on its windows, seed and settings alone, so timeframes of a key with
    the same windows to the last bit (15m folded to hours is 1h, if both come from the same ticks) are trained once and get a row each.
    """
    tasks = training_sets(windows, most_rows, keys).withColumn("seed", F.explode(F.array(*[F.lit(int(s)) for s in seeds])))
    if done is not None:
        tasks = pending(tasks, done, (*keys, "tf", "seed"))
    by = [*keys, "digest", "seed"]
    tasks = tasks.repartition(TASKS, *by).groupBy(*by).agg(F.sort_array(F.collect_list("tf")).alias("tfs"), *[F.first(c).alias(c) for c in ("shape", "data", "error")])

    def run(batches):
        for pdf in batches:
            for t in pdf.itertuples(index=False):
                try:
                    if t.data is None:
                        raise ValueError(t.error)
                    p, h = encoder.train(np.frombuffer(t.data, np.float32).reshape([int(n) for n in t.shape]), seed=int(t.seed), **settings)
                    got = ("done", None, len(h.losses), h.best_epoch, h.best_loss, h.losses, h.stopped, encoder.to_bytes(p))
                except Exception as e:  # the run's own status; the other runs go on
                    got = ("failed", str(e), 0, -1, None, [], False, None)
                yield pd.DataFrame([(*t[: len(keys)], tf, t.seed, *got) for tf in t.tfs], columns=[*keys, *(c.split()[0] for c in RUN.split(", "))])

    kinds = "".join(f"{k} {dict(windows.dtypes)[k]}, " for k in keys)
    return tasks.mapInPandas(run, kinds + RUN)


def usable(runs: DataFrame) -> DataFrame:
    """Completed runs whose weights can be read."""

    @F.pandas_udf("boolean")
    def reads(w: pd.Series) -> pd.Series:
        def fine(b):
            try:
                return {"in.w", "in.b"} <= encoder.from_bytes(b).keys()
            except Exception:
                return False

        return w.map(fine)

    return runs.filter((F.col("status") == "done") & F.col("weights").isNotNull()).filter(reads("weights"))


def encode_windows(windows: DataFrame, runs: DataFrame, keep: Sequence[str] = ("anchor", "split"), pooling: str = "full_series", keys: Sequence[str] = ()) -> DataFrame:
    """(keys, tf, seed, keep, e): each window by every completed run of its key and timeframe, once, for all conditions to share."""
    models = {(tuple(r[k] for k in (*keys, "tf")), r.seed): r.weights for r in usable(runs).select(*keys, "tf", "seed", "weights").collect()}  # about 1 MB a run
    sent = windows.sparkSession.sparkContext.broadcast(models)

    def run(batches):
        made = {}
        for batch in batches:
            pdf = batch.to_pandas()
            for tf, own in pdf.groupby([*keys, "tf"]):
                x = tensor(own.x)
                for (t, seed), w in sent.value.items():
                    if t != tf:
                        continue
                    if (t, seed) not in made:
                        made[t, seed] = encoder.from_bytes(w)
                    e = encoder.encode(made[t, seed], x, pooling, batch=32)
                    out = own[[*keys, "tf", *keep]].assign(seed=np.int32(seed), e=list(e))
                    yield pa.RecordBatch.from_pandas(out[[*keys, "tf", "seed", *keep, "e"]], schema=schema, preserve_index=False)

    kinds = dict(windows.dtypes)
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    ddl = "".join(f"{c} {kinds[c]}, " for c in keys) + "tf string, seed int, " + "".join(f"{c} {kinds[c]}, " for c in keep) + "e array<float>"
    schema = to_arrow_schema(StructType.fromDDL(ddl))
    dealt = windows.repartition(TASKS, *keys, "tf", F.pmod(F.xxhash64("anchor"), F.lit(SLICES)))
    return dealt.select(*keys, "tf", *keep, "x").mapInArrow(run, ddl)
