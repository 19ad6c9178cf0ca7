"""The two baselines beside the encoders: hidden Markov models and K-Means on principal axes, for every seed.

A fitted model is a small mapping of plain numbers, so it's saved as JSON by Spark's own writer and read again as it was.
Labels come from expressions, not from the fitting library: a row's label needs the model and the row only.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.functions import mixture
from tidegrid.operators import clustering
from tidegrid.schema import SEEDS

KS, AXES, STATES = (2, 3, 4, 5, 6), 10, (2, 3, 4)


def principal_axes(train: DataFrame, most: int = AXES) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """(means, axes as rows, shares of the variance), as many axes as the vectors are wide at most."""
    kept = train.select(array_to_vector(F.col("v").cast("array<double>")).alias("x")).persist()
    put = clustering.gathered(kept)
    centre = StandardScaler(inputCol="x", outputCol="c", withMean=True, withStd=False).fit(put)
    width = len(centre.mean)
    pca = PCA(k=min(most, width), inputCol="c", outputCol="p").fit(centre.transform(put))
    kept.unpersist()
    return centre.mean.toArray(), pca.pc.toArray().T, pca.explainedVariance.toArray().tolist()


def on_axes(rows: DataFrame, mean: Sequence[float], axes: Sequence[Sequence[float]]) -> DataFrame:
    """``rows`` with ``v`` on the axes."""
    away = F.zip_with("v", F.lit([float(x) for x in mean]), lambda a, b: a - b)
    spot = [F.aggregate(F.zip_with(away, F.lit([float(x) for x in axis]), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x) for axis in axes]
    return rows.withColumn("v", F.array(*spot))


def fit_kmeans_pca(train: DataFrame, seed: int = 42, ks: Sequence[int] = KS, most: int = AXES, restarts: int = 10, found: tuple | None = None) -> dict:
    """Principal axes of the training rows (id, v), or what is ``found`` of them, then the k of the best exact silhouette there."""
    mean, axes, shares = found or principal_axes(train, most)
    kept = on_axes(train, mean, axes).persist()
    put = clustering.gathered(kept)
    k, centres, silhouettes = clustering.select_k(put, ks, seed, restarts)
    kept.unpersist()
    return {"k": int(k), "mean": mean.tolist(), "axes": axes.tolist(), "shares": shares, "centres": centres.tolist(), "silhouettes": {str(n): float(s) for n, s in silhouettes.items()}}


def predict_kmeans_pca(rows: DataFrame, model: dict) -> DataFrame:
    """``rows`` with ``label``: the nearest centre on the model's axes; an error if it has none."""
    if not model.get("centres"):
        raise ValueError("the model isn't fitted")
    return clustering.nearest_centre(on_axes(rows, model["mean"], model["axes"]), np.array(model["centres"]))


def hmm_labels(train: DataFrame, test: DataFrame, seeds: Sequence[int] = SEEDS, states: Sequence[int] = STATES, keys: Sequence[str] = (), order: str = "ts") -> DataFrame:
    """(keys, seed, states, bic, split, ts, label): of each series and seed the model of lowest BIC, and the best path of states
    over its training rows and over its test rows.  A task has one series, seed and number of states."""
    spark = train.sparkSession
    packed = lambda d, name: d.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("ts"), "v"))).alias(name))
    grid = F.broadcast(spark.createDataFrame([(int(s), int(n)) for s in seeds for n in states], "seed int, states int"))
    series = packed(train, "a").join(packed(test, "b"), list(keys), "left") if keys else packed(train, "a").crossJoin(packed(test, "b"))  # one row each
    part = "array<struct<ts:timestamp_ntz,label:int>>"
    kinds = "".join(f"{k} {dict(train.dtypes)[k]}, " for k in keys)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.array([r["v"] for r in pdf.a[0]], float)
        m = mixture.fit_hmm(x, int(pdf.states[0]), int(pdf.seed[0]))
        path = lambda rows: [] if rows is None or not len(rows) else [{"ts": r["ts"], "label": int(k)} for r, k in zip(rows, m.viterbi(np.array([r["v"] for r in rows], float)), strict=True)]
        return pd.DataFrame({**{k: pdf[k][:1] for k in keys}, "seed": pdf.seed[:1], "states": pdf.states[:1], "bic": [m.bic(len(x))], "train": [path(pdf.a[0])], "test": [path(pdf.b[0])]})

    fits = series.join(grid).repartition(clustering.FITS, *keys, "seed", "states").groupBy(*keys, "seed", "states").applyInPandas(run, f"{kinds}seed int, states int, bic double, train {part}, test {part}")
    best = fits.groupBy(*keys, "seed").agg(F.min_by(F.struct("states", "bic", "train", "test"), F.struct("bic", "states")).alias("m")).select(*keys, "seed", "m.*")
    side = lambda s: best.select(*keys, "seed", "states", "bic", F.lit(s).alias("split"), F.inline(s))
    return side("train").unionByName(side("test"))


def run_all(train: DataFrame, test: DataFrame, seeds: Sequence[int] = SEEDS, keys: Sequence[str] = (), order: str = "ts", save_to: str | None = None) -> tuple[DataFrame, list[dict]]:
    """((method, keys, seed, split, ts, label), models): both baselines for every seed; K-Means takes all series together.

    ``save_to`` gets one folder for each K-Means model, with what was chosen and why.
    """
    parts, models = [], []
    hmm = hmm_labels(train, test, seeds, keys=keys, order=order).select(F.lit("HMM").alias("method"), *keys, "seed", "split", "ts", "label")
    own = [d.select(F.xxhash64(*keys, order).alias("id"), *keys, F.col(order).alias("ts"), F.col("v").cast("array<double>").alias("v")).persist() for d in (train, test)]
    found = principal_axes(own[0].select("id", "v"))  # the same for every seed
    for seed in seeds:
        model = fit_kmeans_pca(own[0].select("id", "v"), seed, found=found) | {"seed": int(seed)}
        models.append(model)
        if save_to:
            save_model(train.sparkSession, model, f"{save_to}/kmpca/seed={seed}")
        for name, rows in zip(("train", "test"), own, strict=True):
            parts.append(predict_kmeans_pca(rows, model).select(F.lit("KM-PCA").alias("method"), *keys, F.lit(int(seed)).alias("seed"), F.lit(name).alias("split"), "ts", "label"))
    out = hmm
    for p in parts:
        out = out.unionByName(p)
    return out, models


def save_model(spark, model: dict, path: str) -> None:
    """The model as one JSON row, in any store that Spark can write."""
    spark.createDataFrame([(json.dumps(model),)], "model string").coalesce(1).write.mode("overwrite").text(path)


def load_model(spark, path: str) -> dict:
    return json.loads(spark.read.text(path).first()[0])
