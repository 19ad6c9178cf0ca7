"""Geometry of labelled vectors: cluster quality, neighbours, spectra and agreement.

Exact measures over all pairs go through blocks: vectors are packed into bounded blocks and blocks meet in a grid, so no task
holds more than two blocks.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 4096


def vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label") -> DataFrame:
    """(id, v array<double>, label); rows without a vector are left out."""
    label = F.col(label_col).cast("int") if label_col else F.lit(0)
    return df.filter(F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), label.alias("label"))


def in_blocks(rows: DataFrame, run: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str, others: DataFrame | None = None) -> DataFrame:
    """``run`` on every pair of blocks of ``rows`` and ``others`` (rows themselves, if not given)."""
    others = rows if others is None else others
    others = others.select(*[F.col(c).alias(c) for c in others.columns])  # columns of their own, though both sides may be one table
    count = lambda d: max(1, -(-d.count() // BLOCK))
    a, b = count(rows), count(others)
    deal = lambda d, own, mine, other, n: d.withColumn(mine, F.pmod(F.xxhash64("id"), F.lit(own)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    left, right = deal(rows, a, "_a", "_b", b), deal(others, b, "_b", "_a", a)
    return left.groupBy("_a", "_b").cogroup(right.groupBy("_a", "_b")).applyInPandas(run, schema)


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    d = (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * x @ y.T
    return np.sqrt(np.maximum(d, 0))


def silhouette_samples(rows: DataFrame) -> DataFrame:
    """(id, label, s): exact Euclidean silhouette; noise (label -1) takes no part; a cluster of one has 0."""
    rows = rows.filter(F.col("label") != -1)

    def run(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if x.empty or y.empty:
            return pd.DataFrame({"id": [], "label": [], "other": [], "total": [], "n": []})
        d = _distances(np.stack(x.v), np.stack(y.v))
        d[x.id.to_numpy()[:, None] == y.id.to_numpy()[None, :]] = 0
        got = []
        for other in np.unique(y.label):
            m = (y.label == other).to_numpy()
            got.append(pd.DataFrame({"id": x.id, "label": x.label, "other": other, "total": d[:, m].sum(1), "n": m.sum()}))
        return pd.concat(got)

    sums = in_blocks(rows, run, "id long, label int, other int, total double, n long").groupBy("id", "label", "other").agg(F.sum("total").alias("t"), F.sum("n").alias("n"))
    own = F.max(F.when(F.col("other") == F.col("label"), F.when(F.col("n") > 1, F.col("t") / (F.col("n") - 1))))
    near = F.min(F.when(F.col("other") != F.col("label"), F.col("t") / F.col("n")))
    got = sums.groupBy("id", "label").agg(own.alias("a"), near.alias("b"))
    s = F.when(F.col("a").isNull() | F.col("b").isNull(), F.lit(0.0)).otherwise(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")))
    return got.select("id", "label", F.coalesce(s, F.lit(0.0)).alias("s"))


def silhouette(rows: DataFrame, sample_size: int | None = None, seed: int = 0) -> DataFrame:
    """(silhouette): the mean; -inf with fewer than two clusters.  ``sample_size`` takes the rows of the smallest hashes."""
    if sample_size:
        rows = rows.orderBy(F.xxhash64("id", F.lit(seed))).limit(sample_size)
    got = silhouette_samples(rows).agg(F.avg("s").alias("m"), F.countDistinct("label").alias("k"))
    return got.select(F.when(F.col("k") >= 2, F.col("m")).otherwise(F.lit(float("-inf"))).alias("silhouette"))


def spread(rows: DataFrame) -> DataFrame:
    """(label, i, v): one row for each coordinate."""
    return rows.select("id", "label", F.posexplode("v").alias("i", "v"))


def centroids(rows: DataFrame) -> DataFrame:
    """(label, i, c, n)."""
    return spread(rows).groupBy("label", "i").agg(F.avg("v").alias("c"), F.count("*").alias("n"))


def davies_bouldin(rows: DataFrame) -> DataFrame:
    """(dbi): mean over clusters of the largest (s_i + s_j) / d(c_i, c_j); s is the mean distance to the centroid."""
    rows = rows.filter(F.col("label") != -1)
    c = centroids(rows)
    off = spread(rows).join(c, ["label", "i"]).groupBy("label", "id").agg(F.sqrt(F.sum((F.col("v") - F.col("c")) ** 2)).alias("d"))
    s = off.groupBy("label").agg(F.avg("d").alias("s"))
    other = c.select(F.col("label").alias("label2"), "i", F.col("c").alias("c2"))
    apart = c.join(other, "i").filter("label <> label2").groupBy("label", "label2").agg(F.sqrt(F.sum((F.col("c") - F.col("c2")) ** 2)).alias("d"))
    worst = apart.join(s, "label").join(s.select(F.col("label").alias("label2"), F.col("s").alias("s2")), "label2").groupBy("label").agg(F.max((F.col("s") + F.col("s2")) / F.col("d")).alias("r"))
    return worst.agg(F.avg("r").alias("dbi"))


def calinski_harabasz(rows: DataFrame) -> DataFrame:
    """(ch_index): (trace between / (k - 1)) / (trace within / (n - k))."""
    rows = rows.filter(F.col("label") != -1)
    cells = spread(rows).groupBy("label", "i").agg(F.count("*").alias("n"), F.avg("v").alias("c"), F.var_pop("v").alias("w"))
    total = spread(rows).groupBy("i").agg(F.avg("v").alias("m"))
    parts = cells.join(total, "i").agg(
        F.sum(F.col("n") * (F.col("c") - F.col("m")) ** 2).alias("b"), F.sum(F.col("n") * F.col("w")).alias("w"), F.countDistinct("label").alias("k")
    )
    n = rows.agg(F.count("*").alias("n"))
    return parts.join(F.broadcast(n)).select(((F.col("b") / (F.col("k") - 1)) / (F.col("w") / (F.col("n") - F.col("k")))).alias("ch_index"))


def cluster_counts(rows: DataFrame) -> DataFrame:
    """(n_clusters, noise_fraction); an empty table has neither."""
    return rows.agg(F.countDistinct(F.when(F.col("label") != -1, F.col("label"))).alias("n_clusters"), F.coalesce(F.avg((F.col("label") == -1).cast("double")), F.lit(0.0)).alias("noise_fraction"))


def nearest(rows: DataFrame, queries: DataFrame, k: int = 5, metric: str = "cosine") -> DataFrame:
    """(query_id, rank, id, score): the k nearest other rows, ties to the smaller id; score is the cosine, or the distance."""

    def run(q: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        if q.empty or d.empty:
            return pd.DataFrame({"query_id": [], "id": [], "score": []})
        x, y = np.stack(q.v), np.stack(d.v)
        if metric == "cosine":
            x, y = (m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300) for m in (x, y))
            away = -(x @ y.T)
        else:
            away = _distances(x, y)
        away[q.id.to_numpy()[:, None] == d.id.to_numpy()[None, :]] = np.inf
        got = []
        for i, qid in enumerate(q.id):
            order = np.lexsort((d.id.to_numpy(), np.round(away[i], 12)))[:k]
            order = order[np.isfinite(away[i][order])]
            got.append(pd.DataFrame({"query_id": qid, "id": d.id.to_numpy()[order], "score": away[i][order]}))
        return pd.concat(got)

    found = in_blocks(queries, run, "query_id long, id long, score double", rows)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("score", 12), "id"))
    sign = -1.0 if metric == "cosine" else 1.0
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "id", (F.col("score") * sign).alias("score"))


def gram(rows: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, mean, centred second moment) of the vectors, from partial sums of each partition."""

    def run(batches):
        n, s, g = 0, None, None
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf.v)
                n, s, g = n + len(x), (0 if s is None else s) + x.sum(0), (0 if g is None else g) + x.T @ x
        if n:
            yield pd.DataFrame({"n": [n], "s": [s.tolist()], "g": [g.ravel().tolist()]})

    parts = rows.select("v").mapInPandas(run, "n long, s array<double>, g array<double>")
    cells = lambda c: parts.select(F.posexplode(c).alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x"))
    n = parts.agg(F.sum("n")).first()[0] or 0
    s, g = (np.array([r.x for r in cells(c).orderBy("i").collect()]) for c in ("s", "g"))  # as many as dimensions, squared
    mean = s / max(n, 1)
    return n, mean, g.reshape(len(s), len(s)) - n * np.outer(mean, mean)


def spectrum(rows: DataFrame) -> DataFrame:
    """(share, components) for 50, 80, 90 and 95 % of the variance, and (participation ratio) under share 0."""
    _, _, g = gram(rows)
    value = np.maximum(np.linalg.eigvalsh(g)[::-1], 0)
    part = np.cumsum(value) / max(value.sum(), 1e-300)
    out = [(s, float(np.searchsorted(part, s) + 1)) for s in (0.5, 0.8, 0.9, 0.95)]
    out.append((0.0, float(value.sum() ** 2 / max((value**2).sum(), 1e-300))))
    return rows.sparkSession.createDataFrame(out, "share double, components double")


def linear_cka(a: DataFrame, b: DataFrame) -> float:
    """Similarity of two sets of vectors of the same ids: |Y'X|^2 / (|X'X| |Y'Y|), centred."""
    both = a.select("id", "v").join(b.select("id", F.col("v").alias("w")), "id")
    width = len(both.select("v").first()[0])
    _, _, g = gram(both.select(F.concat("v", "w").alias("v")))
    xx, yy, xy = g[:width, :width], g[width:, width:], g[:width, width:]
    return float((xy**2).sum() / (np.linalg.norm(xx) * np.linalg.norm(yy)))


def canonical_correlations(a: DataFrame, b: DataFrame, ridge: float = 1e-9) -> list[float]:
    """Canonical correlations of two sets of vectors of the same ids."""
    both = a.select("id", "v").join(b.select("id", F.col("v").alias("w")), "id")
    width = len(both.select("v").first()[0])
    _, _, g = gram(both.select(F.concat("v", "w").alias("v")))
    root = lambda m: (lambda e, u: u @ np.diag(1 / np.sqrt(np.maximum(e, ridge * e.max()))) @ u.T)(*np.linalg.eigh(m))
    return np.linalg.svd(root(g[:width, :width]) @ g[:width, width:] @ root(g[width:, width:]), compute_uv=False).clip(0, 1).tolist()


def distance_cv(rows: DataFrame, sample: int | None = None, seed: int = 0) -> DataFrame:
    """(cv_distance, cv_norm): deviation over mean of all pairwise distances and of norms.

    ``sample`` takes the distances of the rows of the smallest hashes; norms are always those of all rows.
    """
    part = rows.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(sample) if sample else rows

    def run(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if x.empty or y.empty:
            return pd.DataFrame({"n": [], "s": [], "q": []})
        v, w, i, j = np.stack(x.v), np.stack(y.v), x.id.to_numpy(), y.id.to_numpy()
        got = []
        for s in range(0, len(v), 256):
            d = _distances(v[s : s + 256], w)[i[s : s + 256, None] < j[None, :]]
            got.append((len(d), d.sum(), (d * d).sum()))
        return pd.DataFrame(got, columns=["n", "s", "q"])

    t = in_blocks(part, run, "n long, s double, q double").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    mean = F.col("s") / F.col("n")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda acc, v: acc + v * v))
    norms = rows.agg((F.stddev_pop(norm) / F.avg(norm)).alias("cv_norm"))
    return t.select((F.sqrt(F.col("q") / F.col("n") - mean**2) / mean).alias("cv_distance")).join(F.broadcast(norms))


def hopkins(rows: DataFrame, m: int = 100, seed: int = 0) -> float:
    """Hopkins' statistic: near 1 for clustered vectors, 0.5 for uniform ones; m probes."""
    rng = np.random.default_rng(seed)
    low, high = (np.array([r.x for r in spread(rows).groupBy("i").agg(f("v").alias("x")).orderBy("i").collect()]) for f in (F.min, F.max))
    probes = [(-1 - k, rng.uniform(low, high).tolist(), 0) for k in range(m)]
    real = rows.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(m)
    spark = rows.sparkSession
    u = nearest(rows, spark.createDataFrame(probes, "id long, v array<double>, label int"), 1, "euclidean").agg(F.sum("score")).first()[0]
    w = nearest(rows, real, 1, "euclidean").agg(F.sum("score")).first()[0]
    return float(u / (u + w))


def adjusted_rand(labels: DataFrame, a: str, b: str) -> DataFrame:
    """(ari) of two label columns, from their contingency table."""
    pairs = lambda n: n * (n - 1) / 2
    cells = labels.groupBy(a, b).agg(F.count("*").alias("n"))
    side = lambda c: cells.groupBy(c).agg(F.sum("n").alias("n")).agg(F.sum(pairs(F.col("n"))).alias("s"))
    t = cells.agg(F.sum(pairs(F.col("n"))).alias("both"), F.sum("n").alias("n"))
    t = t.join(F.broadcast(side(a).withColumnRenamed("s", "sa"))).join(F.broadcast(side(b).withColumnRenamed("s", "sb")))
    by_chance = F.col("sa") * F.col("sb") / pairs(F.col("n"))
    return t.select(F.coalesce(F.try_divide(F.col("both") - by_chance, (F.col("sa") + F.col("sb")) / 2 - by_chance), F.lit(1.0)).alias("ari"))
