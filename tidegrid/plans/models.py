"""Queries of embeddings, clustering, evaluation and diagnostics."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tidegrid.functions import density
from tidegrid.operators import baselines, branches, clustering, fusion, geometry, split, statistics, temporal, windows
from tidegrid.plans import sql
from tidegrid.plans.registry import TEST_START, TRAIN_END, _features, _matrix, _series, _vectors, query, tidy
from tidegrid.schema import CONDITIONS, FEATURES, SEEDS, TIMEFRAMES

VEC = "WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings WHERE embedding IS NOT NULL)"
CELLS = VEC + ", c AS (SELECT id, label, i, v[i] AS x FROM v, range(1, 65) AS r(i)), m AS (SELECT label, i, avg(x) AS c, count(*) AS n, var_pop(x) AS w FROM c GROUP BY label, i)"


def _hours(spark, d):
    """Hourly returns with a label for each hour of the day's quarter."""
    f = _matrix(spark, d)
    return f.select("symbol", "ts", "close_return_1h", "hl_range_1h", F.floor(F.hour("ts") / 6).cast("int").alias("label"))


HOURS = sql.feature_ctes() + ", hours AS (SELECT symbol, ts, close_return_1h, hl_range_1h, (hour(ts) // 6)::INTEGER AS label FROM matrix)"


def _runs(spark, d):
    """A metric for each condition and seed: means over parts of the vectors."""
    v = _vectors(spark, d)
    names = F.array(*[F.lit(c) for c in ("1TF", "2TF", "3TF", "4TF")])
    at = F.element_at(names, (F.pmod("id", F.lit(4)) + 1).cast("int"))
    return v.select(at.alias("condition"), F.pmod(F.floor(F.col("id") / 4), F.lit(5)).cast("int").alias("seed"), F.element_at("v", 1).alias("x")).groupBy("condition", "seed").agg(F.round(F.avg("x"), 6).alias("metric"))


RUNS = VEC + ", runs AS (SELECT ['1TF', '2TF', '3TF', '4TF'][(id % 4 + 1)::INTEGER] AS condition, ((id // 4) % 5)::INTEGER AS seed, round(avg(v[1]), 6) AS metric FROM v GROUP BY ALL)"
RANKS = RUNS + """, d AS (SELECT a.condition, a.seed, a.metric - b.metric AS d FROM runs a JOIN runs b ON b.seed = a.seed AND b.condition = '1TF' WHERE a.condition <> '1TF' AND a.metric <> b.metric),
k AS (SELECT *, rank() OVER (PARTITION BY condition ORDER BY round(abs(d), 12)) + (count(*) OVER (PARTITION BY condition, round(abs(d), 12)) - 1) / 2.0 AS r FROM d),
w AS (SELECT condition, count(*) AS n, sum(CASE WHEN d > 0 THEN r ELSE 0.0 END) AS w_plus, sum(CASE WHEN d < 0 THEN r ELSE 0.0 END) AS w_minus FROM k GROUP BY condition),
subsets AS (SELECT s, list_sum(list_transform(range(0, 5), lambda i: CASE WHEN (s >> i) & 1 = 1 THEN i + 1 ELSE 0 END)) AS total FROM range(0, 32) AS t(s)),
p AS (SELECT w.*, (w_plus - w_minus) / (n * (n + 1) / 2.0) AS rank_biserial, (SELECT count(*) FROM subsets WHERE total >= w_plus - 1e-9) / 32.0 AS p, power(0.5, n) AS min_attainable_p FROM w)"""
HOLM = RANKS + ", x AS (SELECT *, p * (count(*) OVER () - row_number() OVER (ORDER BY p, condition) + 1) AS x FROM p), h AS (SELECT *, least(1.0, max(x) OVER (ORDER BY p, condition ROWS UNBOUNDED PRECEDING)) AS p_holm FROM x)"


@query("j1_cluster_counts", "SELECT count(DISTINCT label) FILTER (label <> -1) AS n_clusters, round(avg((label = -1)::INTEGER), 6) + 0.0 AS noise_fraction FROM embeddings")
def j1(spark, d):
    return tidy(geometry.cluster_counts(_vectors(spark, d)), ["noise_fraction"])


@query("l2_silhouette", VEC + """, p AS (SELECT a.id, a.label, b.label AS other, sum(list_distance(a.v, b.v)) AS t, count(*) AS n FROM v a JOIN v b ON a.id <> b.id GROUP BY ALL),
q AS (SELECT id, label, max(CASE WHEN other = label THEN t / n END) AS a, min(CASE WHEN other <> label THEN t / n END) AS b FROM p GROUP BY id, label)
SELECT round(avg(coalesce((b - a) / greatest(a, b), 0.0)), 6) + 0.0 AS silhouette FROM q""")
def l2(spark, d):
    return tidy(geometry.silhouette(_vectors(spark, d)), ["silhouette"])


@query("l3_davies_bouldin", CELLS + """, o AS (SELECT label, id, sqrt(sum((x - c) ** 2)) AS d FROM c JOIN m USING (label, i) GROUP BY label, id), s AS (SELECT label, avg(d) AS s FROM o GROUP BY label),
a AS (SELECT p.label AS l1, q.label AS l2, sqrt(sum((p.c - q.c) ** 2)) AS d FROM m p JOIN m q ON p.i = q.i AND p.label <> q.label GROUP BY ALL),
r AS (SELECT l1, max((x.s + y.s) / d) AS r FROM a JOIN s x ON x.label = l1 JOIN s y ON y.label = l2 GROUP BY l1) SELECT round(avg(r), 6) + 0.0 AS dbi FROM r""")
def l3(spark, d):
    return tidy(geometry.davies_bouldin(_vectors(spark, d)), ["dbi"])


@query("l4_calinski_harabasz", CELLS + """, t AS (SELECT i, avg(x) AS g FROM c GROUP BY i), s AS (SELECT sum(n * (c - g) ** 2) AS b, sum(n * w) AS w, count(DISTINCT label) AS k FROM m JOIN t USING (i))
SELECT round((b / (k - 1)) / (w / ((SELECT count(*) FROM v) - k)), 6) + 0.0 AS ch_index FROM s""")
def l4(spark, d):
    return tidy(geometry.calinski_harabasz(_vectors(spark, d)), ["ch_index"])


@query("l6_cluster_moments", HOURS + " SELECT label, count(*) AS n, round(avg(close_return_1h), 6) + 0.0 AS mean, round(stddev_samp(close_return_1h), 6) + 0.0 AS std, round(skewness(close_return_1h), 4) + 0.0 AS skew FROM hours GROUP BY label")
def l6(spark, d):
    return tidy(tidy(statistics.cluster_moments(_hours(spark, d), "close_return_1h"), ["mean", "std"]), ["skew"], 4)


KW = HOURS + """, r AS (SELECT *, rank() OVER (PARTITION BY symbol ORDER BY close_return_1h) + (count(*) OVER (PARTITION BY symbol, close_return_1h) - 1) / 2.0 AS r FROM hours),
g AS (SELECT symbol, label, sum(r) AS r, count(*) AS n FROM r GROUP BY symbol, label), t AS (SELECT symbol, sum(t ** 3 - t) AS t FROM (SELECT symbol, close_return_1h, count(*)::DOUBLE AS t FROM hours GROUP BY ALL) GROUP BY symbol),
s AS (SELECT symbol, sum(r * r / n) AS q, sum(n)::DOUBLE AS n, count(*) AS k FROM g GROUP BY symbol)"""


@query("l7_kruskal_wallis", KW + " SELECT symbol, round((12 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - t / (n ** 3 - n)), 6) + 0.0 AS h, (k - 1)::INTEGER AS df, n::BIGINT AS n FROM s JOIN t USING (symbol)")
def l7(spark, d):
    return tidy(statistics.kruskal_wallis(_hours(spark, d), "close_return_1h", keys=("symbol",)), ["h"])


@query("l7_kruskal_p")
def l7_p(spark, d):
    return tidy(statistics.kruskal_p(statistics.kruskal_wallis(_hours(spark, d), "close_return_1h", keys=("symbol",))), ["h", "p"])


@query("l8_wilcoxon", RANKS + " SELECT condition, n, w_plus + 0.0 AS w_plus, w_minus + 0.0 AS w_minus, round(rank_biserial, 6) + 0.0 AS rank_biserial, round(p, 6) + 0.0 AS p, round(min_attainable_p, 6) + 0.0 AS min_attainable_p FROM p")
def l8(spark, d):
    return tidy(statistics.wilcoxon(_runs(spark, d), "metric"), ["w_plus", "w_minus", "rank_biserial", "p", "min_attainable_p"])


@query("l9_holm", HOLM + " SELECT condition, round(p, 6) + 0.0 AS p, round(p_holm, 6) + 0.0 AS p_holm FROM h")
def l9(spark, d):
    return tidy(statistics.holm(statistics.wilcoxon(_runs(spark, d), "metric")).select("condition", "p", "p_holm"), ["p", "p_holm"])


@query("l11_over_seeds", RUNS + " SELECT condition, round(avg(metric), 6) + 0.0 AS metric_mean, round(stddev_samp(metric), 6) + 0.0 AS metric_std FROM runs GROUP BY condition")
def l11(spark, d):
    return tidy(statistics.over_seeds(_runs(spark, d), ["metric"]), ["metric_mean", "metric_std"])


@query("l12_ablation_table")
def l12(spark, d):
    runs = _runs(spark, d)
    return statistics.ablation_table(runs, statistics.holm(statistics.wilcoxon(runs, "metric")), "metric")


def _registry(spark):
    every = [(c, s) for c in (*CONDITIONS, "HMM", "KM-PCA") for s in SEEDS]
    return spark.createDataFrame(every, "condition string, seed int")


@query("l13_pending_runs", RUNS + ", names AS (SELECT unnest(['1TF', '2TF', '3TF', '4TF', 'BL-15m', 'BL-4h', 'BL-1d', 'HMM', 'KM-PCA']) AS condition), seeds AS (SELECT unnest([42, 123, 456, 789, 1024])::INTEGER AS seed) SELECT n.condition, s.seed FROM names n, seeds s WHERE NOT EXISTS (SELECT 1 FROM runs r WHERE r.condition = n.condition AND [42, 123, 456, 789, 1024][r.seed + 1] = s.seed AND r.metric > 0)")
def l13(spark, d):
    from tidegrid.sources.tables import pending

    seeds = F.array(*[F.lit(s) for s in SEEDS])
    done = _runs(spark, d).select("condition", F.element_at(seeds, F.col("seed") + 1).alias("seed"), F.when(F.col("metric") > 0, "done").otherwise("failed").alias("status"))
    return pending(_registry(spark), done, ("condition", "seed"))


# --- diagnostics


@query("m1_linear_cka")
def m1(spark, d):
    v = _vectors(spark, d)
    half = v.select("id", F.slice("v", 1, 32).alias("v"))
    return spark.createDataFrame([(round(geometry.linear_cka(v, half), 6),)], "cka double")


@query("m2_ridge_probe")
def m2(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("symbol").orderBy("ts")
    rows = _matrix(spark, d).withColumn("target", F.lead("hl_range_1h").over(w))
    got = statistics.ridge_probe(rows.filter(F.col("ts") <= F.lit(TRAIN_END).cast("timestamp_ntz")), rows.filter(F.col("ts") >= F.lit(TEST_START).cast("timestamp_ntz")), [f"{f}_1h" for f in FEATURES], "target")
    return spark.createDataFrame([(round(got["r2"], 6), round(got["mae"], 6))], "r2 double, mae double")


NEXT = HOURS + ", n AS (SELECT symbol, ts, hl_range_1h, lead(hl_range_1h) OVER (PARTITION BY symbol ORDER BY ts) AS nxt FROM hours), f AS (SELECT * FROM n WHERE nxt IS NOT NULL)"
RANKED = ", r AS (SELECT *, rank() OVER (PARTITION BY symbol ORDER BY hl_range_1h) + (count(*) OVER (PARTITION BY symbol, hl_range_1h) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY symbol ORDER BY nxt) + (count(*) OVER (PARTITION BY symbol, nxt) - 1) / 2.0 AS ry FROM f)"


@query("m3_scale_correlation", NEXT + RANKED + " SELECT symbol, round(corr(hl_range_1h, nxt), 6) + 0.0 AS pearson, round(corr(rx, ry), 6) + 0.0 AS spearman FROM r GROUP BY symbol")
def m3(spark, d):
    from pyspark.sql import Window

    rows = _hours(spark, d).withColumn("nxt", F.lead("hl_range_1h").over(Window.partitionBy("symbol").orderBy("ts")))
    return tidy(statistics.scale_correlation(rows, "hl_range_1h", "nxt", ("symbol",)), ["pearson", "spearman"])


def _near(metric: str, expr: str, order: str) -> str:
    return VEC + f", p AS (SELECT a.id AS query_id, b.id, {expr} AS s FROM v a JOIN v b ON a.id <> b.id WHERE a.id % 20 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) {order}, id)::INTEGER AS rank FROM p) SELECT query_id, rank, id, round(s, 6) + 0.0 AS score FROM r WHERE rank <= 5"


def _queries(v):
    return v.filter(F.pmod("id", F.lit(20)) == 0)


@query("m4_nearest_cosine", _near("cosine", "list_cosine_similarity(a.v, b.v)", "DESC"))
def m4(spark, d):
    v = _vectors(spark, d)
    return tidy(geometry.nearest(v, _queries(v), 5, "cosine"), ["score"])


@query("m4_nearest_euclidean", _near("euclidean", "list_distance(a.v, b.v)", ""))
def m4_euclidean(spark, d):
    v = _vectors(spark, d)
    return tidy(geometry.nearest(v, _queries(v), 5, "euclidean"), ["score"])


@query("m5_warping")
def m5(spark, d):
    v = _vectors(spark, d)
    near = geometry.nearest(v, _queries(v), 5, "euclidean")
    pairs = near.join(v.select("id", "v"), "id").join(v.select(F.col("id").alias("query_id"), F.col("v").alias("q")), "query_id")

    @F.pandas_udf("double")
    def dtw(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([density.warp(np.reshape(x, (16, -1)), np.reshape(y, (16, -1))) for x, y in zip(a, b, strict=True)])

    return pairs.select("query_id", "rank", "id", F.round(dtw("q", "v"), 6).alias("dtw"))


@query("m6_neighbour_gaps", _near("cosine", "list_cosine_similarity(a.v, b.v)", "DESC").replace("SELECT query_id, rank, id, round(s, 6) + 0.0 AS score FROM r WHERE rank <= 5", "SELECT median(abs(id - query_id)) + 0.0 AS median_gap, round(avg((abs(id - query_id) <= 5)::INTEGER), 6) + 0.0 AS within_5, round(avg((abs(id - query_id) <= 1)::INTEGER), 6) + 0.0 AS within_1 FROM r WHERE rank <= 5"))
def m6(spark, d):
    v = _vectors(spark, d)
    times = v.select("id", F.timestamp_seconds(F.col("id") * 3600).alias("ts"))
    return tidy(statistics.neighbour_gaps(geometry.nearest(v, _queries(v), 5, "cosine"), times), ["median_gap", "within_5", "within_1"])


@query("m7_spectrum")
def m7(spark, d):
    return tidy(geometry.spectrum(_vectors(spark, d)), ["components"])


@query("m8_distance_cv", VEC + ", p AS (SELECT list_distance(a.v, b.v) AS x FROM v a JOIN v b ON a.id < b.id), n AS (SELECT sqrt(list_sum(list_transform(v, lambda t: t * t))) AS l FROM v) SELECT round(stddev_pop(x) / avg(x), 6) + 0.0 AS cv_distance, (SELECT round(stddev_pop(l) / avg(l), 6) + 0.0 FROM n) AS cv_norm FROM p")
def m8(spark, d):
    return tidy(geometry.distance_cv(_vectors(spark, d)), ["cv_distance", "cv_norm"])


@query("m9_hopkins")
def m9(spark, d):
    return spark.createDataFrame([(round(geometry.hopkins(_vectors(spark, d)), 6),)], "hopkins double")


STREAKS = HOURS + """, c AS (SELECT *, (close_return_1h > 0)::INTEGER AS up FROM hours), m AS (SELECT *, CASE WHEN lag(up) OVER w IS DISTINCT FROM up THEN 1 ELSE 0 END AS new FROM c WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
k AS (SELECT *, sum(new) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM m), r AS (SELECT symbol, up AS label, run, count(*) AS n FROM k GROUP BY ALL)"""


@query("m10_persistence", STREAKS + " SELECT symbol, label, count(*) AS runs, round(avg(n), 6) + 0.0 AS mean_run, max(n) AS longest FROM r GROUP BY symbol, label")
def m10(spark, d):
    rows = _hours(spark, d).withColumn("label", (F.col("close_return_1h") > 0).cast("int"))
    return tidy(statistics.persistence(rows), ["mean_run"])


@query("m12_adjusted_rand", """WITH c AS (SELECT label, (vec_id % 5)::INTEGER AS other, count(*) AS n FROM embeddings GROUP BY ALL), t AS (SELECT sum(n * (n - 1) / 2.0) AS b, sum(n) AS n FROM c),
x AS (SELECT sum(s * (s - 1) / 2.0) AS s FROM (SELECT sum(n) AS s FROM c GROUP BY label)), y AS (SELECT sum(s * (s - 1) / 2.0) AS s FROM (SELECT sum(n) AS s FROM c GROUP BY other))
SELECT round((b - x.s * y.s / (n * (n - 1) / 2.0)) / ((x.s + y.s) / 2.0 - x.s * y.s / (n * (n - 1) / 2.0)), 6) + 0.0 AS ari FROM t, x, y""")
def m12(spark, d):
    return tidy(geometry.adjusted_rand(_vectors(spark, d).withColumn("other", F.pmod("id", F.lit(5)).cast("int")), "label", "other"), ["ari"])


@query("m13_gaussian_mixture")
def m13(spark, d):
    from pyspark.ml.clustering import GaussianMixture
    from pyspark.ml.functions import array_to_vector

    a, _, _ = clustering.reduce(_vectors(spark, d), _vectors(spark, d), 4)
    x = a.select(array_to_vector("v").alias("features"))
    m = GaussianMixture(k=3, seed=42, maxIter=30).fit(x)
    return spark.createDataFrame([(3, round(float(m.summary.logLikelihood), 4))], "k int, log_likelihood double")


@query("m14_canonical_correlations")
def m14(spark, d):
    v = _vectors(spark, d)
    got = geometry.canonical_correlations(v.select("id", F.slice("v", 1, 8).alias("v")), v.select("id", F.slice("v", 9, 8).alias("v")))
    return spark.createDataFrame([(k, round(x, 6)) for k, x in enumerate(got)], "i int, correlation double")


# --- encoders and fusion


def _tagged(spark, d):
    """Windows of all timeframes and series."""
    out = None
    m = _matrix(spark, d)
    for tf in TIMEFRAMES:
        w = windows.categorise(windows.normalise(windows.extract(m, tf)), TRAIN_END, TEST_START)
        w = w.select("symbol", F.lit(tf).alias("tf"), F.col("anchor"), F.col("split"), "x")
        out = w if out is None else out.unionByName(w)
    return out


def _trained(spark, d):
    w = _tagged(spark, d)
    return w, branches.train_branches(w.filter("split = 'train'"), keys=("symbol",))


@query("h5_train_branches")
def h5(spark, d):
    return _trained(spark, d)[1].select("symbol", "tf", "seed", "status", "epochs", "best_epoch", F.round("best_loss", 3).alias("best_loss"))


@query("g5_encode")
def g5(spark, d):
    e = branches.encode_windows(*_trained(spark, d), keys=("symbol",))
    return e.select("symbol", "tf", "seed", "anchor", "split", F.size("e").alias("width"))


def _long(spark, d):
    """The vectors as the four branches of a seed: each branch takes them in another order of dimensions."""
    v = _vectors(spark, d).select(F.lit(42).alias("seed"), F.col("id").alias("anchor"), "v")
    out = None
    for k, tf in enumerate(TIMEFRAMES):
        e = F.concat(F.slice("v", 16 * k + 1, 64), F.slice("v", 1, 16 * k)) if k else F.col("v")
        one = v.select("seed", "anchor", F.lit(tf).alias("tf"), e.alias("e"))
        out = one if out is None else out.unionByName(one)
    return out


@query("i3_concatenate", VEC + " SELECT 42 AS seed, id AS anchor, 192::INTEGER AS width, round(v[1], 6) + 0.0 AS first, round(v[17], 6) + 0.0 AS second, round(v[33], 6) + 0.0 AS third FROM v")
def i3(spark, d):
    e = fusion.concatenate(_long(spark, d), CONDITIONS["3TF"])
    at = lambda k, n: F.element_at("e", k).alias(n)
    return tidy(e.select("seed", "anchor", F.size("e").alias("width"), at(1, "first"), at(65, "second"), at(129, "third")), ["first", "second", "third"])


@query("i2_projection", "SELECT 256::BIGINT AS n_rows, 256::BIGINT AS n_cols, 0::BIGINT AS n_not_unit")
def i2(spark, d):
    p = fusion.projection(256)
    return spark.createDataFrame([(p.shape[0], p.shape[1], int((np.abs(np.linalg.norm(p, axis=1) - 1) > 1e-5).sum()))], "n_rows long, n_cols long, n_not_unit long")


@query("i4_fuse")
def i4(spark, d):
    out = None
    for c in CONDITIONS:
        one = fusion.fuse_condition(_long(spark, d), c).select("condition", "seed", "anchor", F.size("fused").alias("width"), F.round(F.element_at("fused", 1).cast("double"), 3).alias("first"))
        out = one if out is None else out.unionByName(one)
    return out


# --- clustering


@query("j3_density_grid")
def j3(spark, d):
    return clustering.density_grid(_vectors(spark, d))


@query("j5_locked_density")
def j5(spark, d):
    v = _vectors(spark, d)
    train, test = v.filter(F.pmod("id", F.lit(4)) < 3), v.filter(F.pmod("id", F.lit(4)) == 3)
    return clustering.density_labels(train, test, 20, 5)


BARS_LABELS = sql.feature_ctes() + ", bars AS (SELECT h.ts AS timestamp, h.open AS open_1h, h.high AS high_1h, h.low AS low_1h, h.close AS close_1h, h.volume AS volume_1h, f.close_return_1h FROM b_1h h JOIN feats f ON f.symbol = h.symbol AND f.ts = h.ts WHERE h.symbol = 'view')"


def _ohlcv(spark, d):
    s = _series(spark, d)["1h"].filter(F.col("symbol") == "view")
    f = _features(spark, d).filter(F.col("symbol") == "view").select("symbol", "ts", "close_return_1h")
    return s.join(f, ["symbol", "ts"]).select(F.col("ts").alias("timestamp"), *[F.col(c).alias(f"{c}_1h") for c in ("open", "high", "low", "close", "volume")], "close_return_1h")


@query("j7_ohlcv_with_return", BARS_LABELS + f" SELECT timestamp, {sql.rounded(['open_1h', 'high_1h', 'low_1h', 'close_1h', 'volume_1h', 'close_return_1h'])} FROM bars")
def j7(spark, d):
    return tidy(_ohlcv(spark, d), ["open_1h", "high_1h", "low_1h", "close_1h", "volume_1h", "close_return_1h"])


@query("j6_cluster_artifact", BARS_LABELS + f", l AS (SELECT ts AS timestamp, ((hour(ts) % 4) - 1)::INTEGER AS label FROM grid WHERE symbol = 'view') SELECT l.timestamp, {sql.rounded(['open_1h', 'high_1h', 'low_1h', 'close_1h', 'volume_1h', 'close_return_1h'])}, l.label AS cluster_label, l.label = -1 AS is_noise, '1TF' AS condition, 42 AS seed FROM l LEFT JOIN bars b ON b.timestamp = l.timestamp")
def j6(spark, d):
    grid = temporal.hour_grid(_series(spark, d)["1h"]).filter(F.col("symbol") == "view")
    labels = grid.select(F.col("ts").alias("timestamp"), (F.hour("ts") % 4 - 1).alias("label"))
    return tidy(clustering.artifact(labels, _ohlcv(spark, d), "1TF", 42), ["open_1h", "high_1h", "low_1h", "close_1h", "volume_1h", "close_return_1h"])


BARS_ALL = BARS_LABELS.replace("SELECT h.ts AS timestamp", "SELECT h.symbol, h.ts AS timestamp").replace(" WHERE h.symbol = 'view'", "")


def _ohlcv_all(spark, d):
    s = _series(spark, d)["1h"].join(_features(spark, d).select("symbol", "ts", "close_return_1h"), ["symbol", "ts"])
    return s.select("symbol", F.col("ts").alias("timestamp"), *[F.col(c).alias(f"{c}_1h") for c in ("open", "high", "low", "close", "volume")], "close_return_1h")


@query("j7_ohlcv_with_return_all", BARS_ALL + f" SELECT symbol, timestamp, {sql.rounded(['open_1h', 'high_1h', 'low_1h', 'close_1h', 'volume_1h', 'close_return_1h'])} FROM bars")
def j7_all(spark, d):
    return tidy(_ohlcv_all(spark, d), ["open_1h", "high_1h", "low_1h", "close_1h", "volume_1h", "close_return_1h"])


@query("j6_cluster_artifact_all", BARS_ALL + f", l AS (SELECT symbol, ts AS timestamp, ((hour(ts) % 4) - 1)::INTEGER AS label FROM grid) SELECT l.symbol, l.timestamp, {sql.rounded(['open_1h', 'high_1h', 'low_1h', 'close_1h', 'volume_1h', 'close_return_1h'])}, l.label AS cluster_label, l.label = -1 AS is_noise, '1TF' AS condition, 42 AS seed FROM l LEFT JOIN bars b ON b.symbol = l.symbol AND b.timestamp = l.timestamp")
def j6_all(spark, d):
    labels = temporal.hour_grid(_series(spark, d)["1h"]).select("symbol", F.col("ts").alias("timestamp"), (F.hour("ts") % 4 - 1).alias("label"))
    return tidy(clustering.artifact(labels, _ohlcv_all(spark, d), "1TF", 42, ("symbol",)), ["open_1h", "high_1h", "low_1h", "close_1h", "volume_1h", "close_return_1h"])


@query("j8_kmeans")
def j8(spark, d):
    v = _vectors(spark, d)
    centres, _ = clustering.kmeans(v)
    return clustering.nearest_centre(v, centres).select("id", "label")


@query("j8_assign_given_centres", CELLS + ", d AS (SELECT a.id, m.label, round(sqrt(sum((c.x - m.c) ** 2)), 9) AS d FROM v a JOIN c ON c.id = a.id JOIN m ON m.i = c.i GROUP BY a.id, m.label) SELECT id, arg_min(label, (d, label))::INTEGER AS label FROM d GROUP BY id")
def j8_assign(spark, d):
    v = _vectors(spark, d)
    rows = geometry.centroids(v).orderBy("label", "i").collect()  # one number for each label and dimension
    labels = sorted({r.label for r in rows})
    centres = np.array([[r.c for r in rows if r.label == k] for k in labels])
    names = F.array(*[F.lit(k) for k in labels])
    return clustering.nearest_centre(v.drop("label"), centres).select("id", F.element_at(names, F.col("label") + 1).alias("label"))


@query("k1_feature_vectors", sql.feature_ctes() + " SELECT symbol, ts, 7::INTEGER AS width, " + ", ".join(f"round({f}_1h, 6) + 0.0 AS {f}" for f in FEATURES) + " FROM matrix")
def k1(spark, d):
    rows = clustering.feature_vectors(_matrix(spark, d), "1h")
    return tidy(rows.select("symbol", "ts", F.size("v").alias("width"), *[F.element_at("v", k + 1).alias(f) for k, f in enumerate(FEATURES)]), FEATURES)


@query("k2_hmm")
def k2(spark, d):
    rows = clustering.feature_vectors(_matrix(spark, d), "1h")
    return clustering.choose_hmm(clustering.hmm_grid(rows, keys=("symbol",)), ("symbol",)).select("symbol", "seed", "states", F.round("bic", 1).alias("bic"), F.size("labels").alias("n"))


def _bar_vectors(spark, d):
    """Hourly feature vectors of all series, split by the calendar, with an id of their own."""
    rows = clustering.feature_vectors(_matrix(spark, d), "1h").withColumn("id", F.xxhash64("symbol", "ts"))
    parts = split.split(rows, TRAIN_END, TEST_START)
    return [parts.filter(F.col("split") == s).select("id", "v") for s in ("train", "test")]


@query("k4_kmeans_pca")
def k4(spark, d):
    model = baselines.fit_kmeans_pca(_bar_vectors(spark, d)[0])
    return spark.createDataFrame([(model["k"], len(model["shares"]), int(k), round(s, 4)) for k, s in model["silhouettes"].items()], "chosen int, components int, k int, silhouette double")


@query("k5_predict")
def k5(spark, d):
    train, test = _bar_vectors(spark, d)
    return baselines.predict_kmeans_pca(test, baselines.fit_kmeans_pca(train)).select("id", "label")


K3 = sql.feature_ctes() + """, x AS (SELECT symbol, ts, """ + ", ".join(f"{f}_1h" for f in FEATURES) + """ FROM matrix WHERE ts <= TIMESTAMP '""" + TRAIN_END + """')"""


@query("k3_pca", K3 + " SELECT 7 AS components, round(" + " + ".join(f"var_samp({f}_1h)" for f in FEATURES) + ", 4) + 0.0 AS total_variance FROM x")
def k3(spark, d):
    """The principal axes keep all variance when as many are asked for as there are features."""
    train, _ = _bar_vectors(spark, d)
    got, _, shares = clustering.reduce(train, train)
    return got.agg(F.lit(len(shares)).alias("components"), (F.round(sum(F.var_samp(F.element_at("v", k + 1)) for k in range(len(shares))), 4) + F.lit(0.0)).alias("total_variance"))


@query("k6_run_all")
def k6(spark, d):
    """Both baselines for every seed, over all series."""
    rows = clustering.feature_vectors(_matrix(spark, d), "1h")
    parts = split.split(rows, TRAIN_END, TEST_START)
    labels, chosen = baselines.run_all(parts.filter("split = 'train'"), parts.filter("split = 'test'"), keys=("symbol",))
    return labels.groupBy("method", "symbol", "seed", "split").agg(F.count("*").alias("n"), F.countDistinct("label").alias("labels"))
