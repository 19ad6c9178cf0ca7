import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidegrid import config, schema
from tidegrid.functions import density, encoder, mixture
from tidegrid.operators import clustering, fusion, geometry, statistics
from tidegrid.sources import tables


def test_gradients_by_finite_differences():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2, 8, 7))
    p = encoder.init(7, 2, 6, 5, 1)

    def loss(q):
        h = encoder.forward(q, x)
        return encoder.hierarchical_loss(h[:, :6], h[:, 2:])[0]

    keep = []
    h = encoder.forward(p, x, keep=keep)
    _, a, b = encoder.hierarchical_loss(h[:, :6], h[:, 2:])
    full = np.zeros_like(h)
    full[:, :6] += a
    full[:, 2:] += b
    g = encoder.backward(p, keep, full)
    for name in ("in.w", "0.w1", "1.b2", "2.w0", "2.w2"):
        at = tuple(s // 2 for s in p[name].shape)
        up, down = ({k: v.copy() for k, v in p.items()} for _ in range(2))
        up[name][at] += 1e-5
        down[name][at] -= 1e-5
        assert abs((loss(up) - loss(down)) / 2e-5 - g[name][at]) < 1e-4


def test_training_lowers_the_loss_and_is_repeatable():
    rng = np.random.default_rng(0)
    x = np.sin(np.arange(24)[None, :, None] * rng.uniform(0.2, 1, (24, 1, 7)))
    p, h = encoder.train(x, 1, epochs=6, depth=2, hidden=8, out=8, rate=5e-3)
    q, _ = encoder.train(x, 1, epochs=6, depth=2, hidden=8, out=8, rate=5e-3)
    assert min(h.losses[1:]) < h.losses[0]
    assert all(np.array_equal(p[k], q[k]) for k in p)
    back = encoder.from_bytes(encoder.to_bytes(p))
    assert np.allclose(encoder.encode(back, x), encoder.encode(p, x), atol=1e-5)
    assert encoder.encode(p, x).shape == (24, 8) and encoder.encode(p, x, 3).shape == (24, 24, 8)
    assert encoder.encode(p, x, None, sliding=6, padding=4, causal=True).shape == (24, 24, 8)


def test_masks_and_helpers():
    rng = np.random.default_rng(0)
    assert encoder.make_mask("mask_last", (2, 5), rng)[:, -1].sum() == 0 and not encoder.make_mask("all_false", (2, 5), rng).any()
    x = np.ones((2, 4, 1))
    assert encoder.pad_to(x, 6).shape == (2, 6, 1) and len(encoder.split_with_nan(x, 3)) == 3
    assert abs(float(encoder.phi(np.array(0.7))) - 0.5 * (1 + math.erf(0.7 / math.sqrt(2)))) < 1e-6


def test_projection_and_concatenation(spark):
    p = fusion.projection(128)
    assert p.shape == (256, 128) and np.allclose(np.linalg.norm(p, axis=1), 1, atol=1e-5) and np.array_equal(p, fusion.projection(128))
    rows = [(42, k, tf, [float(j + 10 * i) for j in range(4)]) for k in range(3) for i, tf in enumerate(("1h", "15m"))]
    b = spark.createDataFrame(rows, "seed int, anchor int, tf string, e array<double>")
    got = fusion.concatenate(b, ["1h", "15m"], dim=4).first().e
    assert got == [10, 11, 12, 13, 0, 1, 2, 3]
    with pytest.raises(fusion.FusionError):
        fusion.check_branches(b.filter("not (tf = '1h' and anchor = 1)"), ["1h", "15m"], dim=4)
    with pytest.raises(ValueError):
        schema.ordered_timeframes(["2h"])


def blobs(n=60, seed=0):
    rng = np.random.default_rng(seed)
    c = rng.uniform(-10, 10, (4, 8))
    return np.concatenate([rng.normal(m, 0.4, (n, 8)) for m in c]), np.repeat(np.arange(4), n)


def vectors(spark, x, label=None):
    label = np.zeros(len(x), int) if label is None else label
    return spark.createDataFrame([(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, label, strict=True))], "id long, v array<double>, label int")


def test_density_clusters_blobs_and_predicts():
    x, y = blobs()
    got = density.cluster(x, 20, 5)
    assert len(set(got.labels.tolist()) - {-1}) == 4
    for k in range(4):
        own = got.labels[(y == k) & (got.labels >= 0)]
        assert len(set(own.tolist())) == 1
    assert (got.predict(x[:5], 5) == got.labels[:5]).mean() >= 0.8
    assert (density.cluster(x[:10], 20, 5).labels == -1).all()
    assert density.warp(x[:4], x[:4]) < 1e-5


def test_density_labels_of_train_and_test(spark):
    x, _ = blobs()
    df = vectors(spark, x)
    train, test = df.filter("id % 4 < 3"), df.filter("id % 4 = 3")
    fit = density.cluster(x[np.arange(len(x)) % 4 < 3], 20, 5)
    got = {(r.split, r.id): r.label for r in clustering.density_labels(train, test, 20, 5).collect()}
    own, new = np.arange(len(x))[np.arange(len(x)) % 4 < 3], np.arange(len(x))[np.arange(len(x)) % 4 == 3]
    want = {("train", int(i)): int(k) for i, k in zip(own, fit.labels, strict=True)} | {("test", int(i)): int(k) for i, k in zip(new, fit.predict(x[new], 5), strict=True)}
    assert got == want
    assert {r.label for r in clustering.density_labels(train.limit(0), test, 20, 5).collect()} == {-1}


def test_density_grid_picks_by_silhouette_then_size(spark):
    x, _ = blobs(40)
    grid = clustering.density_grid(vectors(spark, x), (10, 20), (5,))
    assert clustering.choose_density(grid) == (10, 5)
    with pytest.raises(clustering.ClusteringError):
        clustering.choose_density(grid.withColumn("n_clusters", F.lit(1)))


def test_kmeans_and_selection(spark):
    x, y = blobs(30)
    v = vectors(spark, x, y)
    centres, _ = clustering.kmeans(v, 4, 42, 3)
    got = clustering.nearest_centre(v.drop("label"), centres).join(v.withColumnRenamed("label", "true"), "id")
    assert geometry.adjusted_rand(got, "label", "true").first().ari == 1
    assert clustering.select_k(v, (3, 4), restarts=3)[0] == 4


def test_geometry_against_numpy(spark):
    x, y = blobs(20)
    v = vectors(spark, x, y)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    s = []
    for i in range(len(x)):
        a = d[i][(y == y[i])].sum() / ((y == y[i]).sum() - 1)
        b = min(d[i][y == k].mean() for k in set(y.tolist()) - {y[i]})
        s.append((b - a) / max(a, b))
    assert abs(geometry.silhouette(v).first().silhouette - np.mean(s)) < 1e-9
    assert abs(clustering.silhouette_of(x, y) - np.mean(s)) < 1e-9
    assert geometry.silhouette(v.withColumn("label", F.lit(0))).first().silhouette == -np.inf
    noisy = v.withColumn("label", F.when(F.col("id") < 5, -1).otherwise(F.col("label")))
    assert geometry.cluster_counts(noisy).first().n_clusters == 4
    assert abs(geometry.linear_cka(v, v) - 1) < 1e-9 and geometry.hopkins(v, 20) > 0.7


def test_hmm_finds_regimes():
    rng = np.random.default_rng(0)
    s = np.repeat([0, 1, 0, 1], 60)
    x = rng.normal(np.where(s, 3.0, -3.0)[:, None], 1, (240, 2))
    m = mixture.fit_hmm(x, 2, 0)
    got = m.viterbi(x)
    assert max((got == s).mean(), (got != s).mean()) > 0.98
    assert m.bic(240) < mixture.fit_hmm(x, 4, 0).bic(240)


def test_statistics_by_hand(spark):
    assert abs(statistics.chi2_tail(3.841458820694124, 1) - 0.05) < 1e-9 and abs(statistics.chi2_tail(30, 3) - 1.38e-6) < 1e-8
    assert statistics.wilcoxon_p(5, 15) == 1 / 32
    runs = spark.createDataFrame([(c, s, b + 0.1 * s * (c != "1TF")) for c, b in (("1TF", 0.1), ("2TF", 0.3)) for s in range(1, 6)], "condition string, seed int, metric double")
    r = statistics.wilcoxon(runs, "metric").first()
    assert (r.w_plus, r.w_minus, r.rank_biserial, r.p, r.min_attainable_p) == (15, 0, 1, 1 / 32, 1 / 32)
    p = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03)], "condition string, p double")
    assert {x.condition: round(x.p_holm, 9) for x in statistics.holm(p).collect()} == {"a": 0.03, "b": 0.06, "c": 0.06}
    rows = spark.createDataFrame([(v, k) for k, vs in enumerate(([1.0, 2.0, 3.0], [4.0, 5.0, 6.0], [7.0, 8.0, 9.0])) for v in vs], "x double, label int")
    assert abs(statistics.kruskal_wallis(rows, "x").first().h - 7.2) < 1e-9
    many = np.random.default_rng(3).integers(-900, 900, 4000) / 7.0
    got = statistics.average_ranks(spark.createDataFrame([(float(v),) for v in many] + [(None,)], "x double"), "x").toPandas()
    want = pd.Series(many).rank()
    assert len(got) == 4000 and dict(zip(got.x, got["rank"], strict=True)) == dict(zip(many, want, strict=True))
    assert statistics.average_ranks(rows.limit(0), "x").count() == 0
    lab = spark.createDataFrame([("s", k, int(k in (2, 3, 4))) for k in range(8)], "symbol string, ts int, label int")
    assert {(r.label, r.runs, r.mean_run) for r in statistics.persistence(lab).collect()} == {(0, 2, 2.5), (1, 1, 3.0)}


def test_config_reports_all_missing_and_merges():
    base = {}
    for path in config.REQUIRED:
        at = base
        *steps, leaf = path.split(".")
        for s in steps:
            at = at.setdefault(s, {})
        at[leaf] = 1
    assert config.validate(base) is base
    del base["window"]["size"], base["encoder"]["depth"]
    with pytest.raises(config.ConfigError, match=r"encoder\.depth.*window\.size"):
        config.validate(base)
    assert config.merge({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}}) == {"a": {"b": 3, "c": 2}}
    with pytest.raises(config.ConfigError):
        config.load_condition(base, {"condition": {"name": "1TF"}})


def test_pages_stop_and_retry():
    data = [[k * 10, 1, 1, 1, 1, 1] for k in range(25)]
    calls = []

    def fetch(since, limit):
        calls.append(since)
        if len(calls) == 2:
            raise tables.RateLimited
        return [r for r in data if r[0] >= since][:limit]

    waits = []
    got = list(tables.pages(fetch, 0, 150, 10, sleep=waits.append))
    assert [r[0] for r in got] == list(range(0, 160, 10)) and waits == [2.0]
    with pytest.raises(ValueError):
        tables.with_retries(lambda: (_ for _ in ()).throw(ValueError()), sleep=waits.append)
    with pytest.raises(ConnectionError):
        tables.with_retries(lambda: (_ for _ in ()).throw(ConnectionError()), sleep=waits.append)


def test_paged_source(spark):
    spark.dataSource.register(tables.PagedBars)
    df = spark.read.format("paged_bars").options(fetcher="tidegrid.sources.replay:fetch", timeframes='["1h"]', start="0", end=str(99 * 3600000), ranges="3").load()
    assert df.count() == 100 and df.select("ts").distinct().count() == 100


def test_files_round_trip(spark, tmp_path):
    df = spark.range(5).select(F.col("id").alias("ts"), *[F.when(F.col("id") == 2, float("nan")).otherwise(1.0).alias(c) for c in ("open", "high", "low", "close", "volume")])
    tables.write_bars(df, str(tmp_path / "b"))
    assert tables.read_bars(spark, str(tmp_path / "b")).filter("open is null").count() == 1
    known = {r.path.rsplit("/", 1)[-1]: r.sha256 for r in tables.checksums(spark, str(tmp_path / "b")).collect()}
    assert tables.is_current(spark, str(tmp_path / "b"), known) and not tables.is_current(spark, str(tmp_path / "none"), known)
    tables.write_csv(df, str(tmp_path / "c"))
    assert spark.read.csv(str(tmp_path / "c"), header=True).count() == 5


def test_distance_cv_takes_all_rows(spark):
    x = np.random.default_rng(3).normal(size=(3300, 3)) * np.linspace(0.1, 5, 3300)[:, None]
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, v array<double>")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))[np.triu_indices(len(x), 1)]
    n = np.sqrt((x * x).sum(1))
    got = geometry.distance_cv(rows).first()
    assert abs(got.cv_distance - d.std() / d.mean()) < 1e-9 and abs(got.cv_norm - n.std() / n.mean()) < 1e-9
    part = geometry.distance_cv(rows, sample=100).first()
    assert abs(part.cv_norm - n.std() / n.mean()) < 1e-9 and abs(part.cv_distance - got.cv_distance) > 1e-6


def prim(x, core):
    """(weights by size) of the tree that adds the nearest row, one at a time."""
    d = np.maximum(np.maximum(density.distances(x, x), core), core[:, None])
    best, done, out = np.full(len(x), np.inf), np.zeros(len(x), bool), []
    at = 0
    for _ in range(len(x) - 1):
        done[at] = True
        best = np.minimum(best, d[at])
        at = int(np.where(done, np.inf, best).argmin())
        out.append(best[at])
    return sorted(out)


def test_spanning_tree_from_lists_of_the_nearest():
    rng = np.random.default_rng(0)
    tight = np.concatenate([rng.normal(c * 10, 0.01, size=(90, 3)) for c in range(4)])  # whole lists within one cluster
    for x in (rng.normal(size=(300, 8)), tight, np.repeat(rng.normal(size=(30, 4)), 40, 0), rng.integers(0, 5, size=(300, 3)).astype(float), rng.normal(size=(2, 2))):
        near = density.nearest(x, 0, len(x), 8)
        core = density.core_distances(near, 5)
        tree = density.spanning_tree(x, core, near)
        assert len(tree) == len(x) - 1 and np.allclose(tree[:, 2], prim(x, core), atol=1e-6)


def test_density_takes_more_rows_than_30000(spark):
    rows = spark.range(30_100).select("id", F.array((F.col("id") % 2) * 10.0 + F.rand(1), F.rand(2)).alias("v"))
    got = clustering.density_labels(rows, rows.limit(5), 5000, 5).collect()
    assert len(got) == 30_105
    assert len({r.label for r in got if r.id % 2 == 0} - {-1}) == 1 and len({r.label for r in got} - {-1}) == 2
    assert [r.n_clusters for r in clustering.density_grid(rows, (5000,), (5,)).collect()] == [2]


def test_baselines_find_axes_once_and_fit_in_few_partitions(spark, monkeypatch):
    from tidegrid.operators import baselines

    assert clustering.gathered(spark.range(10).repartition(50)).rdd.getNumPartitions() == 1
    assert clustering.gathered(spark.range(45_000).repartition(50)).rdd.getNumPartitions() == 3
    calls, axes = [], baselines.principal_axes
    monkeypatch.setattr(baselines, "principal_axes", lambda *a: calls.append(a) or axes(*a))
    monkeypatch.setattr(baselines, "KS", (2,))
    monkeypatch.setattr(baselines, "fit_kmeans_pca", lambda rows, seed, found=None: {"centres": [[0.0], [1.0]], "mean": found[0].tolist(), "axes": found[1].tolist()})
    rows = spark.range(40).select(F.timestamp_seconds("id").cast("timestamp_ntz").alias("ts"), F.array(F.col("id") * 1.0).alias("v"))
    baselines.run_all(rows, rows, seeds=(1, 2, 3))
    assert len(calls) == 1
    assert baselines.hmm_labels(rows, rows, seeds=(1, 2)).select("seed").distinct().count() == 2


def test_runs_are_dealt_to_partitions_of_their_own_and_train_in_single_precision(spark):
    from tidegrid.operators import branches

    x = np.random.default_rng(0).normal(size=(4, 6, 7))
    p, _ = encoder.train(x, epochs=1, depth=2, hidden=4, out=3)
    assert {v.dtype for v in p.values()} == {np.dtype(np.float32)}
    g, slope = encoder.gelu_with_slope(x)
    assert np.allclose(g, encoder.gelu(x)) and np.allclose(slope, (encoder.gelu(x + 1e-4) - encoder.gelu(x - 1e-4)) / 2e-4, atol=1e-2)
    assert np.allclose(encoder.crossed(x, x[..., :2]), np.einsum("btc,btd->cd", x, x[..., :2]))
    of = "named_struct(" + ", ".join(f"'{f}', array_repeat(id * 1D, 48)" for f in schema.FEATURES) + ")"
    windows = spark.range(8).selectExpr("'1h' AS tf", "id AS anchor", f"{of} AS x")
    runs = branches.train_branches(windows, seeds=(1, 2), epochs=1, depth=1, hidden=2, out=2)
    assert runs.rdd.getNumPartitions() == branches.TASKS


def test_a_fast_step_has_the_loss_and_slopes_of_the_plain_one():
    from tidegrid.functions import steps

    rng = np.random.default_rng(0)
    for batch, depth, first, second, common in ((3, 4, 14, 12, 9), (3, 4, 3, 4, 3), (1, 2, 16, 16, 16), (2, 5, 1, 1, 1), (2, 3, 5, 6, 2), (2, 0, 5, 6, 2)):
        p = {k: v.astype(np.float32) for k, v in encoder.init(7, depth, 6, 5, 1).items()}
        views = [rng.normal(size=(batch, n, 7)).astype(np.float32) for n in (first, second)]
        masks = [rng.random(v.shape[:2]) < 0.5 for v in views]
        plain = {k: v.astype(float) for k, v in p.items()}
        kept, got = ([], []), []
        for v, m, keep in zip(views, masks, kept, strict=True):
            got.append(encoder.forward(plain, v, m, keep))
        loss, d1, d2 = encoder.hierarchical_loss(got[0][:, -common:], got[1][:, :common])
        full = [np.zeros_like(g) for g in got]
        full[0][:, -common:], full[1][:, :common] = d1, d2
        one, two = (encoder.backward(plain, k, f) for k, f in zip(kept, full, strict=True))
        state = steps.Steps(p, 16, batch)
        x, show = (np.concatenate([a.swapaxes(0, 1) for a in both]) for both in (views, masks))
        for _ in range(2):  # nothing stays in the buffers
            assert abs(state.slopes(x, show, first, common) - loss) < 1e-5
            g = state.named(state.g)
            assert all(np.allclose(g[k], one[k] + two[k], atol=2e-5) for k in p)
        before = state.named(state.p)
        state.update(1e-3, 1e-2)
        for k, v in state.named(state.p).items():
            assert np.allclose(v, before[k] * (1 - 1e-5) - 1e-3 * g[k] / (np.abs(g[k]) + 1e-8), atol=1e-6)
            assert np.allclose(v, state.named(state.mean)[k], atol=1e-6)


def test_equal_windows_are_trained_once_and_have_a_run_each(spark):
    from tidegrid.operators import branches

    of = "named_struct(" + ", ".join(f"'{f}', transform(sequence(1, 6), k -> sin(k * (id + {j} + shift)))" for j, f in enumerate(schema.FEATURES)) + ")"
    tfs = "explode(map('15m', 0, '1h', 0, '4h', 1)) AS (tf, shift)"
    rows = spark.range(8).selectExpr("id", tfs).selectExpr("'s' AS symbol", "tf", "id AS anchor", f"{of} AS x")
    sets = {r.tf: r.digest for r in branches.training_sets(rows, 10, ("symbol",)).collect()}
    assert sets["15m"] == sets["1h"] != sets["4h"]
    how = {"keys": ("symbol",), "epochs": 2, "depth": 1, "hidden": 2, "out": 2}
    runs = branches.train_branches(rows, (1, 2), **how).cache()
    got = {(r.tf, r.seed): r for r in runs.collect()}
    assert len(got) == 6 and {r.status for r in got.values()} == {"done"}
    for seed in (1, 2):
        assert got["15m", seed].weights == got["1h", seed].weights != got["4h", seed].weights
        alone = branches.train_branches(rows.filter("tf = '1h'"), (seed,), **how).first()
        assert (alone.losses, alone.weights) == (got["1h", seed].losses, got["1h", seed].weights)
    left = branches.train_branches(rows, (1, 2), runs.filter("tf <> '15m'"), **how)
    assert {(r.tf, r.seed) for r in left.collect()} == {("15m", 1), ("15m", 2)}
    many = branches.train_branches(rows, (1,), most_rows=7, **how).collect()
    assert {(r.tf, r.status, r.error) for r in many} == {(tf, "failed", "8 windows; a run takes 7") for tf in ("15m", "1h", "4h")}


def test_windows_are_encoded_in_slices_and_in_single_precision(spark):
    from tidegrid.operators import branches

    of = "named_struct(" + ", ".join(f"'{f}', transform(sequence(1, 48), k -> CAST(sin(k * (id + {j})) AS FLOAT))" for j, f in enumerate(schema.FEATURES)) + ")"
    rows = spark.range(40).selectExpr("'s' AS symbol", "explode(array('1h', '4h')) AS tf", "id AS anchor", "'train' AS split", f"{of} AS x")
    models = {(tf, seed): encoder.init(7, 2, 6, 5, seed + len(tf) * (tf == "4h")) for tf in ("1h", "4h") for seed in (1, 2)}
    runs = spark.createDataFrame([("s", tf, seed, "done", encoder.to_bytes(p)) for (tf, seed), p in models.items()], "symbol string, tf string, seed int, status string, weights binary")
    got = branches.encode_windows(rows, runs, keys=("symbol",))
    assert got.rdd.getNumPartitions() == branches.TASKS
    x = branches.tensor(rows.filter("tf = '1h'").orderBy("anchor").toPandas().x)
    want = {k: encoder.pool(encoder.forward(p, x)) for k, p in models.items()}
    got = got.collect()
    assert len(got) == 160 == len({(r.tf, r.seed, r.anchor) for r in got})
    assert all(np.allclose(r.e, want[r.tf, r.seed][r.anchor], atol=1e-4) for r in got)
    p = {k: v.astype(np.float32) for k, v in models["1h", 1].items()}
    assert np.array_equal(encoder.encode(models["1h", 1], x), encoder.encode(p, x.astype(np.float32)))
