"""Economic and non-parametric statistics over labelled rows and repeated runs."""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.operators.temporal import epoch

#: Parts of a ranking over all rows.
RANK_PARTS = 256
STARS = ((0.001, "***"), (0.01, "**"), (0.05, "*"))


def cluster_moments(rows: DataFrame, value: str, label: str = "label") -> DataFrame:
    """(label, n, mean, std, skew): skewness adjusted for bias; null with too few or constant values."""
    n = F.count(value)
    skew = F.when(n > 2, F.skewness(value) * F.sqrt(n * (n - 1.0)) / (n - 2.0))
    return rows.filter(F.col(label) != -1).groupBy(label).agg(n.alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), skew.alias("skew"))


def average_ranks(rows: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """``rows`` with ``rank`` and ``ties``.  Values are counted first, so ranks come from running sums over distinct values and
    a very common value is one row of that pass."""
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("ties"))
    upto = lambda w: F.sum("ties").over(w.rowsBetween(Window.unboundedPreceding, 0))
    middle = (F.col("ties") - 1) / 2
    if keys:
        ranks = counts.withColumn("rank", upto(Window.partitionBy(*keys).orderBy(value)) - middle)
        return rows.join(ranks, [*keys, value])
    # Without keys no window may hold all values: they are put in parts by quantiles, and each part adds the rows below it.
    cuts = sorted(set(counts.approxQuantile(value, [k / RANK_PARTS for k in range(1, RANK_PARTS)], 1 / (4 * RANK_PARTS))))
    part = F.size(F.filter(F.lit(cuts).cast("array<double>"), lambda c: c < F.col(value)))
    counts = counts.withColumn("_part", part)
    sums = counts.groupBy("_part").agg(F.sum("ties").alias("n"))  # at most RANK_PARTS rows
    below = sums.select("_part", (F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("_below"))
    ranks = counts.withColumn("rank", upto(Window.partitionBy("_part").orderBy(value)) - middle)
    ranks = ranks.join(F.broadcast(below), "_part").withColumn("rank", F.col("rank") + F.col("_below")).drop("_part", "_below")
    return rows.join(ranks, value)


def chi2_tail(x: float, df: int) -> float:
    """Upper tail of the chi-square distribution, by the incomplete gamma function's series or continued fraction."""
    if x <= 0:
        return 1.0
    a, z = df / 2, x / 2
    front = math.exp(-z + a * math.log(z) - math.lgamma(a))
    if z < a + 1:
        term = total = 1 / a
        k = a
        while term > total * 1e-16:
            k += 1
            term *= z / k
            total += term
        return max(0.0, 1 - total * front)
    b = z + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return front * h


def kruskal_wallis(rows: DataFrame, value: str, label: str = "label", keys: Sequence[str] = ()) -> DataFrame:
    """(keys, h, df, n): the statistic with its correction for ties; noise takes no part.  ``kruskal_p`` adds the tail."""
    ranked = average_ranks(rows.filter(F.col(label) != -1), value, keys)
    groups = ranked.groupBy(*keys, label).agg(F.sum("rank").alias("r"), F.count("*").alias("n"))
    total = groups.groupBy(*keys).agg(F.sum(F.col("r") ** 2 / F.col("n")).alias("q"), F.sum("n").alias("n"), F.count("*").alias("k"))
    ties = ranked.groupBy(*keys, value).agg(F.count("*").cast("double").alias("t")).groupBy(*keys).agg(F.sum(F.col("t") ** 3 - F.col("t")).alias("t"))
    both = total.join(ties, list(keys)) if keys else total.join(F.broadcast(ties))
    n = F.col("n").cast("double")
    h = (12 / (n * (n + 1)) * F.col("q") - 3 * (n + 1)) / (1 - F.col("t") / (n**3 - n))
    return both.select(*keys, h.alias("h"), (F.col("k") - 1).cast("int").alias("df"), "n")


def kruskal_p(found: DataFrame) -> DataFrame:
    """The result of ``kruskal_wallis`` with ``p``; a few rows, one for each condition."""
    rows = [(*r, float(chi2_tail(r.h, r.df))) for r in found.collect()]
    return found.sparkSession.createDataFrame(rows, found.schema.add("p", "double"))


def signed_ranks(runs: DataFrame, metric: str, against: str = "1TF", condition: str = "condition", seed: str = "seed") -> DataFrame:
    """(condition, n, w_plus, w_minus): differences to the baseline paired by seed, zeros left out, average ranks."""
    base = runs.filter(F.col(condition) == against).select(seed, F.col(metric).alias("_b"))
    d = runs.filter(F.col(condition) != against).join(base, seed).select(condition, seed, (F.col(metric) - F.col("_b")).alias("d")).filter("d <> 0").withColumn("size", F.round(F.abs("d"), 12))
    ranked = average_ranks(d, "size", (condition,))
    return ranked.groupBy(condition).agg(F.count("*").alias("n"), F.sum(F.when(F.col("d") > 0, F.col("rank")).otherwise(0.0)).alias("w_plus"), F.sum(F.when(F.col("d") < 0, F.col("rank")).otherwise(0.0)).alias("w_minus"))


def wilcoxon_p(n: int, w_plus: float) -> float:
    """One-sided exact probability of a sum of positive ranks of w_plus or more, over all signs."""
    counts = {0: 1}
    for r in range(1, n + 1):
        nxt = dict(counts)
        for s, c in counts.items():
            nxt[s + r] = nxt.get(s + r, 0) + c
        counts = nxt
    return sum(c for s, c in counts.items() if s >= w_plus - 1e-9) / 2**n


def wilcoxon(runs: DataFrame, metric: str, against: str = "1TF") -> DataFrame:
    """(condition, n, w_plus, w_minus, rank_biserial, p, min_attainable_p), one row for each condition."""
    found = signed_ranks(runs, metric, against).withColumn("rank_biserial", (F.col("w_plus") - F.col("w_minus")) / (F.col("n") * (F.col("n") + 1) / 2))
    rows = [(*r, wilcoxon_p(r.n, r.w_plus), 0.5**r.n) for r in found.collect()]
    return found.sparkSession.createDataFrame(rows, found.schema.add("p", "double").add("min_attainable_p", "double"))


def holm(tests: DataFrame, p: str = "p", key: str = "condition") -> DataFrame:
    """``tests`` with ``p_holm``: step-down correction over all of its rows, which are a handful."""
    order = Window.partitionBy(F.lit(0)).orderBy(p, key)
    m = F.count("*").over(Window.partitionBy(F.lit(0)))
    stepped = tests.withColumn("_x", F.col(p) * (m - F.row_number().over(order) + 1))
    return stepped.withColumn("p_holm", F.least(F.lit(1.0), F.max("_x").over(order.rowsBetween(Window.unboundedPreceding, 0)))).drop("_x")


def over_seeds(runs: DataFrame, metrics: Sequence[str], by: Sequence[str] = ("condition",)) -> DataFrame:
    """(by, mean and std of each metric)."""
    return runs.groupBy(*by).agg(*[f(m).alias(f"{m}_{name}") for m in metrics for f, name in ((F.avg, "mean"), (F.stddev_samp, "std"))])


def stars(p: Column) -> Column:
    out = F.lit("")
    for limit, mark in reversed(STARS):
        out = F.when(p < limit, mark).otherwise(out)
    return out


def ablation_table(runs: DataFrame, tests: DataFrame, metric: str) -> DataFrame:
    """(condition, mean_std, p_text, stars): a report as text, with p to three decimals."""
    m = over_seeds(runs, [metric])
    text = F.concat(F.format_number(f"{metric}_mean", 3), F.lit(" ± "), F.format_number(F.coalesce(f"{metric}_std", F.lit(0.0)), 3))
    return m.join(tests, "condition", "left").select("condition", text.alias("mean_std"), F.format_number("p_holm", 3).alias("p_text"), F.coalesce(stars(F.col("p_holm")), F.lit("")).alias("stars"))


def scale_correlation(rows: DataFrame, x: str, y: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, pearson, spearman) of two columns; rows with a null take no part."""
    rows = rows.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, x, y)
    ranked = average_ranks(rows, x, keys).withColumnRenamed("rank", "_rx").drop("ties")
    ranked = average_ranks(ranked, y, keys).withColumnRenamed("rank", "_ry")
    return ranked.groupBy(*keys).agg(F.corr(x, y).alias("pearson"), F.corr("_rx", "_ry").alias("spearman"))


def runs_of(rows: DataFrame, label: str = "label", keys: Sequence[str] = ("symbol",), order: str = "ts") -> DataFrame:
    """(keys, label, start, end, n): maximal stretches of one label in time order."""
    w = Window.partitionBy(*keys).orderBy(order)
    new = F.coalesce((~F.lag(label).over(w).eqNullSafe(F.col(label))).cast("int"), F.lit(1))
    marked = rows.withColumn("_new", F.when(F.row_number().over(w) == 1, 1).otherwise(new))
    marked = marked.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "_run", label).agg(F.min(order).alias("start"), F.max(order).alias("end"), F.count("*").alias("n")).drop("_run")


def persistence(rows: DataFrame, label: str = "label", keys: Sequence[str] = ("symbol",), order: str = "ts") -> DataFrame:
    """(keys, label, runs, mean_run, longest): how long labels last, and in how many stretches each comes."""
    return runs_of(rows, label, keys, order).groupBy(*keys, label).agg(F.count("*").alias("runs"), F.avg("n").alias("mean_run"), F.max("n").alias("longest"))


def neighbour_gaps(found: DataFrame, times: DataFrame, id_col: str = "id", ts: str = "ts", step: int = 3600) -> DataFrame:
    """(median_gap, within_5, within_1) of steps between queries and their neighbours."""
    t = times.select(F.col(id_col).alias("id"), epoch(ts).alias("t"))
    gap = found.join(t, "id").join(t.select(F.col("id").alias("query_id"), F.col("t").alias("tq")), "query_id").select((F.abs(F.col("t") - F.col("tq")) / step).alias("g"))
    return gap.agg(F.percentile("g", 0.5).alias("median_gap"), F.avg((F.col("g") <= 5).cast("double")).alias("within_5"), F.avg((F.col("g") <= 1).cast("double")).alias("within_1"))


def ridge_probe(train: DataFrame, test: DataFrame, inputs: Sequence[str], target: str, alpha: float = 1.0) -> dict[str, float]:
    """R2 and mean absolute error on ``test`` of a ridge fit on standardised inputs of ``train``; only sums leave the tasks."""
    import numpy as np

    d = len(inputs)
    full = [*inputs, target]
    clean = lambda df: df.dropna(subset=full)
    pairs = [(i, j) for i, j in itertools.combinations_with_replacement(range(d + 1), 2)]
    row = clean(train).agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(full)], *[F.covar_pop(full[i], full[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    cov = np.zeros((d + 1, d + 1))
    for i, j in pairs:
        cov[i, j] = cov[j, i] = row[f"c{i}_{j}"]
    mean, scale = np.array([row[f"m{i}"] for i in range(d + 1)]), np.sqrt(np.maximum(np.diag(cov)[:d], 1e-300))
    z = cov[:d, :d] / np.outer(scale, scale)
    beta = np.linalg.solve(z * row.n + alpha * np.eye(d), row.n * cov[:d, d] / scale) / scale
    guess = F.lit(float(mean[d] - beta @ mean[:d]))
    for c, b in zip(inputs, beta, strict=True):
        guess = guess + F.col(c) * float(b)
    e = F.col(target) - guess
    got = clean(test).agg(F.sum(e * e).alias("sse"), F.var_pop(target).alias("v"), F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae")).first()
    return {"r2": 1 - got.sse / (got.v * got.n), "mae": got.mae}
