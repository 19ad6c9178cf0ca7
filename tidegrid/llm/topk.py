"""Exact top-k inner-product search by a three-phase uniform threshold.

A vector's dimensions are cut into ``lists`` contiguous parts; each part gives one score list per query (the partial inner
products), and a row's score is the sum over the lists.

1. Each block of rows gathers the heads of its local lists, with the totals of the rows on them.  The k-th best total over
   all blocks is a cutoff that the true k-th best score can't be below.
2. The cutoff goes back to the blocks with the queries.  A row whose every partial score is below ``cutoff / lists`` has a
   total below the cutoff, so the rows with at least one entry at or above that uniform threshold are sufficient.  A partial
   score is at most the product of the parts' norms, so rows whose norms stay below the threshold with every query of a
   chunk are left out before any of their scores is computed.
3. The remaining partial scores of just those rows are looked up and added exactly.

Rows and queries meet in a grid of bounded blocks; only k rows per query and block leave a task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_BLOCK, QUERIES_PER_BLOCK, CHUNK = 8192, 2048, 128
LONG = np.iinfo(np.int64)


def quantise(df: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, q array<long>) with q = floor(scale * x), x as double; rows without an id, a vector, or with a null or
    non-finite component are left out, and exact repeats of a row (before scaling) count once."""
    x = F.col(vector_col).cast("array<double>")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    q = F.transform(x, lambda v: F.floor(F.lit(float(scale)) * v))
    return df.filter(F.col(id_col).isNotNull() & x.isNotNull()).filter(fine).select(F.col(id_col).cast("long").alias("id"), x.alias("x"), q.alias("q")).dropDuplicates(["id", "x"]).drop("x")


def _matrix(rows: pd.Series, width: int) -> np.ndarray:
    """Rows as float64; shorter vectors end in zeros.  Whole numbers up to 2**53 are exact."""
    out = np.zeros((len(rows), width))
    for i, v in enumerate(rows):
        out[i, : len(v)] = v
    return out


def _parts(width: int, lists: int) -> list[slice]:
    edge = np.linspace(0, width, lists + 1).astype(int)
    return [slice(a, b) for a, b in zip(edge[:-1], edge[1:], strict=True)]


def _exact(q: pd.DataFrame, d: pd.DataFrame, qi: np.ndarray, di: np.ndarray) -> np.ndarray:
    """Totals in Python integers, for components too large for doubles; one outside the range of a long is an error."""
    a, b = list(q.q), list(d.q)
    return np.array([sum(int(x) * int(y) for x, y in zip(a[i], b[j], strict=False)) for i, j in zip(qi, di, strict=True)], dtype=np.int64)


def _best(qid, vid, score, k: int) -> pd.DataFrame:
    """Of each query its k best, ties to the smaller id."""
    order = np.lexsort((vid, -score.astype(object) if score.size and score.min() == LONG.min else -score, qid))
    qid, vid, score = qid[order], vid[order], score[order]
    first = np.searchsorted(qid, qid, side="left")
    keep = np.arange(len(qid)) - first < k
    return pd.DataFrame({"query_id": qid[keep], "vec_id": vid[keep], "score": score[keep]})


def _phase(k: int, lists: int, last: bool):
    def run(q: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="int64")})
        if q.empty or d.empty:
            return empty
        width = max(max(map(len, q.q)), max(map(len, d.q)))
        qm, dm = _matrix(q.q, width), _matrix(d.q, width)
        qid, vid = q.id.to_numpy("int64"), d.id.to_numpy("int64")
        safe = width == 0 or np.abs(qm).max(initial=0) * np.abs(dm).max(initial=0) * width < 2**53
        parts = _parts(width, lists)
        norms = [np.linalg.norm(dm[:, p], axis=1) for p in parts]
        out = []
        for at in range(0, len(q), CHUNK):
            own = slice(at, at + CHUNK)
            rows = np.arange(len(d))
            if last:
                cutoff = q.cutoff.to_numpy("float64")[own, None]  # null, where there are fewer than k rows, is NaN
                need = np.where(np.isnan(cutoff), -np.inf, cutoff) / lists
                need = need - np.abs(need) * 1e-9 - (0 if safe else 1)
                if need.min() > 0:
                    able = [norm * np.linalg.norm(qm[own, p], axis=1).max() * (1 + 1e-9) >= need.min() for p, norm in zip(parts, norms, strict=True)]
                    rows = np.flatnonzero(np.any(able, axis=0))
                    if not len(rows):
                        continue
            mine = qid[own, None] == vid[None, rows]
            partial = [qm[own, p] @ dm[rows, p].T for p in parts]
            if last:
                enough = np.zeros(mine.shape, bool)
                for p in partial:
                    enough |= p >= need
            else:
                enough = np.zeros(mine.shape, bool)
                for p in partial:
                    p = np.where(mine, -np.inf, p)
                    if p.shape[1] > k:
                        head = np.argpartition(-p, k - 1, axis=1)[:, :k]
                        enough[np.arange(len(p))[:, None], head] = True
                    else:
                        enough[:] = True
            qi, di = np.nonzero(enough & ~mine)
            if safe:
                total = sum(p[qi, di] for p in partial).astype(np.int64)
            else:
                total = _exact(q.iloc[own], d, qi, rows[di])
            if last and safe:
                at_least = total >= np.where(np.isnan(cutoff[qi, 0]), -np.inf, cutoff[qi, 0])
                qi, di, total = qi[at_least], di[at_least], total[at_least]
            out.append(_best(qid[own][qi], vid[rows[di]], total, k))
        return pd.concat(out, ignore_index=True) if out else empty

    return run


def top_k(rows: DataFrame, queries: DataFrame, k: int = 20, scale: int = 64, lists: int = 2, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest integer inner products over all other rows.

    Null, non-finite or missing vectors take no part; a query among them has no result rows.  Empty tables give no rows.
    Ties go to the smaller id.  Rows that repeat wholly count once; an id with several vectors keeps each, and never meets
    itself.  Vectors of unlike length compare as if the shorter ended in zeros.  Other columns are ignored.
    """
    d, q = quantise(rows, id_col, vector_col, scale), quantise(queries, id_col, vector_col, scale)
    n_d, n_q = (max(1, -(-x.count() // per)) for x, per in ((rows, ROWS_PER_BLOCK), (queries, QUERIES_PER_BLOCK)))
    block = lambda n: F.pmod(F.xxhash64("id", "q"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    d = d.select("id", "q", block(n_d).alias("db")).select("*", every(n_q).alias("qb"))
    schema = "query_id long, vec_id long, score long"

    def meet(asked: DataFrame, last: bool) -> DataFrame:
        asked = asked.withColumn("qb", block(n_q)).select("*", every(n_d).alias("db"))
        return asked.groupBy("db", "qb").cogroup(d.groupBy("db", "qb")).applyInPandas(_phase(k, lists, last), schema)

    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    heads = meet(q, False).withColumn("rank", rank).filter(F.col("rank") <= k)
    cutoff = heads.filter(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("cutoff"))
    return meet(q.join(cutoff, "id", "left"), True).withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
