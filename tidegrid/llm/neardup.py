"""Near duplicates by HyperMinHash registers, banding, corrected estimates and exact confirmation.

A document is the set of its distinct word shingles.  Documents with equal sets make one class, and the classes are compared.

*Registers.*  Elements (shingle, round) are hashed; the high bits deal them to buckets, and a bucket's register keeps, of its
smallest value, the count of leading zeros and a mantissa.  A set of n shingles goes through enough rounds for 2048 elements
or more, so that no bucket stays empty by chance; rounds leave the Jaccard similarity as it is.  The number of rounds depends
on the size's power of two, and sets within a quarter above a power also get the registers of the class below: two sets with
similarity 0.8 or more always share a class, as their sizes differ by a quarter at most.

*Bands.*  32 bands of 4 registers: a pair at 0.8 shares none with a probability of (1 - 0.8**4)**32 = 5e-8.

*Links without all pairs.*  In each bucket the members are compared with one leader.  Candidates whose collision-corrected
estimate is more than six standard errors below the limit go; the others are confirmed on their full sets.  Confirmed links
make components; a bucket whose members are in one component needs nothing more.  What shares a bucket and is still apart
makes families, whose members are compared in full, estimate first, in blocks of bounded size that give only links that join.

*Large buckets.*  A bucket or leader with more than a two-thousandth of all entries is joined by broadcast, of which only ids
and registers are sent; a leader's full set is copied once for each such part of its pairs, which are salted.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.common import HOT_PARTS, join_hot, release, stored
from tidegrid.llm.graph import components
from tidegrid.llm.textscan import mix, pieces, texts_of, word_bytes, words

BUCKETS, BUCKET_BITS, MANTISSA, WIDTH = 128, 7, 10, 47
BAND, ELEMENT_BITS, EMPTY = 4, 11, 0xFFFF
BLOCK, BLOCK_SHINGLES = 1000, 2_000_000


def shingle_sets(data: np.ndarray, at: np.ndarray, k: int):
    """Each row's sorted distinct shingle hashes; fewer than k words make one shingle, none make an empty set."""
    h, first, *_ = words(data, at, word_bytes("space"))
    n = len(h)
    total = np.zeros(max(0, n - k + 1), np.uint64)
    for j in range(k):
        total = total * np.uint64(0xD6E8FEB86659FD93) + h[j : j + len(total)]
    total = mix(total)
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= k:
            yield np.unique(total[a : b - k + 1])
        elif b > a:
            yield np.frombuffer(hashlib.blake2b(h[a:b].tobytes(), digest_size=8).digest(), np.uint64)
        else:
            yield np.zeros(0, np.uint64)


def size_classes(n: int) -> list[int]:
    """The class of a size, and the one below where a pair at 0.8 may need it."""
    c = min(n.bit_length() - 1, ELEMENT_BITS)
    return [c, c - 1] if 0 < c and n * 4 <= 5 << c else [c]


_SEEDS = mix(np.arange(1, (1 << ELEMENT_BITS) + 1, dtype=np.uint64) << np.uint64(20))


def registers(s: np.ndarray, size_class: int) -> np.ndarray:
    """BUCKETS registers of 16 bits: leading zeros, then the mantissa."""
    e = np.sort(mix((s[None, :] ^ _SEEDS[: 1 << (ELEMENT_BITS - size_class), None]).ravel()))
    lowest = np.searchsorted(e, np.arange(BUCKETS, dtype=np.uint64) << np.uint64(64 - BUCKET_BITS))
    there = np.minimum(lowest, len(e) - 1)
    full = (lowest < len(e)) & (e[there] >> np.uint64(64 - BUCKET_BITS) == np.arange(BUCKETS, dtype=np.uint64))
    v = (e[there] << np.uint64(BUCKET_BITS)) >> np.uint64(64 - WIDTH)
    bits = np.frexp(v.astype(np.float64))[1]
    zeros = (WIDTH - bits).astype(np.uint64)
    mantissa = ((v << (zeros + np.uint64(64 - WIDTH + 1))) >> np.uint64(64 - MANTISSA)) * (bits > 0)
    return np.where(full, (zeros << np.uint64(MANTISSA)) | mantissa, EMPTY).astype(np.uint16)


def band_keys(regs: np.ndarray, size_class: int) -> np.ndarray:
    """A 64-bit key for each band of BAND registers."""
    r = regs.reshape(-1, BAND).astype(np.uint64)
    key = np.full(len(r), size_class, np.uint64) * np.uint64(1009) + np.arange(len(r), dtype=np.uint64)
    for j in range(BAND):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + r[:, j] + np.uint64(1))
    return key.view(np.int64)


def chance(a: float, b: float) -> float:
    """Probability that registers with a and b elements in a bucket are equal though their smallest values differ."""
    k = np.arange(WIDTH + 1)
    p = lambda x: np.exp(-x * 2.0 ** -(k + 1)) - np.exp(-x * 2.0**-k)
    return float((p(a) * p(b)).sum() / (1 << MANTISSA))


def estimate(x: np.ndarray, y: np.ndarray, p: float) -> np.ndarray:
    """Similarity from equal registers, corrected for those equal by chance."""
    some = np.maximum(((x != EMPTY) | (y != EMPTY)).sum(-1), 1)
    same = ((x == y) & (x != EMPTY)).sum(-1)
    return (same / some - p) / (1 - p)


def sketch(docs: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, digest, n, node, regs, low): the text's digest, the set's size and 16-byte digest (null if empty), and registers of
    the size's classes."""

    def run(batches):
        release()
        for batch in batches:
            data, at = texts_of(batch.column(1))
            rows = []
            for lo, hi in pieces(at):
                for s in shingle_sets(data, at[lo : hi + 1], k):
                    if len(s):
                        regs = [registers(s, c).tobytes() for c in size_classes(len(s))]
                        rows.append((len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), regs[0], regs[1] if len(regs) > 1 else None))
                    else:
                        rows.append((0, None, None, None))
            n, node, regs, low = zip(*rows, strict=True) if rows else ((),) * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(node, pa.binary()), pa.array(regs, pa.binary()), pa.array(low, pa.binary())], names=["doc_id", "digest", "n", "node", "regs", "low"])

    text = docs[text_col].cast("string")
    return docs.select(docs[id_col].cast("long").alias("doc_id"), text.alias("text"), F.md5(text).alias("digest")).mapInArrow(run, "doc_id long, digest string, n long, node binary, regs binary, low binary")


def bands(classes: DataFrame) -> DataFrame:
    """(band, node) of every class."""

    def run(batches):
        for batch in batches:
            nodes, keys = [], []
            for n, node, regs, low in zip(*(batch.column(c).to_pylist() for c in ("n", "node", "regs", "low")), strict=True):
                for c, r in zip(size_classes(n), (regs, low), strict=False):
                    keys.append(band_keys(np.frombuffer(r, np.uint16), c))
                    nodes += [node] * len(keys[-1])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64)), pa.array(nodes, pa.binary())], names=["band", "node"])

    return classes.select("n", "node", "regs", "low").mapInArrow(run, "band long, node binary")


def _common(na: int, ra: bytes, la: bytes | None, nb: int, rb: bytes, lb: bytes | None) -> float:
    """Corrected estimate from a class that both sizes have; 0 if there is none."""
    a, b = dict(zip(size_classes(na), (ra, la), strict=False)), dict(zip(size_classes(nb), (rb, lb), strict=False))
    for c in a.keys() & b.keys():
        per = (1 << (ELEMENT_BITS - c)) / BUCKETS
        return float(estimate(np.frombuffer(a[c], np.uint16), np.frombuffer(b[c], np.uint16), chance(na * per, nb * per)))
    return 0.0


def likely(pairs: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """Of distinct pairs (a, b), of which an ``a`` may have very many: those whose sizes and estimate allow the limit."""
    side = lambda c: classes.select(F.col("node").alias(c), *[F.col(x).alias(x + c) for x in ("n", "regs", "low")])
    cols = [x + c for c in "ab" for x in ("n", "regs", "low")]

    def run(batches):
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in cols), strict=True)
            keep = pa.array([_common(*r) >= least for r in rows], pa.bool_())
            yield batch.select(["a", "b"]).filter(keep)

    first = stored(pairs.groupBy("a").agg(F.count("*").alias("m")).join(side("a"), "a"))
    return join_hot(pairs, first, ["a"], "m", pairs.count()).join(side("b"), "b").select("a", "b", *cols).mapInArrow(run, "a binary, b binary")


def full_sets(nodes: DataFrame, classes: DataFrame, docs: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """(node, s): the shingles of each node, made anew from the text of one document of its class."""
    wanted = classes.join(nodes, "node", "left_semi").select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"), F.col("node").alias("_node"))
    text = docs[text_col].cast("string")
    texts = docs.select(docs[id_col].cast("long").alias("doc_id"), text.alias("text"), F.md5(text).alias("digest")).join(wanted, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")))

    def sets(batches):
        for batch in batches:
            data, at = texts_of(batch.column(1))
            found = [s for lo, hi in pieces(at) for s in shingle_sets(data, at[lo : hi + 1], k)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in found], pa.binary())], names=["node", "s"])

    return texts.select("_node", "text").mapInArrow(sets, "node binary, s binary").dropDuplicates(["node"])


def confirm(pairs: DataFrame, classes: DataFrame, docs: DataFrame, k: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """Of pairs (a, b): those with 100 * intersection >= percent * union, on the full sets, which are made anew from one
    document of each class."""
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    full = stored(full_sets(nodes, classes, docs, k, id_col, text_col))

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    least = pairs.count() // HOT_PARTS + 1
    hot = F.broadcast(stored(pairs.groupBy("a").agg(F.ceil(F.count("*") / F.lit(least)).cast("int").alias("salts")).filter("salts > 1")))  # fewer than HOT_PARTS rows
    salts = F.coalesce("salts", F.lit(1))
    dealt = pairs.join(hot, "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), salts).cast("int").alias("salt"))
    first = full.select(F.col("node").alias("a"), F.col("s").alias("sa")).join(hot, "a", "left").select("a", "sa", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    return dealt.join(first, ["a", "salt"]).join(full.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b").select("a", "b", "sa", "sb").mapInArrow(run, "a binary, b binary")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _in_blocks(members: DataFrame, classes: DataFrame, least: float, docs: DataFrame, k: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """Confirmed links (a, b) that join what is still apart: all pairs of each family, which holds everything that shares a
    bucket, compared in blocks of bounded size.  A task holds the registers and sets of two blocks, and gives a link only if
    its ends aren't connected yet, so fewer links than rows leave it."""
    stars = stored(members.filter("lead <> node").select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct())
    families = components(stars).withColumnRenamed("label", "family")
    nodes = stored(members.select("node", "label").distinct().join(families, "node").join(classes.select("node", "n", "regs", "low"), "node"))
    sizes = nodes.groupBy("family").agg(F.ceil(F.greatest(F.count("*") / F.lit(BLOCK), F.sum("n") / F.lit(BLOCK_SHINGLES))).cast("int").alias("blocks"))
    rows = nodes.join(full_sets(nodes.select("node"), classes, docs, k, id_col, text_col), "node").join(sizes, "family")
    rows = rows.withColumn("mine", F.pmod(F.xxhash64("node", F.lit(5)), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumn("x", F.least("mine", "other")).withColumn("y", F.greatest("mine", "other"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("node").reset_index(drop=True)
        sets = [np.frombuffer(s, np.uint64) for s in pdf.s]
        _, ids = np.unique(np.concatenate(sets), return_inverse=True)
        at = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
        n, label = np.diff(at), np.unique(pdf.label, return_inverse=True)[1]
        cls = [dict(zip(size_classes(int(m)), (r, w), strict=False)) for m, r, w in zip(pdf.n, pdf.regs, pdf.low, strict=True)]
        left, right = np.flatnonzero(pdf.mine == pdf.x), np.flatnonzero(pdf.mine == pdf.y)
        regs, has = {}, {}
        for c in {c for d in cls for c in d}:
            has[c] = np.array([c in d for d in cls])
            regs[c] = np.stack([np.frombuffer(d[c], np.uint16) if c in d else np.zeros(BUCKETS, np.uint16) for d in cls])
        got, mark = [], np.zeros(ids.max(initial=0) + 1, bool)
        for i in left:
            apart = right[(label[right] != label[i]) & (np.minimum(n[right], n[i]) * 5 >= np.maximum(n[right], n[i]) * 4)]
            fine = np.zeros(len(apart), bool)
            for c in cls[i]:
                per = (1 << (ELEMENT_BITS - c)) / BUCKETS
                fine |= has[c][apart] & (estimate(regs[c][i][None, :], regs[c][apart], chance(n[i] * per, n[i] * per)) >= least)
            apart = apart[fine]
            if not len(apart):
                continue
            mark[ids[at[i] : at[i + 1]]] = True
            both = np.array([np.count_nonzero(mark[ids[at[j] : at[j + 1]]]) for j in apart])
            mark[ids[at[i] : at[i + 1]]] = False
            for j in apart[100 * both >= percent * (n[i] + n[apart] - both)]:
                if label[j] != label[i]:
                    got.append((pdf.node[i], pdf.node[j]))
                    label[label == label[j]] = label[i]
        return pd.DataFrame(got, columns=["a", "b"])

    return _ordered(rows.groupBy("family", "x", "y").applyInPandas(run, "a binary, b binary"))


def _linked(docs: DataFrame, k: int, percent: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The sketched rows, their classes of equal sets, and (node, label) of the classes that have links."""
    assert percent >= 80, "size classes and bands are made for similarities of 0.8 and more"
    least = percent / 100 - 0.23  # six standard errors of an estimate from 128 registers
    rows = stored(sketch(docs, k, id_col, text_col))
    full = rows.filter(F.col("node").isNotNull())
    own = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "digest"))
    classes = full.groupBy("node").agg(own.alias("own"), F.count("*").alias("rows"), F.first("n").alias("n"), F.first("regs").alias("regs"), F.first("low").alias("low"))
    classes = stored(classes.select("node", "own.doc_id", "own.digest", "rows", "n", "regs", "low"))
    entries = stored(bands(classes))
    buckets = stored(entries.groupBy("band").agg(F.count("*").alias("m"), F.min_by("node", F.xxhash64("node")).alias("lead")).filter("m > 1"))
    members = stored(join_hot(entries, buckets, ["band"], "m", entries.count()).select("band", "node", "lead"))

    met = stored(members.filter("lead <> node").select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct())
    links = stored(_ordered(confirm(stored(likely(met, classes, least)), classes, docs, k, percent, id_col, text_col)))
    found = components(links)
    labelled = stored(members.join(found, "node", "left").select("band", "node", "lead", F.coalesce("label", "node").alias("label")))
    mixed = labelled.groupBy("band").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("m")).filter("lo <> hi and m > 2")
    apart = stored(join_hot(labelled, stored(mixed.select("band", "m")), ["band"], "m", labelled.count()))
    if not apart.isEmpty():
        found = components(links.unionByName(_in_blocks(apart, classes, least, docs, k, percent, id_col, text_col)))
    return rows, classes, found


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row for each row of ``docs``.

    Words are runs without ASCII white space, A-Z in lower case.  Links are pairs with 100 * intersection >= percent * union
    of shingle sets (percent at least 80); ``component_id`` is the smallest doc_id reachable over links.  Texts that are null
    or without words have an empty set and no links.  Rows with equal sets, repeated rows too, are in one component.  A null
    id is never kept unless alone with null ids.  Empty tables give no rows; other columns are ignored.
    """
    rows, classes, found = _linked(docs, k, percent, id_col, text_col)
    lowest = classes.join(found, "node").groupBy("label").agg(F.min("doc_id").alias("least_id"))
    names = found.join(lowest, "label").select("node", "least_id")
    ids = stored(classes.join(names, "node", "left").select("node", "rows", F.coalesce("least_id", "doc_id").alias("component_id")))
    own = rows.filter(F.col("node").isNull()).select("doc_id", "n", F.col("doc_id").alias("component_id"))
    out = join_hot(rows.filter(F.col("node").isNotNull()), ids, ["node"], "rows", rows.count()).select("doc_id", "n", "component_id").unionByName(own)
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of near duplicates, exact copies too; texts without words all stay.

    The decision is one on (id, text): the smallest id stays, any id before none, and of its texts that of the smallest digest.
    Of rows that share both, the one of the smallest hash over all columns stays.
    """
    rows, classes, found = _linked(docs, k, percent, id_col, text_col)
    own = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "digest")
    first = classes.select("node", "rows", own.alias("first"))
    least = first.join(found, "node").groupBy("label").agg(F.min("first").alias("least"))
    stays = stored(first.join(found.join(least, "label").select("node", "least"), "node", "left").select("node", "rows", F.coalesce("least", "first").alias("stays")))
    total, rows = rows.count(), rows.filter(F.col("node").isNotNull()).select("node", own.alias("own"))
    gone = join_hot(rows, stays, ["node"], "rows", total).filter(~F.col("own").eqNullSafe(F.col("stays"))).select("own").distinct()
    many = stored(rows.groupBy("own").count().filter("count > 1").select("own"))
    at = lambda d: d.select(F.col("own.doc_id").alias("_i"), F.col("own.digest").alias("_d"))
    same = docs[id_col].cast("long").eqNullSafe(F.col("_i")) & F.md5(docs[text_col].cast("string")).eqNullSafe(F.col("_d"))
    kept = docs.join(at(gone), same, "left_anti")
    if many.isEmpty():
        return kept
    one = kept.join(at(many), same).groupBy("_i", "_d").agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("_row"))
    return kept.join(at(many), same, "left_anti").unionByName(one.select("_row.*"))
