"""Quality by supervised subword embeddings.

A document is the average of the learned vectors of its words, word pairs and character n-grams of two to four, all hashed into
one table; a softmax over the average gives the label's probability.  Table and softmax are fitted by stochastic gradient descent
in numpy, on a bounded sample of labelled documents.  For scoring, the product of the table with the softmax's weights is one
number a bucket, so a document's logit is the mean of its features' numbers: whole texts are scored without a Python loop over
words.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.textscan import mix, pieces, texts_of, word_bytes, words

BITS, DIM = 16, 8
AGAIN = 1
#: Most labelled documents that a model is fitted on.
MAX_TRAIN = 4000


@dataclass
class Model:
    table: np.ndarray  # [buckets, dim]
    weights: np.ndarray  # [dim, 2]
    bias: np.ndarray  # [2]

    def per_bucket(self) -> np.ndarray:
        return (self.table @ (self.weights[:, 1] - self.weights[:, 0])).astype(np.float32)

    def offset(self) -> float:
        return float(self.bias[1] - self.bias[0])


def features(data: np.ndarray, at: np.ndarray):
    """(buckets, first feature of each row and the end) for each kind of feature: words, pairs of words, in which a word that
    follows itself has one bucket for all words, then n-grams of 2, 3 and 4 characters.  None cross rows."""
    h, first, *_ = words(data, at, word_bytes("space"))
    yield (h >> np.uint64(64 - BITS)).astype(np.int32), first
    pair = mix(h[:-1] * np.uint64(3) + h[1:]) >> np.uint64(64 - BITS)
    pair = np.where(h[:-1] == h[1:], AGAIN, pair).astype(np.int32)
    inside = np.ones(len(pair), bool)
    inside[first[1:-1][(first[1:-1] > 0) & (first[1:-1] <= len(pair))] - 1] = False
    yield pair[inside], np.concatenate([[0], np.cumsum(np.maximum(0, np.diff(first) - 1))])
    part = data[at[0] : at[-1]]
    b = np.frombuffer(part.tobytes().decode().encode("utf-32-le"), np.uint32)  # characters
    rel = np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80)])[at - at[0]]
    lengths = np.diff(rel)
    gram = b
    for n in (2, 3, 4):
        gram = gram[:-1] * np.uint32(0x01000193) + b[n - 1 :] if len(gram) > 1 else gram[:0]
        bucket = ((gram * np.uint32(0x9E3779B1 + 2 * n)) >> np.uint32(32 - BITS)).astype(np.int32)
        keep = np.ones(len(bucket), bool)
        for back in range(1, n):  # those that would reach into the next row
            edge = rel[1:-1] - back
            keep[edge[(edge >= 0) & (edge < len(keep))]] = False
        yield bucket[keep], np.concatenate([[0], np.cumsum(np.maximum(0, lengths - n + 1))])


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the values of each row."""
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return total[first[1:]] - total[first[:-1]]


def logits(data: np.ndarray, at: np.ndarray, per_bucket: np.ndarray, offset: float) -> np.ndarray:
    total, count = np.zeros(len(at) - 1), np.zeros(len(at) - 1)
    for bucket, first in features(data, at):
        total += sums(per_bucket[bucket], first)
        count += np.diff(first)
    return total / np.maximum(count, 1) + offset


def bags(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(distinct buckets, shares) of each text."""
    out = []
    for t in texts:
        data, at = texts_of(pa.array([t], pa.string()))
        bucket, n = np.unique(np.concatenate([b for b, _ in features(data, at)]), return_counts=True)
        out.append((bucket, (n / max(1, n.sum())).astype(np.float64)))
    return out


def train(texts: list[str], labels: np.ndarray, epochs: int = 12, rate: float = 0.5, seed: int = 0) -> Model:
    """Stochastic gradient descent on the softmax loss, one document a step, with a falling rate.

    A table row moves by its share of the document, scaled up by the number of distinct features, as shares are small.
    """
    rng = np.random.default_rng(seed)
    table, weights, bias = rng.uniform(-1, 1, (1 << BITS, DIM)) / DIM, np.zeros((DIM, 2)), np.zeros(2)
    if len(labels):
        share = np.clip(np.bincount(labels, minlength=2) / len(labels), 1e-3, 1)
        bias = np.log(share)
    docs, steps, done = bags(texts), max(1, epochs * len(texts)), 0
    for _ in range(epochs):
        for k in rng.permutation(len(docs)):
            bucket, weight = docs[k]
            now = rate * (1 - done / steps)
            done += 1
            mean = weight @ table[bucket]
            z = mean @ weights + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[k]] -= 1
            back = weights @ p
            weights -= now * np.outer(mean, p) * 4
            bias -= now * 0.1 * p
            table[bucket] -= (now * 25) * weight[:, None] * back[None, :]
    return Model(table, weights, bias)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(row struct, score) of every row, from its whole text.  Null and empty texts have no features and get the score of the
    bias alone.  ``row`` holds all columns, or those to keep; nothing is shuffled, repeated rows each keep a row."""
    sent = docs.sparkSession.sparkContext.broadcast((model.per_bucket(), model.offset()))
    row = F.struct(*[docs[c] for c in keep or docs.columns])
    kind = docs.select(row.alias("row")).schema["row"].dataType.simpleString()

    def run(batches):
        per_bucket, offset = sent.value
        for batch in batches:
            data, at = texts_of(batch.column(1))
            out = np.zeros(batch.num_rows)
            for lo, hi in pieces(at):
                out[lo:hi] = logits(data, at[lo : hi + 1], per_bucket, offset)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(out, -30, 30))))], names=["row", "score"])

    return docs.select(row.alias("row"), docs[text_col].cast("string").alias("text")).mapInArrow(run, f"row {kind}, score double")
