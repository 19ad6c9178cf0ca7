"""Toxicity by a subsequence string kernel, Nyström landmarks and a linear support vector machine over sentences.

Tokens are compared by the gap-weighted subsequence kernel: common subsequences of three characters, each weighed by a decay
to the power of the stretch it takes in either string, normalised to 1 for equal strings.  Characters put inside a word, or a
few left out, lower the value only a little.  Letters that stand alone in a row are read as one word as well.  Landmarks are
the tokens and beginnings of tokens that tell the labels apart best, counted over texts that aren't copies of each other, and
the harmless tokens nearest to those.  A sentence's kernel with a landmark is its best token's, values under a floor counting
as none; the Nyström map whitens these by the landmarks' own kernel matrix.  The machine is trained on sentences, with
multiple-instance labels: a toxic document's most toxic sentence is its positive.  A document's score is a logistic function
of its worst sentence's margin, of how many sentences are on the toxic side and of their share in the document's words.

Texts are cut into tokens by numpy; only a token that a worker hasn't met becomes a Python string.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.llm.common import slot
from tidegrid.llm.textscan import mix, pieces, runs, texts_of, word_bytes, words

DECAY, ORDER, LONGEST = 0.8, 3, 40
FLOOR = 0.5
POSITIVE, STEMS, NEGATIVE = 64, 24, 32
#: A landmark's label is more than chance: log of the binomial probability of its toxic documents.
CHANCE = -11.5
#: Most labelled documents that a model is fitted on, and most bytes of their texts.
MAX_TRAIN, MAX_TRAIN_BYTES = 4000, 64 << 20
EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
_SPACE, _LETTER = word_bytes("space"), word_bytes("alnum")
_STOP = np.isin(np.arange(256), list(b".!?"))
_BETWEEN = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r.-_*"))


def codes(words: list[str], width: int) -> np.ndarray:
    """Characters as numbers, 0 after the end.  Longer words are handled in overlapping windows by the caller."""
    return np.array(words, f"U{width}").view(np.int32).reshape(len(words), width) if words else np.zeros((0, width), np.int32)


def raw_kernel(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Subsequence kernel of each row of x (codes) with the same row of y: the usual recursion over prefixes of both."""
    n, a = x.shape
    b = y.shape[1]
    same = (x[:, :, None] == y[:, None, :]) & (x[:, :, None] > 0)
    same = np.ascontiguousarray(same.transpose(1, 2, 0).astype(np.float32)) * np.float32(DECAY * DECAY)
    lam = np.float32(DECAY)
    prime = np.ones((a + 1, b + 1, n), np.float32)
    for _ in range(1, ORDER):
        nxt = np.zeros_like(prime)
        for i in range(1, a + 1):
            met = same[i - 1] * prime[i - 1, :-1]
            run = np.zeros(n, np.float32)
            for j in range(1, b + 1):
                run = lam * run + met[j - 1]
                nxt[i, j] = run
            nxt[i] += lam * nxt[i - 1]
        prime = nxt
    return (same * prime[:-1, :-1]).sum(axis=(0, 1))


def self_kernel(words: list[str]) -> np.ndarray:
    x = codes(words, max([ORDER, *map(len, words)]))
    return np.sqrt(np.maximum(raw_kernel(x, x), 1e-9))


class Kernel:
    """Normalised kernel of tokens with fixed landmarks."""

    def __init__(self, landmarks: list[str]):
        self.landmarks = landmarks
        self.codes = codes(landmarks, max([ORDER, *map(len, landmarks)]))
        self.norm = self_kernel(landmarks) if landmarks else np.zeros(0)
        letters = sorted({c for w in landmarks for c in w})
        self.letter = np.zeros(max([128, *(ord(c) + 2 for c in letters)]), np.int32)
        self.letter[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.base = len(letters) + 1
        own = [{(a, b) for a, b in zip(w, w[1:], strict=False)} for w in landmarks]
        pairs = sorted(set().union(*own)) if own else []
        self.pair = np.full(self.base * self.base, -1, np.int32)
        for k, (a, b) in enumerate(pairs):
            self.pair[self.letter[ord(a)] * self.base + self.letter[ord(b)]] = k
        holders = [[k for k, o in enumerate(own) if p in o] for p in pairs]
        self.first = np.concatenate([[0], np.cumsum([len(h) for h in holders])]).astype(np.int64)
        self.holder = np.array([k for h in holders for k in h], np.int64)
        self.need = np.array([(len(o) + 1) // 2 for o in own], np.int64)

    def near(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, landmark): the landmarks of whose letter pairs a row of codes has half, with up to one character put between;
        the kernel with others counts as none."""
        at = self.letter[np.minimum(x, len(self.letter) - 1)]
        found = []
        for gap in (1, 2):
            a, b = at[:, :-gap], at[:, gap:]
            k = self.pair[a * self.base + b]
            row, col = np.nonzero((a > 0) & (b > 0) & (k >= 0))
            found.append(row * np.int64(len(self.first)) + k[row, col])
        key = np.unique(np.concatenate(found))
        row, k = key // len(self.first), key % len(self.first)
        n = self.first[k + 1] - self.first[k]
        into = np.repeat(self.first[k] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(k) else np.zeros(0, np.int64)
        count = np.bincount(np.repeat(row, n) * len(self.landmarks) + self.holder[into], minlength=len(x) * len(self.landmarks)).reshape(len(x), -1)
        return np.nonzero(count >= self.need)

    def rows(self, words: list[str]) -> np.ndarray:
        """[words, landmarks], values under the floor as 0.  A word longer than LONGEST takes its best window."""
        out = np.zeros((len(words), len(self.landmarks)), np.float32)
        if not self.landmarks or not words:
            return out
        parts, own = list(words), list(range(len(words)))
        for i, w in enumerate(words):
            for s in range(LONGEST // 2, len(w) - LONGEST // 2, LONGEST // 2):
                parts.append(w[s : s + LONGEST])
                own.append(i)
        x, own = codes(parts, LONGEST), np.array(own)
        length = (x > 0).sum(axis=1)
        for s in range(0, len(x), 4096):
            i, k = self.near(x[s : s + 4096, : max(2, int(length[s : s + 4096].max()))])
            i = i + s
            wide = np.maximum(ORDER, -(-length[i] // 3) * 3)
            for width in np.unique(wide):
                pick = np.flatnonzero(wide == width)
                for p in (pick[j : j + 2048] for j in range(0, len(pick), 2048)):
                    one, back = np.unique(i[p], return_inverse=True)
                    norm = np.sqrt(np.maximum(raw_kernel(x[one, :width], x[one, :width]), 1e-9))[back]
                    np.maximum.at(out, (own[i[p]], k[p]), raw_kernel(x[i[p], :width], self.codes[k[p]]) / norm / self.norm[k[p]])
        out[out < FLOOR] = 0
        return out


@dataclass
class Model:
    landmarks: list[str]
    weights: np.ndarray  # on kernel values: the whitening and the machine's weights in one
    bias: float
    logistic: np.ndarray = field(default_factory=lambda: np.array([1.0, 0.0, 0.0, 0.0]))  # of worst margin, count, share, 1


@dataclass
class Sentences:
    """Of a piece of texts, the sentences that have a value over the floor: their document, words and rows of values."""

    document: np.ndarray
    words: np.ndarray
    rows: np.ndarray
    total: np.ndarray  # words of each document


class Scorer:
    """Scores texts; keeps the rows of tokens met before, up to a bound that only the start of a piece looks at."""

    def __init__(self, model: Model, most: int = 1_500_000):
        self.model, self.kernel, self.most = model, Kernel(model.landmarks), most
        self.forget()

    def forget(self) -> None:
        self.known = np.zeros(0, np.uint64)  # hashes of tokens, sorted
        self.value = np.zeros(0, np.int32)  # their rows of the table, -1 for zeros
        self.table = np.zeros((0, len(self.model.landmarks)), np.float32)

    def _values(self, forms: list[str]) -> np.ndarray:
        """Rows of tokens: the better of a token without punctuation at its ends and of its letters alone."""
        forms = [w.strip(EDGE) for w in forms]
        bare = [(i, b) for i, w in enumerate(forms) if not w.isalpha() and len(b := "".join(filter(str.isalpha, w))) >= ORDER]
        fine = [i for i, w in enumerate(forms) if len(w) >= ORDER]
        out = np.zeros((len(forms), len(self.model.landmarks)), np.float32)
        out[fine] = self.kernel.rows([forms[i] for i in fine])
        if bare:
            np.maximum.at(out, [i for i, _ in bare], self.kernel.rows([b for _, b in bare]))
        return out

    def learn(self, data: np.ndarray, hashes: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        """Compute the rows of tokens not met before; hashes are sorted, start and end say where the tokens stand."""
        k = np.searchsorted(self.known, hashes)
        new = np.flatnonzero(self.known[np.minimum(k, len(self.known) - 1)] != hashes) if len(self.known) else np.arange(len(hashes))
        if not len(new):
            return
        got = np.full(len(new), -1, np.int32)
        raw = data.tobytes()
        for s in range(0, len(new), 20_000):
            mine = new[s : s + 20_000]
            rows = self._values(b"\n".join([raw[a:b] for a, b in zip(start[mine].tolist(), end[mine].tolist(), strict=True)]).decode().lower().split("\n"))
            some = np.flatnonzero(rows.any(axis=1))
            got[s + some] = len(self.table) + np.arange(len(some))
            self.table = np.concatenate([self.table, rows[some]])
        at = k[new]
        self.known, self.value = np.insert(self.known, at, hashes[new]), np.insert(self.value, at, got)

    def sentences(self, data: np.ndarray, at: np.ndarray) -> Sentences:
        """Tokens are runs without ASCII white space; a sentence ends after a token that ends in . ! or ?, and at a line's end."""
        h, first, a, b = words(data, at, _SPACE)
        part, rel = data[at[0] : at[-1]], at - at[0]
        total, width = np.diff(first), len(self.model.landmarks)
        if not len(h) or not width:
            return Sentences(np.zeros(0, int), np.zeros(0, int), np.zeros((0, width), np.float32), total)
        distinct, where, back = np.unique(h, return_index=True, return_inverse=True)
        self.learn(part, distinct, a[where], b[where])
        value = self.value[np.searchsorted(self.known, distinct)][back]
        hit = np.flatnonzero(value >= 0)
        token, rows = hit, self.table[value[hit]]
        place, said = self._spelled(part, rel, a)
        if len(place):
            token, rows = np.concatenate([token, place]), np.concatenate([rows, said])
        breaks = np.concatenate([[0], np.cumsum(part == 10)])
        new = np.zeros(len(h) + 1, bool)
        new[first] = True
        new = new[:-1]
        new[1:] |= _STOP[part[b[:-1] - 1]] | (breaks[a[1:]] > breaks[b[:-1]])
        sentence = np.cumsum(new) - 1
        size = np.bincount(sentence)
        doc = np.searchsorted(first, np.flatnonzero(new), side="right") - 1
        mine, back = np.unique(sentence[token], return_inverse=True)
        best = np.zeros((len(mine), width), np.float32)
        np.maximum.at(best, back, rows)
        return Sentences(doc[mine], size[mine], best, total)

    def _spelled(self, part: np.ndarray, rel: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(token it begins in, row) of each run of three or more letters that stand alone, with values over the floor."""
        x, y = runs(part, rel, _LETTER[part])
        chars = np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80)])
        gaps = np.concatenate([[0], np.cumsum(_BETWEEN[part])])
        alone = chars[y] - chars[x] == 1
        row = np.searchsorted(rel, x, side="right")
        tied = alone[1:] & alone[:-1] & (gaps[x[1:]] - gaps[y[:-1]] == x[1:] - y[:-1]) & (row[1:] == row[:-1])
        edge = np.diff(np.concatenate([[0], tied.view(np.int8), [0]]))
        lo, hi = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        long = hi - lo >= 2
        lo, hi = lo[long], hi[long]
        if not len(lo):
            return lo, np.zeros((0, len(self.model.landmarks)), np.float32)
        said = ["".join(part[x[k] : y[k]].tobytes().decode() for k in range(i, j + 1)).lower() for i, j in zip(lo.tolist(), hi.tolist(), strict=True)]
        rows = self._values(said)
        some = np.flatnonzero(rows.any(axis=1))
        return np.searchsorted(a, x[lo[some]], side="right") - 1, rows[some]

    def features(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Of each document: worst margin, log of one plus its toxic sentences, log of those in 100 words, and 1."""
        if len(self.known) > self.most:
            self.forget()
        s = self.sentences(data, at)
        margin = s.rows @ self.model.weights + self.model.bias
        return document_features(s, margin, self.model.bias)

    def score(self, column: pa.Array) -> np.ndarray:
        data, at = texts_of(column)
        out = [np.zeros(0)]
        for lo, hi in pieces(at):
            out.append(_logistic(self.features(data, at[lo : hi + 1]) @ self.model.logistic))
        return np.concatenate(out)


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def document_features(s: Sentences, margin: np.ndarray, bias: float) -> np.ndarray:
    worst, count = np.full(len(s.total), min(bias, -1.0)), np.bincount(s.document[margin > 0], minlength=len(s.total))
    np.maximum.at(worst, s.document, margin)
    worst = np.clip(worst, -2, 2)
    return np.stack([worst, np.log1p(count), np.log1p(100 * count / np.maximum(s.total, 20)), np.ones(len(worst))], axis=1)


def _originals(texts: list[str]) -> list[int]:
    """Of the texts, those that aren't near copies of an earlier one: none shares a quarter of its smallest shingle hashes."""
    held: dict[tuple, int] = {}
    out = []
    seeds = mix(np.arange(1, 17, dtype=np.uint64))
    for i, t in enumerate(texts):
        data, at = texts_of(pa.array([t], pa.string()))
        h, *_ = words(data, at, _SPACE)
        five = sum((h[j : len(h) - 4 + j] * np.uint64(2 * j + 1) for j in range(5)), np.zeros(max(0, len(h) - 4), np.uint64)) if len(h) >= 5 else h
        low = [(k, int(mix(five ^ s).min())) for k, s in enumerate(seeds)] if len(five) else [(k, 0) for k in range(len(seeds))]
        met: dict[int, int] = {}
        for key in low:
            if key in held:
                met[held[key]] = met.get(held[key], 0) + 1
        if max(met.values(), default=0) < 4:
            out.append(i)
            for key in low:
                held.setdefault(key, i)
    return out


def choose_landmarks(texts: list[str], labels: np.ndarray) -> list[str]:
    """Tokens and beginnings of tokens that tell the labels apart best, then the tokens of harmless texts that are nearest to those."""
    counts: dict[str, list[int]] = {}
    stems: dict[str, list[int]] = {}
    for t, y in zip(texts, labels, strict=True):
        words = {w for w in (w.strip(EDGE) for w in t.lower().split()) if ORDER <= len(w) <= LONGEST // 2}
        for w in words:
            counts.setdefault(w, [0, 0])[int(y)] += 1
        for w in {w[:n] for w in words for n in range(ORDER, 10) if len(w) > n}:
            stems.setdefault(w, [0, 0])[int(y)] += 1
    rate = float(np.clip(labels.mean() if len(labels) else 0.5, 1e-3, 1 - 1e-3))

    def chance(n0: int, n1: int) -> float:
        """Log of about the probability that n1 or more of n0 + n1 documents are toxic by chance (Chernoff's bound)."""
        share = n1 / (n0 + n1)
        if share <= rate:
            return 0.0
        rest = (1 - share) * np.log((1 - share) / (1 - rate)) if share < 1 else 0.0
        return float(-(n0 + n1) * (share * np.log(share / rate) + rest))

    odds = {w: chance(*c) for w, c in counts.items() if c[1] >= 3}
    told = {w: chance(*c) for w, c in stems.items() if c[1] >= 3}
    whole = [w for w in odds if odds[w] < CHANCE]
    begun = [w for w in told if told[w] < CHANCE]
    good: list[str] = []
    kinds = {w: 0 for w in whole} | {w: 1 for w in begun if w not in odds or told[w] < 1.2 * odds[w]}
    best = {w: (told if kinds[w] else odds)[w] for w in kinds}
    room = [POSITIVE, STEMS]
    for w in sorted(kinds, key=lambda w: (best[w], -len(w), w)):  # what is told by a beginning, or an end of it, that is better needs no landmark
        if room[kinds[w]] and not any(w.startswith(x) or x.startswith(w) for x in good):
            good.append(w)
            room[kinds[w]] -= 1
    if not good:
        return []
    kernel = Kernel(good)
    plain = sorted((w for w, c in counts.items() if c[0] >= 3 and w not in good and odds.get(w, 0.0) > CHANCE / 2), key=lambda w: (-counts[w][0], w))[:20_000]
    rows = kernel.rows(plain).max(axis=1, initial=0)
    return good + [plain[i] for i in np.argsort(-rows, kind="stable")[:NEGATIVE] if rows[i] > 0]


def train(texts: list[str], labels: np.ndarray, rounds: int = 4, epochs: int = 60, reg: float = 1e-3, seed: int = 0) -> Model:
    """Fit landmarks, the Nyström map, the machine (stochastic subgradients of the hinge loss) and the logistic function."""
    labels = labels.astype(int)
    own = _originals(texts)
    texts, labels = [texts[i] for i in own], labels[own]
    landmarks = choose_landmarks(texts, labels)
    if not landmarks:
        rate = (labels.sum() + 0.5) / (len(labels) + 1)
        return Model([], np.zeros(0), 0.0, np.array([0.0, 0.0, 0.0, np.log(rate / (1 - rate))]))
    scorer = Scorer(Model(landmarks, np.zeros(len(landmarks)), 0.0))
    data, at = texts_of(pa.array(texts, pa.string()))
    got = [(lo, scorer.sentences(data, at[lo : hi + 1])) for lo, hi in pieces(at)]
    s = Sentences(np.concatenate([x.document + lo for lo, x in got]), *(np.concatenate([getattr(x, n) for _, x in got]) for n in ("words", "rows", "total")))
    kernel = scorer.kernel.rows(landmarks).astype(np.float64)
    value, vector = np.linalg.eigh((kernel + kernel.T) / 2 + 1e-3 * np.eye(len(kernel)))
    whiten = vector / np.sqrt(np.maximum(value, 1e-2))
    z = s.rows @ whiten
    order = np.argsort(s.document, kind="stable")
    edge = np.searchsorted(s.document[order], np.arange(len(texts) + 1))
    bags = [z[order[a:b]] if b > a else np.zeros((1, len(landmarks))) for a, b in zip(edge[:-1], edge[1:], strict=True)]
    rng = np.random.default_rng(seed)
    w, bias = np.zeros(len(landmarks)), 0.0
    positive = [b for b, y in zip(bags, labels, strict=True) if y]
    negative = np.concatenate([b for b, y in zip(bags, labels, strict=True) if not y] or [np.zeros((1, len(landmarks)))])
    pick = [b.mean(axis=0) for b in positive]
    for _ in range(rounds):
        x = np.concatenate([np.array(pick).reshape(-1, len(landmarks)), negative])
        y = np.concatenate([np.ones(len(pick)), -np.ones(len(negative))])
        cost = np.where(y > 0, len(y) / max(1, 2 * (y > 0).sum()), len(y) / max(1, 2 * (y < 0).sum()))
        w, bias, mean_w, mean_b, step = np.zeros(len(landmarks)), 0.0, 0.0, 0.0, 0
        for _ in range(epochs):
            shuffled = rng.permutation(len(y))
            for k in (shuffled[j : j + 64] for j in range(0, len(y), 64)):
                step += 1
                rate = 1 / (reg * (step + 200))
                bad = (y[k] * (x[k] @ w + bias) < 1) * cost[k]
                w = (1 - rate * reg) * w + rate * (bad * y[k]) @ x[k] / len(k)
                bias += min(rate, 1.0) * float((bad * y[k]).mean())
                mean_w, mean_b = mean_w + w, mean_b + bias
        w, bias = mean_w / step, mean_b / step
        pick = [b[int(np.argmax(b @ w))] for b in positive]
    x = document_features(s, z @ w + bias, bias)
    return Model(landmarks, whiten @ w, float(bias), _fit_logistic(x, labels))


def _fit_logistic(x: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Coefficients by Newton steps on the log loss, with the targets drawn in a little; more of a feature is never less toxic."""
    n1, n0 = labels.sum(), (1 - labels).sum()
    target = np.where(labels == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    used = np.arange(x.shape[1])
    while True:
        beta = np.zeros(len(used))
        for _ in range(100):
            p = _logistic(x[:, used] @ beta)
            h = (x[:, used] * (p * (1 - p))[:, None]).T @ x[:, used] + 1e-2 * np.eye(len(used))
            move = np.linalg.solve(h, x[:, used].T @ (target - p) - 1e-2 * beta)
            beta = beta + np.clip(move, -2, 2)
            if np.abs(move).max() < 1e-6:
                break
        falling = np.flatnonzero(beta[:-1] < 0)
        if not len(falling):
            out = np.zeros(x.shape[1])
            out[used] = beta
            return out
        used = np.delete(used, falling[np.argmin(beta[falling])])


def labelled(docs: DataFrame, labels: DataFrame, label_col: str, allowed, most: int, id_col: str = "doc_id", text_col: str = "text", most_bytes: int = MAX_TRAIN_BYTES) -> tuple[list[str], np.ndarray]:
    """Texts and labels of at most ``most`` labelled rows that ``allowed`` lets through, in the order of a hash of the id, as far
    as their texts make ``most_bytes``."""
    rows = labels.select(labels[id_col].cast("long").alias("i"), labels[label_col].cast("int").alias("y")).filter(F.col("i").isNotNull() & F.col("y").isin(0, 1)).filter(allowed(F.col("i"))).distinct()
    rows = rows.orderBy(F.xxhash64("i"), "i", "y").limit(most)
    both = docs.select(docs[id_col].cast("long").alias("i"), docs[text_col].cast("string").alias("t")).filter(F.col("t").isNotNull()).join(F.broadcast(rows), "i")
    one = both.groupBy("i", "y").agg(F.min("t").alias("t"))  # an id with many rows counts once; as many rows as are labelled, at most
    order = Window.orderBy(F.xxhash64("i"), "i", "y").rowsBetween(Window.unboundedPreceding, 0)
    got = sorted((r.i, r.t, r.y) for r in one.withColumn("sum", F.sum(F.octet_length("t")).over(order)).filter(F.col("sum") <= most_bytes).collect())
    return [t for _, t, _ in got], np.array([y for *_, y in got], int)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(row struct, score) of every row, from its whole text; null and empty texts get the score of a text without insults.

    ``row`` holds all columns, or those to keep.  Nothing is shuffled; repeated rows each keep a row.
    """
    sent, key = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex
    row = F.struct(*[docs[c] for c in keep or docs.columns])
    kind = docs.select(row.alias("row")).schema["row"].dataType.simpleString()

    def run(batches):
        scorer = slot(key, lambda: Scorer(sent.value))  # one for each model and worker
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scorer.score(batch.column(1)))], names=["row", "score"])

    return docs.select(row.alias("row"), docs[text_col].cast("string").alias("text")).mapInArrow(run, f"row {kind}, score double")
