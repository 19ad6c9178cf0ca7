"""Benchmark decontamination by suffix arrays over the training documents.

Each task builds suffix arrays over shards of its documents: the positions of a shard's words, sorted by all the words that
follow, by doubling the sorted length.  Every suffix of every benchmark item that is long enough for a window is looked up in
every shard by binary search, word by word, which gives all places where it occurs for a window's length or more.  Where the
words before differ, a place begins a longest verbatim match, which is then followed to its end.  A run of documents' words
that the benchmark doesn't have can't be in a match, so the arrays leave those words and runs too short for a window out; that
drops no match.  Documents are read once for each block of the benchmark, of which blocks have a bounded size, and never shuffled.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.common import cut, release
from tidegrid.llm.textscan import pieces, texts_of, word_bytes, words

#: A block of the benchmark holds about so many bytes of text; a larger benchmark is matched block after block.
BLOCK_BYTES = 4 << 20
MATCHES = "array<struct<item_id:bigint,item_word:int,doc_word:bigint,n_words:int>>"
_MATCH = pa.list_(pa.struct([("item_id", pa.int64()), ("item_word", pa.int32()), ("doc_word", pa.int64()), ("n_words", pa.int32())]))


@dataclass
class Suffixes:
    """The suffixes of a block's items: where each begins in the flat words (ids, 0 between items), how many words it has, how
    many of them must be met, and its item and offset."""

    vocabulary: np.ndarray
    words: np.ndarray
    start: np.ndarray
    length: np.ndarray
    depth: np.ndarray
    item: np.ndarray
    offset: np.ndarray


def suffixes(items: list[tuple[int, str]], size: int) -> Suffixes | None:
    """All suffixes of ``size`` words or more; an item of fewer words has one, one without words none."""
    data, at = texts_of(pa.array([t or "" for _, t in items], pa.string()))
    h, first, *_ = words(data, at, word_bytes("alnum"))
    if not len(h):
        return None
    vocabulary, ids = np.unique(h, return_inverse=True)
    n = np.diff(first)
    flat = np.zeros(len(ids) + len(items) + 1, np.int32)
    place = np.arange(len(ids)) + np.repeat(np.arange(len(items)), n) + 1
    flat[place] = ids + 1
    many = np.where(n > 0, np.maximum(n - size + 1, 1), 0)
    own = np.repeat(np.arange(len(items)), many)
    offset = np.arange(len(own)) - np.repeat(np.cumsum(many) - many, many)
    length = n[own] - offset
    return Suffixes(vocabulary, flat, first[own] + own + 1 + offset, length, np.minimum(length, size), np.array([i for i, _ in items], np.int64)[own], offset)


def suffix_array(seq: np.ndarray, room: np.ndarray, place: np.ndarray, longest: int) -> np.ndarray:
    """The places in the order of the words from there to the end of their run, ``longest`` of them at most.  Places are whole
    runs, so the word after a place is at the next one."""
    rank, k = seq[place].astype(np.int64), 1
    while k < longest and len(place):
        after = np.where(room[place] > k, rank[np.minimum(np.arange(len(place)) + k, len(place) - 1)], 0)
        distinct, rank = np.unique(rank * (rank.max() + 1) + after, return_inverse=True)
        rank = rank + 1
        if len(distinct) == len(place):
            break
        k *= 2
    return place[np.argsort(rank, kind="stable")]


def _bisect(column: np.ndarray, lo: np.ndarray, hi: np.ndarray, want: np.ndarray, right: bool) -> np.ndarray:
    """In each [lo, hi) of a column sorted there: the first place not below want, or the first above it."""
    lo, hi = lo.copy(), hi.copy()
    while (open_ := lo < hi).any():
        mid = (lo + hi) // 2
        got = column[np.minimum(mid, len(column) - 1)]
        up = open_ & ((got <= want) if right else (got < want))
        lo = np.where(up, mid + 1, lo)
        hi = np.where(open_ & ~up, mid, hi)
    return lo


def search(seq: np.ndarray, room: np.ndarray, w: Suffixes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(suffix, word position, words) of all longest matches.  seq: word ids, 0 outside the vocabulary; room: vocabulary words
    from here to the end of the run."""
    least, depth = int(w.depth.min()), int(w.depth.max())
    head = np.flatnonzero((room > 0) & np.concatenate([[True], room[:-1] <= 1])) if len(room) else np.zeros(0, np.int64)
    head = head[room[head] >= least]
    none = np.zeros(0, np.int64)
    if not len(head):
        return none, none, none
    run = np.repeat(head - np.concatenate([[0], np.cumsum(room[head])[:-1]]), room[head]) + np.arange(room[head].sum())
    place = suffix_array(seq, room, run, int(w.length.max()))
    column = lambda d: np.where(room[place] > d, seq[np.minimum(place + d, len(seq) - 1)], 0)
    who = np.arange(len(w.start))
    lo, hi = np.zeros(len(who), np.int64), np.full(len(who), len(place))
    done = []
    for d in range(depth + 1):
        full = w.depth[who] == d
        done.append((who[full], lo[full], hi[full]))
        who, lo, hi = who[~full], lo[~full], hi[~full]
        if not len(who):
            break
        c, want = column(d), w.words[w.start[who] + d]
        lo, hi = _bisect(c, lo, hi, want, False), _bisect(c, lo, hi, want, True)
        live = lo < hi
        who, lo, hi = who[live], lo[live], hi[live]
    who, lo, hi = (np.concatenate(x) for x in zip(*done, strict=True))
    n = hi - lo
    spot = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else none
    who, at = np.repeat(who, n), place[spot]
    begins = (at == 0) | (w.offset[who] == 0)
    begins |= (room[at - 1] <= 1) | (seq[at - 1] != w.words[w.start[who] - 1])  # not the same words, or not of the same run
    who, at = who[begins], at[begins]
    long, going = w.depth[who].copy(), np.arange(len(who))
    while len(going):
        k = long[going]
        going = going[(k < w.length[who[going]]) & (k < room[at[going]])]
        k = long[going]
        going = going[seq[at[going] + k] == w.words[w.start[who[going]] + k]]
        long[going] += 1
    return who, at, long


def _room(seq: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Words from each place to the end of its run of vocabulary words, inside its row."""
    n = len(seq)
    stop = np.zeros(n + 1, bool)
    stop[:n] = seq == 0
    stop[first] = True
    ends = np.flatnonzero(stop)
    here = np.arange(n)
    nxt = ends[np.searchsorted(ends, here, side="right")]
    return np.where(seq > 0, nxt - here, 0)


def matches_of(data: np.ndarray, at: np.ndarray, w: Suffixes) -> tuple[np.ndarray, dict[int, list[tuple]]]:
    """Words of each row, and of each row with matches the longest verbatim matches (item_id, item_word, doc_word, n_words)."""
    h, first, *_ = words(data, at, word_bytes("alnum"))
    count = np.diff(first)
    k = np.minimum(np.searchsorted(w.vocabulary, h), len(w.vocabulary) - 1)
    seq = np.where(w.vocabulary[k] == h, k + 1, 0).astype(np.int32)
    which, place, long = search(seq, _room(seq, first), w)
    row = np.searchsorted(first, place, side="right") - 1
    out: dict[int, list[tuple]] = {}
    for r, i, o, p, n in zip(row.tolist(), w.item[which].tolist(), w.offset[which].tolist(), (place - first[row]).tolist(), long.tolist(), strict=True):
        out.setdefault(r, []).append((i, o, p, n))
    return count, {r: sorted(m) for r, m in out.items()}


def covered(spans: list[tuple[int, int]]) -> int:
    """Words inside at least one span (start, length)."""
    total = reach = 0
    for a, n in sorted(spans):
        total += max(0, a + n - max(a, reach))
        reach = max(reach, a + n)
    return total


def find_matches(docs: DataFrame, benchmark: DataFrame, size: int = 10, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(row struct<all columns of docs, or those to keep>, n_words long, n_hit long, items array<long>, items_sha256 string, matches array<struct>)
    of every row.

    Words are runs of letters, digits and characters outside ASCII, with A-Z lower-cased.  A match is a longest verbatim run
    of at least ``size`` words, or of a whole item of fewer; ``n_hit`` counts the words inside any match; ``items`` are the
    distinct matching item ids in order.  Null or empty texts, and texts without words, have no matches; items without id or
    words match nothing; items that share an id count as one; repeated documents each keep their row.  Empty tables are fine.
    """
    has_id = F.col(item_col).isNotNull() & F.col(item_text_col).isNotNull()
    bench = benchmark.filter(has_id).select(F.col(item_col).cast("long").alias("i"), F.col(item_text_col).cast("string").alias("t")).distinct()
    weight = bench.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    blocks = 1 + int(weight) // BLOCK_BYTES
    sc = docs.sparkSession.sparkContext
    row = F.struct(*[docs[c] for c in keep or docs.columns]).alias("row")
    out = docs.select(row, docs[text_col].cast("string").alias("text"), F.lit(0).cast("long").alias("n_words"), F.array().cast(MATCHES).alias("matches"))
    schema = out.schema
    kind = schema["row"].dataType.simpleString()
    for k in range(blocks):
        part = bench.filter(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == k) if blocks > 1 else bench
        sent = sc.broadcast(suffixes(sorted((r.i, r.t) for r in part.collect()), size))

        def run(batches, sent=sent, last=k == blocks - 1):
            release()
            w = sent.value
            for batch in batches:
                data, at = texts_of(batch.column(1))
                n = np.zeros(batch.num_rows, np.int64)
                lists = batch.column(3).to_pylist() if blocks > 1 else [[] for _ in range(batch.num_rows)]
                for lo, hi in pieces(at):
                    if w is None:
                        n[lo:hi] = np.diff(words(data, at[lo : hi + 1], word_bytes("alnum"))[1])
                        continue
                    n[lo:hi], found = matches_of(data, at[lo : hi + 1], w)
                    for r, m in found.items():
                        lists[lo + r] = lists[lo + r] + [dict(zip(("item_id", "item_word", "doc_word", "n_words"), x, strict=True)) for x in m]
                if not last:
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n), pa.array(lists, _MATCH)], names=["row", "text", "n_words", "matches"])
                    continue
                hit = [covered([(m["doc_word"], m["n_words"]) for m in x]) for x in lists]
                items = [sorted({m["item_id"] for m in x}) for x in lists]
                digest = [hashlib.sha256(",".join(sorted(map(str, x))).encode()).hexdigest() for x in items]
                cols = [batch.column(0), pa.array(n), pa.array(hit, pa.int64()), pa.array(items, pa.list_(pa.int64())), pa.array(digest, pa.string()), pa.array(lists, _MATCH)]
                yield pa.RecordBatch.from_arrays(cols, names=["row", "n_words", "n_hit", "items", "items_sha256", "matches"])

        if k < blocks - 1:
            out = cut(out.mapInArrow(run, schema))
    return out.mapInArrow(run, f"row {kind}, n_words long, n_hit long, items array<long>, items_sha256 string, matches {MATCHES}")


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = 10, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without any match, with their own columns and nothing else."""
    return find_matches(docs, benchmark, size, text_col).filter(F.col("n_hit") == 0).select("row.*")
