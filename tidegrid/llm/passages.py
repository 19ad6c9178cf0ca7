"""Passages of more than PASSAGE words that stand earlier, in another text or further up in the same one.

Words are runs of anything but ASCII white space, with A-Z in lower case, so a passage is met again within longer lines, with
other words around it and however its lines are broken.  A word goes if a window of SIZE words that holds it stands earlier by
(doc_id, text digest, row, place); so a copy of every word stays.

Windows are too many to group them all.  Of the hashes of GRAM words in a window the least is its mark, equal windows have equal
marks, and neighbouring windows mostly share theirs, so marks are few.  Only windows whose mark is met twice get a digest
of 128 bits, and only these are grouped: exactly, with no bound on how many stand alike.  A text that is equal to an earlier one
goes as a whole, without its windows.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.common import WORD_SPACE, join_hot, release, stored
from tidegrid.llm.textscan import _powers, mix, pieces, texts_of, word_bytes, words

#: A passage has more words than this.
PASSAGE = 50
SIZE = PASSAGE + 1
#: Every window holds as many runs of GRAM words as a mark is the least of.
GRAM = 26
SPREAD = SIZE - GRAM + 1
WORD = re.compile(f"[^{WORD_SPACE}]+")
_MEMBER = word_bytes("space")
_LAST = np.uint64(0xFFFFFFFFFFFFFFFF)


def rolled(h: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` numbers, by the first one's place."""
    up, down = _powers(len(h) + 1)
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up[: len(h)], out=total[1:])
    return mix((total[size:] - total[:-size]) * down[: len(h) - size + 1])


def over(x: np.ndarray, size: int, pick: Callable) -> np.ndarray:
    """``pick`` of x[i : i + size] for every i, of what is left at the end."""
    n = 1
    while n < size:
        step = min(n, size - n)
        x = np.concatenate([pick(x[:-step], x[step:]), x[-step:]]) if len(x) > step else np.array([pick.reduce(x[i:]) for i in range(len(x))], x.dtype)
        n += step
    return x


def least(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of GRAM words, marks of windows, whether a window lies within its row) by the place of the first word."""
    n = len(h)
    left = np.repeat(first[1:], np.diff(first)) - np.arange(n)
    grams = np.full(n, _LAST)
    if n >= GRAM:
        grams[: n - GRAM + 1] = rolled(h, GRAM)
    grams[left < GRAM] = _LAST
    return grams, over(grams, SPREAD, np.minimum), left >= SIZE


def marks_of(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, mark) of each place with a mark, twice at most for one mark and row."""
    grams, low, inside = least(h, first)
    top = over(np.where(inside, low, np.uint64(0))[::-1], SPREAD, np.maximum)[::-1]
    at = np.flatnonzero((top == grams) & (grams != _LAST))
    row = np.searchsorted(first, at, side="right") - 1
    order = np.lexsort((grams[at], row))
    row, mark = row[order], grams[at][order]
    third = np.zeros(len(at), bool)
    third[2:] = (row[2:] == row[:-2]) & (mark[2:] == mark[:-2])
    return row[~third], mark[~third].view(np.int64)


def _marked(rows: DataFrame) -> DataFrame:
    """(n, n_words, marks) of every row."""

    def run(batches):
        release()
        for batch in batches:
            data, at = texts_of(batch.column(1))
            for lo, hi in pieces(at):
                h, first, *_ = words(data, at[lo : hi + 1], _MEMBER)
                row, mark = marks_of(h, first)
                ends = np.searchsorted(row, np.arange(hi - lo + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], pa.array(np.diff(first).astype(np.int64)), pa.ListArray.from_arrays(pa.array(ends), pa.array(mark))], names=["n", "n_words", "marks"])

    return stored(rows.select("n", "text").mapInArrow(run, "n long, n_words long, marks array<long>"))


def _windows(rows: DataFrame) -> DataFrame:
    """(n, rank, at, d1, d2, again): the windows of rows with one of the row's ``marks``; ``again`` if the same row has it before."""

    def run(batches):
        release()
        for batch in batches:
            data, at = texts_of(batch.column(2))
            for lo, hi in pieces(at):
                h, first, *_ = words(data, at[lo : hi + 1], _MEMBER)
                if len(h) < SIZE:
                    continue
                _, low, inside = least(h, first)
                one, two = rolled(h, SIZE), rolled(mix(h ^ np.uint64(0x5851F42D4C957F2D)), SIZE)
                for k in range(lo, hi):
                    a, b = first[k - lo], first[k - lo + 1]
                    known = np.asarray(batch.column(3)[k].values).view(np.uint64)
                    place = a + np.flatnonzero(inside[a:b] & np.isin(low[a:b], known))
                    order = np.lexsort((place, two[place], one[place]))
                    place = place[order]
                    d1, d2 = one[place], two[place]
                    again = np.zeros(len(place), bool)
                    again[1:] = (d1[1:] == d1[:-1]) & (d2[1:] == d2[:-1])
                    same = [pa.array(np.full(len(place), batch.column(c)[k].as_py(), np.int64)) for c in (0, 1)]
                    yield pa.RecordBatch.from_arrays([*same, pa.array((place - a).astype(np.int32)), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), pa.array(again)], names=["n", "rank", "at", "d1", "d2", "again"])

    return stored(rows.select("n", "rank", "text", "marks").mapInArrow(run, "n long, rank long, at int, d1 long, d2 long, again boolean"))


def find(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((n, whole, late) of rows that repeat, (n, n_words) of all) of a table (n, doc_id, digest, text): whether the whole text
    stands earlier, and else the first words of its windows that do."""
    firsts = rows.filter("text IS NOT NULL").groupBy("digest").agg(F.min(F.struct("doc_id", "n")).alias("f"))
    ranked = stored(firsts.select("f.doc_id", "digest", "f.n").orderBy("doc_id", "digest", "n").select("n", F.monotonically_increasing_id().alias("rank")))
    marked = _marked(rows)
    each = marked.join(ranked, "n").select("n", F.explode("marks").alias("mark"))
    groups = stored(each.groupBy("mark").agg(F.count("*").alias("copies")).filter("copies > 1"))
    total = int(marked.agg(F.sum(F.size("marks"))).first()[0] or 0)
    met = join_hot(each, groups, ["mark"], "copies", total).groupBy("n").agg(F.collect_set("mark").alias("marks"))
    found = _windows(rows.select("n", "text").join(met.join(ranked, "n"), "n"))
    fresh = found.filter("NOT again")
    same = stored(fresh.groupBy("d1", "d2").agg(F.min("rank").alias("first"), F.count("*").alias("copies")).filter("copies > 1"))
    later = join_hot(fresh, same, ["d1", "d2"], "copies", fresh.count()).filter("rank > first")
    late = later.select("n", "at").unionByName(found.filter("again").select("n", "at")).groupBy("n").agg(F.collect_list("at").alias("late"))
    copies = rows.filter("text IS NOT NULL").select("n").join(ranked, "n", "left_anti")
    none = F.lit(None).cast("array<int>")
    gone = copies.select("n", F.lit(True).alias("whole"), none.alias("late")).unionByName(late.select("n", F.lit(False).alias("whole"), "late"))
    return gone, marked.select("n", "n_words")


def stretches(text: str | None, whole: bool | None, late) -> list[tuple[int, int, int]]:
    """(start, length, words) of each passage to remove, in code points and in order."""
    if not text or whole is None:
        return []
    spot = [m.span() for m in WORD.finditer(text)]
    edge = np.zeros(len(spot) + 1, np.int64)
    if whole and len(spot) >= SIZE:
        edge[0] = 1
    elif not whole:
        np.add.at(edge, late, 1)
        np.add.at(edge, np.asarray(late) + SIZE, -1)
    dead = np.concatenate([[False], np.cumsum(edge[:-1]) > 0, [False]]).astype(np.int8)
    begin, end = np.flatnonzero(np.diff(dead) == 1).tolist(), np.flatnonzero(np.diff(dead) == -1).tolist()
    return [(spot[a][0], spot[b - 1][1] - spot[a][0], b - a) for a, b in zip(begin, end, strict=True)]


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, repeated_words, longest, repeats_passage, spans): one row for each row of ``docs``.

    ``spans`` has the start and length of each passage to remove in code points of the text, ``longest`` the words of the longest.
    Null texts have no words.  A null id ranks first.  Of wholly equal rows the first stays.  Empty tables give no rows.
    """
    text = docs[text_col].cast("string")
    rows = stored(docs.select(F.monotonically_increasing_id().alias("n"), docs[id_col].cast("long").alias("doc_id"), F.md5(text).alias("digest"), text.alias("text")))
    gone, counted = find(rows)
    schema = "doc_id long, n_words long, repeated_words long, longest long, repeats_passage boolean, spans array<struct<start:int,length:int>>"

    def run(batches):
        kinds = [*[pa.int64()] * 2, pa.bool_(), pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())]))]
        for batch in batches:
            cut = [stretches(*(x.as_py() for x in r)) if r[1].is_valid else [] for r in zip(*batch.columns[2:], strict=True)]
            out = [[sum(w for *_, w in c) for c in cut], [max((w for *_, w in c), default=0) for c in cut], [bool(c) for c in cut], [[{"start": a, "length": n} for a, n, _ in c] for c in cut]]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array(x, t) for x, t in zip(out, kinds, strict=True))], names=[x.split()[0] for x in schema.split(", ")])

    return rows.join(counted, "n").join(gone, "n", "left").select("doc_id", "n_words", "text", "whole", "late").mapInArrow(run, schema)
