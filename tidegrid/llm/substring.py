"""Removal of repeated lines and paragraphs by their digests.

A unit is a line with any text, or a paragraph: neighbouring lines with text, where there are two or more.  Units are
normalised (A-Z in lower case, runs of white space and line breaks as one space, none at the ends) and hashed to 128 bits, so
a paragraph is met again however its lines are broken, as a line too.  Digests are grouped over all documents with a map-side
minimum, so a unit that stands in most documents costs no more than a rare one; the earliest occurrence by (doc_id, text
digest, row, place) stays, and every later one goes.  The repeated digests go back to their occurrences by a join: those with more
than a two-thousandth of all units by broadcast, the others by shuffle.

Rows get a number of their own in a table in the shared folder, so that wholly equal rows are told apart in every job.

Passages that stand within longer lines are no units; ``drop_repeats`` takes those from ``passages``.
"""

from __future__ import annotations

import hashlib
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm import passages
from tidegrid.llm.common import LOWER, join_hot, release, stored

#: A removed stretch of more words counts as a passage in the report.
PASSAGE = 50
UNIT = "unit:int,last:int,start:int,length:int,n_words:int,d1:bigint,d2:bigint"
_UNIT = pa.struct([*((n, pa.int32()) for n in ("unit", "last", "start", "length", "n_words")), ("d1", pa.int64()), ("d2", pa.int64())])


def normalise(text: str) -> str:
    return " ".join(text.encode().translate(LOWER).decode().split())


def units_of(text: str | None) -> list[tuple]:
    """(first line, last line, start, length, words, d1, d2) of a text's lines, then of its paragraphs; offsets in code points."""
    lines, at = [], 0
    for k, line in enumerate((text or "").split("\n")):
        lines.append((k, at, len(line), normalise(line)))
        at += len(line) + 1
    out = [(k, k, at, n, norm) for k, at, n, norm in lines if norm]
    for full, group in groupby(lines, key=lambda x: bool(x[3])):
        if full and len(group := list(group)) > 1:
            (first, start, *_), (last, end, n, _) = group[0], group[-1]
            out.append((first, last, start, end + n - start, " ".join(x[3] for x in group)))
    digests = (hashlib.blake2b(u[4].encode(), digest_size=16).digest() for u in out)
    return [(*u[:4], u[4].count(" ") + 1, int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)) for u, d in zip(out, digests, strict=True)]


def _rows(docs: DataFrame, id_col: str, text_col: str, keep: list[str]) -> DataFrame:
    """(n, doc_id, digest, row, units): every row with a number of its own, its columns to keep and its units."""
    text = docs[text_col].cast("string")
    row = F.struct(*[docs[c] for c in keep]) if keep else F.lit(None).cast("int")
    given = docs.select(F.monotonically_increasing_id().alias("n"), docs[id_col].cast("long").alias("doc_id"), F.md5(text).alias("digest"), row.alias("row"), text.alias("text"))

    def run(batches):
        release()
        for batch in batches:
            lists = [units_of(t.as_py()) for t in batch.column("text")]
            flat = [u for x in lists for u in x]
            columns = list(zip(*flat, strict=True)) if flat else [()] * len(_UNIT)
            struct = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _UNIT, strict=True)], fields=list(_UNIT))
            ends = np.cumsum([0, *map(len, lists)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("n", "doc_id", "digest", "row")), pa.ListArray.from_arrays(pa.array(ends), struct)], names=["n", "doc_id", "digest", "row", "units"])

    return stored(given.mapInArrow(run, f"n long, doc_id long, digest string, row {given.schema['row'].dataType.simpleString()}, units array<struct<{UNIT}>>"))


def _late(rows: DataFrame) -> DataFrame:
    """(n, doc_id, unit, last, start, length, n_words, first_doc_id, copies): one row for each unit to remove."""
    found = rows.select("n", "doc_id", "digest", F.explode("units").alias("u")).select("n", "doc_id", "digest", "u.*")
    where = F.struct("doc_id", "digest", "n", "start", "length")
    groups = stored(found.groupBy("d1", "d2").agg(F.min(where).alias("first"), F.count("*").alias("copies")).filter("copies > 1"))
    total = int(rows.agg(F.sum(F.size("units"))).first()[0] or 0)
    late = join_hot(found, groups, ["d1", "d2"], "copies", total).filter(~F.col("first").eqNullSafe(where))
    return late.select("n", "doc_id", "unit", "last", "start", "length", "n_words", F.col("first.doc_id").alias("first_doc_id"), "copies")


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, unit, last, start, length, n_words, first_doc_id, copies): one row for each unit to remove.

    ``unit`` and ``last`` are its first and last line, ``start`` and ``length`` code points of the original text.  Null and empty
    texts have no units.  A null id ranks first.  Wholly equal rows are rows of their own, of which the first stays.  Empty
    tables give no rows; other columns are ignored.
    """
    return _late(_rows(docs, id_col, text_col, [])).drop("n")


def _gone(rows: DataFrame) -> DataFrame:
    return _late(rows).groupBy("n").agg(F.collect_list(F.struct("unit", "last")).alias("gone"))


def _with_gone(rows: DataFrame) -> DataFrame:
    return rows.join(_gone(rows), "n", "left")


def lines_gone(gone) -> set[int]:
    return {k for u in gone if u is not None for k in range(u["unit"], u["last"] + 1)} if gone is not None else set()


def stretches(units, gone) -> list[tuple[int, int, int]]:
    """(start, length, words) of each longest run of removed lines with text, in order."""
    dead, out = lines_gone(gone), []
    for dying, run in groupby((u for u in units if u["unit"] == u["last"]), key=lambda u: u["unit"] in dead):
        if dying:
            run = list(run)
            out.append((run[0]["start"], run[-1]["start"] + run[-1]["length"] - run[0]["start"], sum(u["n_words"] for u in run)))
    return out


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_lines, n_removed, n_words, removed_words, longest_removed, repeats_passage, spans): one row for each row of ``docs``.

    Lines without text don't count and don't end a stretch.  ``spans`` has the start and length of each removed stretch in code
    points of the original text, ``longest_removed`` the words of the longest, and ``repeats_passage`` says whether those are
    more than PASSAGE.  Nulls, equal rows and empty tables are as in ``repeats``.
    """
    schema = "doc_id long, n_lines long, n_removed long, n_words long, removed_words long, longest_removed long, repeats_passage boolean, spans array<struct<start:int,length:int>>"

    def run(batches):
        for batch in batches:
            out = []
            for i, units, gone in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "units", "gone")), strict=True):
                lines, dead, cut = [u for u in units if u["unit"] == u["last"]], lines_gone(gone), stretches(units, gone)
                longest = max((w for *_, w in cut), default=0)
                out.append((i, len(lines), len([u for u in lines if u["unit"] in dead]), sum(u["n_words"] for u in lines), sum(w for *_, w in cut), longest, longest > PASSAGE, [{"start": a, "length": n} for a, n, _ in cut]))
            types = [*[pa.int64()] * 6, pa.bool_(), pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())]))]
            columns = list(zip(*out, strict=True)) if out else [()] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[x.split()[0] for x in schema.split(", ")])

    return _with_gone(_rows(docs, id_col, text_col, [])).select("doc_id", "units", "gone").mapInArrow(run, schema)


def remove_repeats(text: str, gone, whole: bool | None, late) -> str:
    """The text without its repeated lines and passages; a line that loses all its words goes with its break."""
    dead, cut, out, at = lines_gone(gone), passages.stretches(text, whole, late), [], 0
    for k, line in enumerate(text.split("\n")):
        end = at + len(line)
        if k not in dead:
            while cut and cut[0][0] + cut[0][1] <= at:
                cut.pop(0)
            left, done = [], at
            for start, n, _ in cut:
                if start >= end:
                    break
                left.append(text[done : max(start, done)])
                done = min(start + n, end)
            left = "".join([*left, text[done:end]])
            if left == line or left.strip():
                out.append(left)
        at = end + 1
    return "\n".join(out)


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """``docs`` with later copies of units, and of passages anywhere in them, taken out of their texts, and the count of
    characters, if there, brought up to date.

    A row of which nothing but white space is left goes; a row that loses nothing stays as it is, empty or null text too.
    """

    rows = _rows(docs, id_col, text_col, docs.columns)
    text = F.col("row")[text_col].cast("string").alias("text")
    found, _ = passages.find(rows.select("n", "doc_id", "digest", text))
    gone = _gone(rows).join(found, "n", "full")
    rows = rows.join(gone, "n", "left").select("row", text, "gone", "whole", "late")
    kind = rows.schema["row"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            left = []
            for r in zip(*batch.columns[1:], strict=True):
                now = remove_repeats(*(x.as_py() for x in r)) if r[1].is_valid or r[2].is_valid else None
                left.append(None if r[0].is_valid and now == r[0].as_py() else now)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(left, pa.string())], names=["row", "left"])

    out = rows.mapInArrow(run, f"row {kind}, left string").filter(F.col("left").isNull() | F.col("left").rlike(r"\S"))
    new = {text_col: F.coalesce("left", F.col("row")[text_col])}
    if chars_col in docs.columns:
        new[chars_col] = F.when(F.col("left").isNotNull(), F.length("left").cast(docs.schema[chars_col].dataType)).otherwise(F.col("row")[chars_col])
    return out.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
