"""Sharding by sampled splitters, with DataFrame functions only.

Rows are ordered by (hash of the text, id, tie-breaker), so equal texts stand together.  A size-weighted sample of keys gives
splitters at quantiles of the bytes; the exact bytes and rows of each range are then counted, and a row's place in the whole
order is its range's offset plus a running sum inside the range.  Shard s takes what has its middle in the s-th of the equal
parts of all bytes.  A text that the sample meets often makes an overfull range, which is cut again by id and tie-breaker; other equal
texts are never cut by a splitter, and stay in one shard if they hold little of one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.llm.common import cut, stored

RANGES_PER_SHARD, OVERSAMPLE, CELL_BITS = 16, 32, 10
#: Ranges grow with the rows, so that a range is a task; the driver sees OVERSAMPLE keys of each.
ROWS_PER_RANGE, MOST_RANGES = 500_000, 20_000
#: Equal texts stay together up to this part of a shard.
TOGETHER = 20
LOWEST = -(1 << 63)
OWN_BYTES = 16


def splitters(sample: list[tuple[int, int, int, float]], ranges: int) -> list[tuple[int, int, int]]:
    """Keys at the quantiles of the weights.  A text met by one splitter is kept whole; one met by more is cut by them."""
    sample = sorted(sample)
    step = sum(x[3] for x in sample) / ranges if sample else 0
    picked, seen = [], 0.0
    for h, i, u, weight in sample:
        if seen + weight >= (len(picked) + 1) * step and len(picked) < ranges - 1:
            picked.append((h, i, u))
            while seen + weight >= (len(picked) + 1) * step and len(picked) < ranges - 1:
                picked.append((h, i, u))
        seen += weight
    often = {a[0] for a, b in zip(picked, picked[1:], strict=False) if a[0] == b[0]}
    out = {(h, i, u) if h in often else (h, LOWEST, LOWEST) for h, i, u in picked}
    return sorted(out | {(h, LOWEST, LOWEST) for h in often})


def assign_shards(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, *carry): law `bytes`, one row for each row of ``docs``.

    ``size`` is the text's UTF-8 bytes plus 16; null texts count as empty, null ids sort first.  Shards differ from an equal
    share by about a twentieth of it, or the largest row, at most.  Slots are gapless from 0 in each shard.  Wholly equal rows are rows
    of their own.  Empty tables give no rows; with fewer rows than shards some shards stay empty.
    """
    spark = docs.sparkSession
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    rows = docs.select(
        docs[id_col].cast("long").alias("doc_id"),
        (F.octet_length(text) + OWN_BYTES).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("h"),
        F.xxhash64(F.monotonically_increasing_id()).alias("u"),
        *[docs[c] for c in carry],
    ).withColumn("i", F.coalesce("doc_id", F.lit(LOWEST)))
    rows = stored(rows)  # the tie-breaker must not change from one job to the next
    total, count = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    ranges = max(shards * RANGES_PER_SHARD, min(count // ROWS_PER_RANGE, MOST_RANGES))
    share = F.col("size") * F.lit(float(ranges * OVERSAMPLE) / max(total, 1))
    draw = (F.xxhash64("h", "i", "u", F.lit(1)).bitwiseAND(F.lit((1 << 52) - 1)) + F.lit(0.5)) / float(1 << 52)
    sample = rows.filter(draw < share).select("h", "i", "u", F.greatest(share, F.lit(1.0)).alias("w")).collect()
    cuts = splitters([tuple(r) for r in sample], ranges)

    cells: dict[int, list] = {c: [] for c in range(-(1 << CELL_BITS - 1), 1 << CELL_BITS - 1)}
    for key in cuts:
        cells[key[0] >> (64 - CELL_BITS)].append(key)
    base, table = 0, []
    for c, keys in cells.items():
        table.append((c, base, keys))
        base += len(keys)
    lookup = spark.createDataFrame(table, "cell long, base int, cuts array<struct<h:long,i:long,u:long>>")  # 2**CELL_BITS rows
    rows = rows.withColumn("cell", F.shiftright("h", 64 - CELL_BITS)).join(F.broadcast(lookup), "cell")
    here = F.struct("h", "i", "u")
    rows = rows.withColumn("range", F.col("base") + F.size(F.filter("cuts", lambda c: c <= here))).drop("cell", "base", "cuts")

    sums = sorted((r.range, int(r.b), r.n) for r in rows.groupBy("range").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect())  # at most as many as ranges
    offsets, b, n = [], 0, 0
    for k, own, count in sums:
        offsets.append((k, b, n))
        b, n = b + own, n + count
    at = F.broadcast(spark.createDataFrame(offsets, "range int, before long, rows_before long"))
    order = Window.partitionBy("range").orderBy("h", "i", "u")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    text_group = Window.partitionBy("range", "h")
    rows = rows.withColumn("start", F.sum("size").over(upto) - F.col("size")).withColumn("k", F.row_number().over(order))
    rows = rows.withColumn("group_start", F.min("start").over(text_group)).withColumn("group_size", F.sum("size").over(text_group))
    whole = F.col("group_size") * F.lit(TOGETHER * shards) <= F.lit(b)
    middle = lambda start, size: F.col(start) + F.floor(F.col(size) / 2)
    place = F.col("before") + F.when(whole, middle("group_start", "group_size")).otherwise(middle("start", "size"))
    shard = F.least(F.floor(place * F.lit(shards) / F.lit(max(b, 1))), F.lit(shards - 1)).cast("int")
    rows = cut(rows.join(at, "range").select("doc_id", "size", "text_crc32", shard.alias("shard"), (F.col("rows_before") + F.col("k") - 1).alias("place"), *carry))
    first = rows.groupBy("shard").agg(F.min("place").alias("first"))  # one row for each shard
    return rows.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("place") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), *carry)


def write_shards(docs: DataFrame, path: str, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write whole rows as one folder for each shard, in slot order."""
    rest = tuple(c for c in docs.columns if c not in ("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"))
    assign_shards(docs, shards, id_col, text_col, rest).repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
