"""The corpus queries: thin digests of the operators' results, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.llm.bpe import encode_documents
from tidegrid.llm.chat import format_chats, read_chats
from tidegrid.llm.common import table
from tidegrid.llm.decontaminate import find_matches
from tidegrid.llm.oracles import ORACLES
from tidegrid.llm.neardup import near_duplicates
from tidegrid.llm.sharding import assign_shards
from tidegrid.llm import licenses, passages, quality, substring, toxicity
from tidegrid.llm.topk import top_k

#: The rank file of op8 and of the pipeline's last stage.
RANKS = "byte_bpe_multi_50k.tiktoken"


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return top_k(rows, rows.filter(F.pmod("vec_id", F.lit(20)) == 0), k=20, scale=64)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(*toxicity.labelled(docs, table(spark, sf_dir, "labels"), "quality", lambda i: remainder(i, 4) != 2, quality.MAX_TRAIN))
    scored = quality.score(docs, model, keep=["doc_id"]).select("row.doc_id", "score")
    return scored.select("doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op3_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=4, percent=80)


def remainder(i, n: int):
    """crc32 of an id as text, modulo n."""
    return F.pmod(F.crc32(i.cast("string")), F.lit(n))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(*toxicity.labelled(docs, table(spark, sf_dir, "labels"), "toxic", lambda i: remainder(i, 5) != 0, toxicity.MAX_TRAIN))
    scored = toxicity.score(docs, model, keep=["doc_id"]).select("row.doc_id", "score")
    return scored.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of over 50 words that stand earlier, wherever they begin and end."""
    found = passages.report(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "repeated_words", "longest", F.size("spans").alias("n_passages"), "repeats_passage")


def op5_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = substring.report(table(spark, sf_dir, "documents"))
    spans = F.concat_ws(",", F.transform("spans", lambda s: F.concat(s["start"].cast("string"), F.lit("+"), s["length"].cast("string"))))
    return rows.withColumn("spans", spans)


def op5_substring_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every unit to remove, with its original offsets and the document of the occurrence that stays."""
    return substring.repeats(table(spark, sf_dir, "documents"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents"), shards=40)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    rows = encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN, keep_ids=False)
    return rows.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), size=10, keep=["doc_id"])
    return found.select("row.doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items_sha256", (F.col("n_hit") > 0).alias("contaminated"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    read = read_chats(format_chats(rows))
    turns = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


QUERIES = {"op1_topk": op1_topk, "op2_quality": op2_quality, "op3_neardup": op3_neardup, "op4_toxicity": op4_toxicity, "op5_passages": op5_passages, "op5_substring": op5_substring, "op6_licenses": op6_licenses, "op7_sharding": op7_sharding, "op8_bpe": op8_bpe, "op9_decontaminate": op9_decontaminate, "op10_chat": op10_chat, "op5_substring_units": op5_substring_units}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
