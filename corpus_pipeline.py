"""The corpus pipeline: documents go through STAGES in order, each over all that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next one's
docs.  All but the last return the columns of documents.  Null, empty and repeated rows are treated as each operator says.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.llm import toxicity
from tidegrid.llm.bpe import encode_documents
from tidegrid.llm.common import checkpoint_dir, table
from tidegrid.llm.decontaminate import decontaminate
from tidegrid.llm.neardup import keep_one
from tidegrid.llm.queries import RANKS
from tidegrid.llm.substring import drop_repeats


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score of 0.5 or more go.  The model is fitted on the labelled documents of the table itself."""
    known = toxicity.labelled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "toxic", lambda i: F.lit(True), toxicity.MAX_TRAIN)
    return toxicity.score(docs, toxicity.train(*known)).filter(F.col("score") < 0.5).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with shingles of five words and a similarity of 0.8 stays."""
    return keep_one(docs, k=5, percent=80)


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of lines go from the texts; a document that loses all its text goes."""
    return drop_repeats(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a run of ten words of a benchmark item go."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"), size=10)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, ids_sha256, decoded_sha256 and round_trip of every document that is left."""
    return encode_documents(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", toxic),
    ("near duplicates", near_duplicates),
    ("repeated lines", repeated_lines),
    ("benchmark passages", benchmark_passages),
    ("tokens", tokens),
]

#: Learned scores and a transducer are not SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
