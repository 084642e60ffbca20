"""The corpus pipeline: documents through five operators of ``attesta.llm``, each on all that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's ``docs``. All stages but the last return the columns of documents, whatever other columns there are.

Every stage gives an empty table for an empty one and reads whole texts however long. Null and empty texts, repeated
rows and rows without a key pass through it as its docstring says.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from attesta.llm import bpe, decontaminate, jaccard, passages, quality
from attesta.llm.queries import RANKS, labels
from attesta.session import cut


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; null and empty texts are judged by its bias alone, repeats alike."""
    return quality.keep_good(docs, quality.train(docs, labels(spark, sf_dir)))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose n-gram sets are similar, the one of the smallest id stays (one without an id only if none has one).

    Repeated rows stay once; texts without words are like no other and stay.
    """
    return jaccard.keep_one(docs)


def passages_once(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A passage that repeats across documents stays in the document of the smallest id alone; documents without words left go.

    Rows that share an id are one document; rows without one, and null and empty texts, stay as they are.
    """
    return passages.cut_out(docs)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, or an edited copy of one, go, all rows of their id; rows without an id or text stay."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every text as token ids, with the digests of the ids and of what they decode to: a row for each row; null and empty texts have no ids."""
    return bpe.round_trip(docs, RANKS, public_tokenizers.PATTERN, with_ids=True)


STAGES = [
    ("quality classifier", good_quality),
    ("n-gram Jaccard join", one_of_each_group),
    ("substring dedup", passages_once),
    ("benchmark decontamination", no_benchmark),
    ("byte-level BPE", token_ids),
]

#: Classifier, alignment and tokenizer cannot be expressed in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), spark)
    return STAGES[-1][1](spark, docs, sf_dir)
