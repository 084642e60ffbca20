"""The queries of this subpackage; each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, jaccard, langid, licenses, lmscore, media, passages, quality, toxicity
from .frames import bucket, documents

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(documents(spark, sf_dir), RANKS, public_tokenizers.PATTERN)


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text", "lang")
    out = langid.predict(docs, langid.train(docs.where(bucket("doc_id", 4) != 2)))
    return out.select("doc_id", (bucket("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.round_trip(documents(spark, sf_dir))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    out = quality.score(docs, quality.train(docs, labels(spark, sf_dir)))
    return out.select("doc_id", (bucket("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(documents(spark, sf_dir))


def op7_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.find(documents(spark, sf_dir))


def op8_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lmscore.score(documents(spark, sf_dir, "doc_id", "text"), RANKS)


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's path is its source and its id, so documents that are whole licence notices cover their source."""
    found = licenses.scan(documents(spark, sf_dir), F.concat_ws("/", "source", F.col("doc_id").cast("string")))
    return licenses.inherit(found)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    out = toxicity.score(docs, toxicity.train(docs, labels(spark, sf_dir)))
    return out.select("doc_id", (bucket("doc_id", 4) == 2).alias("held_out"), "score", "predicted")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {k: f for k, f in globals().items() if k[:2] == "op" and k[2:3].isdigit()}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))


#: All pairs that share an n-gram, in full: for small tables only. MinHash may lose a pair in a thousand at the threshold.
JACCARD_SQL = r"""
WITH RECURSIVE split AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS g FROM split),
grams AS (SELECT doc_id, len(g) AS n, unnest(g) AS g FROM sets),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, a.n + b.n AS n, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM pairs WHERE 10 * c >= 8 * (n - c)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x),
counts AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT reach.x AS doc_id, min(reach.y) AS class_id, coalesce(any_value(counts.n), 0) AS n_links FROM reach LEFT JOIN counts ON counts.x = reach.x GROUP BY reach.x
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_jaccard": JACCARD_SQL}
