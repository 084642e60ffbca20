"""Operators that look at one document at a time, over a stream of documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from attesta.operators import chunking
from attesta.plans.pipeline import extract
from attesta.sources.replies import Extractor


def chunk_stream(docs: DataFrame, chunk_tokens: int = 1000) -> DataFrame:
    """Chunks of a streaming ``(doc_id, text)``; stateless, so it needs no watermark."""
    return chunking.chunks(docs, chunk_tokens)


def extract_stream(docs: DataFrame, extractor: Extractor, sink: Callable[[DataFrame, int], None], checkpoint: str, chunk_tokens: int = 1000):
    """Run extraction on every micro-batch and hand its results to ``sink``; a document must arrive whole in one batch."""
    writer = docs.writeStream.foreachBatch(lambda df, epoch: sink(extract(df, extractor, chunk_tokens)["results"], epoch))
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_documents(spark: SparkSession, path: str, per_batch: int = 1) -> DataFrame:
    """A folder of Parquet document tables as a stream."""
    return spark.readStream.schema("doc_id bigint, text string").option("maxFilesPerTrigger", per_batch).parquet(path)
