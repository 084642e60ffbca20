"""Small helpers that tie numpy operators to Spark plans."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.session import ship

#: Rows in an Arrow batch: long documents must not add up to much memory.
BATCH_ROWS = 512


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return df.select(*columns) if columns else df


def mapped(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    spark = ship(df.sparkSession)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df.mapInArrow(fn, schema)


def gathered(batches: Iterable[pa.RecordBatch], rows: int = 1 << 14, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``rows`` rows or ``size`` bytes, none of them empty: for operators whose rows are short."""
    held: list[pa.RecordBatch] = []
    n = of = 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n, of = n + batch.num_rows, of + batch.nbytes
        if n >= rows or of >= size:
            yield pa.concat_batches(held)
            held, n, of = [], 0, 0
    if held:
        yield pa.concat_batches(held)


def free(columns: list[str], name: str) -> str:
    """``name``, with underscores before it until no column is called so (whatever its case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def bucket(column: str, parts: int) -> Column:
    """crc32 of the key as text (null: empty text), modulo ``parts``."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % parts


def released(spark: SparkSession, action: Callable[[], None]) -> None:
    """Run an action whose shuffle files are not needed after it, so that Spark may delete them at once."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        action()
    finally:
        spark.conf.set(key, before or "false")


def sampled(df: DataFrame, id_col: str, most: int) -> DataFrame:
    """All rows, or where there are more than ``most``, about ``most`` of them: those of the lowest crc32 of the key."""
    n = df.count()
    return df if n <= most else df.where(bucket(id_col, 1 << 32) < int((1 << 32) * most / n))
