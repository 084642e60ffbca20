"""Text files, gold lists and results as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.functions.text import is_blank
from attesta.schemas import GOLD


def read_texts(spark: SparkSession, path: str, on_blank: str = "skip") -> DataFrame:
    """``name, text`` of whole text files. Blank files: skipped, or with ``on_blank='fail'`` an error."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("name"), F.col("value").alias("text"))
    if on_blank == "fail":
        return rows.withColumn("text", F.when(is_blank(F.col("text")), F.raise_error(F.concat(F.lit("blank file "), F.col("name")))).otherwise(F.col("text")))
    return rows.where(~is_blank(F.col("text")))


def read_gold(spark: SparkSession, folder: str) -> DataFrame:
    """``case, source, gold_no, verbatim, type`` of all ``*.gold.json`` files in a folder.

    A file without a source or without gold spans fails the query. ``source`` is the file's base name.
    """
    rows = spark.read.schema(GOLD[len("struct<") : -1].replace("source:string,gold:", "source string, gold ")).json(f"{folder}/*.gold.json", multiLine=True).select("*", F.col("_metadata.file_name").alias("case"))
    bad = F.coalesce(F.col("source") == "", F.lit(True)) | (F.coalesce(F.size("gold"), F.lit(0)) < 1)
    checked = rows.withColumn("gold", F.when(bad, F.raise_error(F.concat(F.col("case"), F.lit(": no source or no gold spans")))).otherwise(F.col("gold")))
    return checked.select("case", F.element_at(F.split("source", r"[/\\]"), -1).alias("source"), F.posexplode("gold").alias("gold_no", "g")).select("case", "source", "gold_no", "g.verbatim", "g.type").orderBy("case", "gold_no")


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """``name, content`` of finished results, undecoded."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("name"), F.col("value").alias("content"))
