"""Finished results: claims located in the whole document, cited and inferred apart, with a summary."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from attesta.functions import batches
from attesta.schemas import CITED, INFERRED


def located(merged: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``merged`` claims with ``at`` and ``position`` in the whole document (null where the span is not in it).

    Claims travel to their document as one array, so its text is moved once; documents without claims are kept out.
    """
    fields = [f.name for f in merged.schema if f.name != id_col]
    grouped = merged.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("id", *(f for f in fields if f != "id")))).alias("claims"))
    met = grouped.join(docs.select(id_col, F.col(text_col).alias("__text")), id_col)
    new = StructType.fromDDL("at int, position struct<line:int,column:int>")
    return batches.judged(met, "claims", "__text", ["verbatim"], new, _placed).select(id_col, F.inline("claims")).select(id_col, *fields, "at", "position")


def _placed(text: str | None, values: list[list]) -> Iterator[tuple[int | None, dict | None]]:
    ready = batches.Folded(text or "")
    for span in values[0]:
        found = None if span is None else ready.locate(span)
        yield (None, None) if found is None else (found[1], batches.position(ready.text, found[1]))


def is_cited(verbatim: Column) -> Column:
    return verbatim.isNotNull()


def cited(placed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return placed.where(is_cited(F.col("verbatim"))).select(id_col, "id", "fact", "type", "confidence", "verbatim", "position")


def inferred(placed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return placed.where(~is_cited(F.col("verbatim"))).select(id_col, "id", "fact", "type", "confidence")


def failed(verbatim: Column, confidence: Column) -> Column:
    """A citation that failed: no span, and a confidence that is not exactly ``low``."""
    return verbatim.isNull() & ~F.coalesce(confidence == "low", F.lit(False))


def summary(placed: DataFrame, docs: DataFrame | None = None, id_col: str = "doc_id") -> DataFrame:
    """``total, verbatim, inferred, failed_citations, unlocated`` per document; with ``docs``, documents without claims count zeros."""
    has = F.col("verbatim").isNotNull()
    out = placed.groupBy(id_col).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(has).alias("verbatim"), F.count_if(~has).alias("inferred"),
        F.count_if(failed(F.col("verbatim"), F.col("confidence"))).alias("failed_citations"), F.count_if(has & F.col("position").isNull()).alias("unlocated"),
    )
    return out if docs is None else docs.select(id_col).join(out, id_col, "left").na.fill(0)


def build(placed: DataFrame, docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``id_col, result``: one result struct per document (an empty one where nothing was claimed)."""
    has = F.col("verbatim").isNotNull()
    claim = F.struct("id", "fact", "type", "confidence", "verbatim", "position", has.alias("cited"), failed(F.col("verbatim"), F.col("confidence")).alias("failed"))
    by = placed.groupBy(id_col).agg(F.array_sort(F.collect_list(claim)).alias("all"))
    made = docs.select(id_col).join(by, id_col, "left")
    every = F.coalesce(F.col("all"), F.expr("cast(array() as array<struct<id:int,fact:string,type:string,confidence:string,verbatim:string,position:struct<line:int,column:int>,cited:boolean,failed:boolean>>)"))
    size = lambda test: F.size(F.filter(every, test)).cast("int")
    head = F.struct(
        F.size(every).alias("total"), size(lambda c: c["cited"]).alias("verbatim"), size(lambda c: ~c["cited"]).alias("inferred"),
        size(lambda c: c["failed"]).alias("failed_citations"), size(lambda c: c["cited"] & c["position"].isNull()).alias("unlocated"),
    )
    with_span = F.transform(F.filter(every, lambda c: c["cited"]), lambda c: F.struct(*(c[k].alias(k) for k in ("id", "fact", "type", "confidence", "verbatim", "position")))).cast(f"array<{CITED}>")
    without = F.transform(F.filter(every, lambda c: ~c["cited"]), lambda c: F.struct(*(c[k].alias(k) for k in ("id", "fact", "type", "confidence")))).cast(f"array<{INFERRED}>")
    return made.select(id_col, F.struct(head.alias("summary"), with_span.alias("verbatim_facts"), without.alias("inferred_facts")).alias("result"))


def encode(result: Column, pretty: bool = True) -> Column:
    """A result as JSON, indented, with a line feed at its end; a missing position is written as null."""
    options = {"pretty": str(pretty).lower(), "ignoreNullFields": "false"}
    return F.concat(F.to_json(result, options), F.lit("\n"))
