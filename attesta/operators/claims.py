"""Replies into claims: guards, parsing, verification against the chunk, merging."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from attesta.functions import batches, strictjson
from attesta.functions.text import writer_key
from attesta.schemas import CLAIM, REPLY
from attesta.session import ship

#: Signs of a reasoning trace left in a reply, in the order they are looked for: fixed values.
TRACE_MARKERS = ("<|think|>", "<|channel>", "<channel|>")


def leak(content: Column) -> Column:
    """The first marker, in list order, that a reply holds; else null."""
    found = F.when(F.contains(content, F.lit(TRACE_MARKERS[0])), F.lit(TRACE_MARKERS[0]))
    for marker in TRACE_MARKERS[1:]:
        found = found.when(F.contains(content, F.lit(marker)), F.lit(marker))
    return found


def truncated(done_reason: Column) -> Column:
    return F.coalesce(done_reason == "length", F.lit(False))


def parse(replies: DataFrame) -> DataFrame:
    """``replies`` with ``facts`` (null where the content is no reply) and ``reason`` (truncated, leaked, unparsable or null).

    Keys match whatever their case, of equal ones the last counts, unknown keys are ignored, missing fields are empty. Wrong
    types, numbers beyond 64 bits and text after the value are errors, which the native JSON reader would let pass; so
    content is checked by a function over Arrow batches.
    """
    ship(replies.sparkSession)

    def load(read: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in read:
            made = [normal(x) for x in batch.column(batch.schema.get_field_index("content")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string())], [*batch.schema.names, "__json"])

    kept = replies.drop("facts", "reason")
    parsed = kept.mapInArrow(load, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema) + ", __json string")
    reason = F.when(truncated(F.col("done_reason")), F.lit("truncated")).when(leak(F.col("content")).isNotNull(), F.lit("leaked")).when(F.col("__json").isNull(), F.lit("unparsable"))
    return parsed.withColumn("reason", reason).withColumn("facts", F.when(F.col("reason").isNull(), F.coalesce(F.from_json("__json", REPLY)["facts"], F.array().cast(f"array<{CLAIM}>")))).drop("__json")


_FIELDS = {"id": int, "fact": str, "type": str, "confidence": str, "verbatim": str}
_EMPTY = {"id": 0, "fact": "", "type": "", "confidence": "", "verbatim": None}


def _facts(value, where: str) -> list[dict]:
    if not isinstance(value, list) or isinstance(value, strictjson.Pairs):
        raise strictjson.Bad(f"{where} is no array")
    return [_EMPTY | (strictjson.record(x, _FIELDS, where, True, ("verbatim",)) if x is not None else {}) for x in value]


def normal(content: str | None) -> str | None:
    """A reply's content with the wanted keys alone, as JSON; null where it is no valid reply."""
    try:
        value = strictjson.whole(content)
        found = {} if value is None else strictjson.record(value, {"facts": _facts}, "reply", True, ("facts",))
    except (ValueError, RecursionError):
        return None
    return json.dumps({"facts": found.get("facts", [])})


def verify(parsed: DataFrame, chunks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Claims of accepted replies checked against their own chunk: ``id_col, chunk_no, pass_no, ord`` and the claim with ``status``.

    A reply meets its chunk once, with its claims still in an array, so a chunk's text is never repeated per claim.
    """
    met = parsed.where(F.col("reason").isNull()).select(id_col, "chunk_no", "pass_no", "facts").join(chunks.select(id_col, "chunk_no", "chunk_text"), [id_col, "chunk_no"])
    return exploded(checked(met), id_col)


def checked(met: DataFrame) -> DataFrame:
    """``met (chunk_text, facts, ...)`` without the text, with the span of every claim checked and its ``status``: none, exact,
    repaired or dropped. A chunk is folded once for all its claims.

    A span found otherwise than written is replaced by the text's own characters; one not found becomes null. The
    confidence never changes.
    """
    kind = {f.name: f.dataType for f in met.schema["facts"].dataType.elementType}
    facts = F.transform("facts", lambda f: F.struct(*(f[k].alias(k) for k in ("id", "fact", "type", "confidence", "verbatim"))))
    new = StructType([StructField("verbatim", kind["verbatim"]), StructField("status", StringType())])
    return batches.judged(met.withColumn("facts", facts), "facts", "chunk_text", ["verbatim"], new, _spans_checked)


def _spans_checked(text: str | None, values: list[list]) -> Iterator[tuple[str | None, str]]:
    ready = batches.Folded(text or "")
    for span in values[0]:
        found = None if span is None else ready.locate(span)
        if found is None:
            yield None, "none" if span is None else "dropped"
        else:
            yield found[0], "exact" if found[0] == span else "repaired"


def exploded(met: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return met.select(id_col, "chunk_no", "pass_no", F.posexplode("facts").alias("ord", "claim")).select(id_col, "chunk_no", "pass_no", "ord", "claim.*")


def any_changed(exact: Column, repaired: Column, dropped: Column) -> Column:
    """Whether the check of spans had anything to count but exact ones."""
    return (repaired > 0) | (dropped > 0)


def verify_counts(claims: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``exact, repaired, dropped`` per document, before merging."""
    return claims.groupBy(id_col).agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("exact", "repaired", "dropped")))


def merge(claims: DataFrame, id_col: str = "doc_id", together: bool = False) -> DataFrame:
    """Claims in order of chunk, pass and place, the first of each statement alone, numbered from 1.

    Both windows partition by document first, so one shuffle serves them, or none where ``claims`` are ``together``
    by document already.
    """
    order = ["chunk_no", "pass_no", "ord"]
    keyed = claims.withColumn("__key", writer_key(F.col("fact"))).where(F.col("__key") != "")
    keyed = keyed if together else keyed.repartition(id_col)
    first = keyed.withColumn("__n", F.row_number().over(Window.partitionBy(id_col, "__key").orderBy(*order))).where("__n = 1").drop("__n", "__key")
    return first.withColumn("id", F.row_number().over(Window.partitionBy(id_col).orderBy(*order)))


def thread(turns: DataFrame, id_col: str, order_col: str) -> DataFrame:
    """``id_col, messages array<struct<role,content>>``: each conversation as one request's messages, in order."""
    return turns.groupBy(id_col).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order_col).alias("n"), "role", F.col("text").alias("content")))), lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"))


def accounting(replies: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Token and trace counts of the first pass and of further passes apart; a trace is counted in bytes."""
    first = F.col("pass_no") == 1
    trace = F.octet_length(F.coalesce("thinking", F.lit("")))

    def total(c: Column, where: Column, name: str) -> Column:
        return F.coalesce(F.sum(F.when(where, c)), F.lit(0)).cast("bigint").alias(name)

    return replies.groupBy(id_col).agg(
        total(F.col("prompt_n"), first, "prompt_tokens"), total(F.col("predicted_n"), first, "eval_tokens"), total(trace, first, "think_chars"),
        F.count_if(~first).alias("extra_requests"), total(F.col("prompt_n"), ~first, "extra_prompt_tokens"), total(F.col("predicted_n"), ~first, "extra_eval_tokens"), total(trace, ~first, "extra_think_chars"),
    )


def with_rate(replies: DataFrame) -> DataFrame:
    """``replies`` with ``tokens_per_second``."""
    return replies.withColumn("tokens_per_second", per_second(F.col("predicted_n"), F.col("eval_duration_ns")))


def per_second(predicted: Column, duration_ns: Column) -> Column:
    return F.when(duration_ns > 0, predicted / (duration_ns / 1e9)).otherwise(F.lit(0.0))
