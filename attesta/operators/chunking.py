"""Texts into chunks within a token budget: paragraphs, then sentences, then hard cuts, packed greedily in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions.text import NARROW, Counter, estimate_tokens, is_blank, trim_ws

UNIT = "struct<text:string,n:bigint>"
_PACKED = "struct<done:array<string>,cur:array<string>,n:bigint>"


def paragraphs(c: Column) -> Column:
    """Trimmed blocks between empty lines, none empty; CRLF counts as LF."""
    blocks = F.filter(F.transform(F.split(F.replace(c, F.lit("\r\n"), F.lit("\n")), "\n\n"), trim_ws), lambda x: x != "")
    return F.when(F.size(blocks) > 0, blocks).otherwise(F.array(trim_ws(c)))


def sentences(c: Column) -> Column:
    """Trimmed sentences, none empty: a break follows ``.``, ``!``, ``?`` or a line feed where narrow white space comes next."""
    parts = F.filter(F.transform(F.split(c, rf"(?<=[.!?\n])(?={NARROW})"), trim_ws), lambda x: x != "")
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(c))


def hard_cuts(c: Column, most: int, measured: Column) -> Column:
    """Pieces of a text that no sentence break divides: cut at the last narrow white space in the budget's upper half, else at it.

    Consecutive characters are taken by one expression whose bounds are the row's own budget.
    """
    budget = F.greatest(F.lit(200), (F.lit(float(most)) * (F.length(c).cast("double") / measured.cast("double")) * 0.9).cast("int"))
    half = F.floor(budget / 2).cast("int")
    text = lambda x: x.cast("string")
    pattern = F.concat(F.lit("(?s).{1,"), text(budget), F.lit("}\\z|.{"), text(half + 1), F.lit(","), text(budget), F.lit(f"}}(?={NARROW})|.{{"), text(budget), F.lit("}"))
    return F.transform(F.regexp_extract_all(c, pattern, 0), trim_ws)


def units(c: Column, most: int, counter: Counter = estimate_tokens) -> Column:
    """Sized pieces in order: paragraphs that fit, else their sentences that fit, else hard cuts."""

    def sized(x: Column) -> Column:
        return F.struct(x.alias("text"), counter(x).cast("bigint").alias("n"))

    def of_sentence(s: Column) -> Column:
        return F.when(counter(s) <= most, F.array(sized(s))).otherwise(F.transform(hard_cuts(s, most, counter(s)), sized))

    def of_paragraph(p: Column) -> Column:
        return F.when(counter(p) <= most, F.array(sized(p))).otherwise(F.flatten(F.transform(sentences(p), of_sentence)))

    return F.flatten(F.transform(paragraphs(c), of_paragraph))


def pack(of: Column, most: int, separator: str = "\n\n") -> Column:
    """Consecutive units joined while their counts stay within ``most``; one unit may exceed it alone."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.array().cast("array<string>").alias("cur"), F.lit(0).cast("bigint").alias("n"))

    def put(acc: Column, u: Column) -> Column:
        full = (acc["n"] > 0) & (acc["n"] + u["n"] > most)
        done = F.when(full, F.array_append(acc["done"], F.array_join(acc["cur"], separator))).otherwise(acc["done"])
        cur = F.when(full, F.array(u["text"])).otherwise(F.array_append(acc["cur"], u["text"]))
        return F.struct(done.alias("done"), cur.alias("cur"), F.when(full, u["n"]).otherwise(acc["n"] + u["n"]).alias("n")).cast(_PACKED)

    return F.aggregate(of, start.cast(_PACKED), put, lambda acc: F.when(acc["n"] > 0, F.array_append(acc["done"], F.array_join(acc["cur"], separator))).otherwise(acc["done"]))


def split(c: Column, most: int, counter: Counter = estimate_tokens) -> Column:
    """The chunks of a text; a text that fits is one chunk as it is, trimmed."""
    if most <= 0:
        raise ValueError("a chunk's budget must be positive")
    whole = trim_ws(c)
    return F.when(counter(whole) <= most, F.array(whole)).otherwise(pack(units(whole, most, counter), most))


def chunks(docs: DataFrame, most: int = 1000, counter: Counter = estimate_tokens, id_col: str = "doc_id", text_col: str = "text", on_blank: str = "skip") -> DataFrame:
    """``id_col, chunk_no, chunk_text``. Blank texts: skipped, or with ``on_blank='fail'`` an error."""
    blank = F.coalesce(is_blank(F.col(text_col)), F.lit(True))
    if on_blank == "fail":
        text = F.when(blank, F.raise_error(F.concat(F.lit("blank text in document "), F.col(id_col).cast("string")))).otherwise(F.col(text_col))
        docs = docs.select(id_col, text.alias(text_col))
    else:
        docs = docs.where(~blank).select(id_col, text_col)
    return docs.select(id_col, F.posexplode(split(F.col(text_col), most, counter)).alias("chunk_no", "chunk_text"))


def fits(docs_chunks: DataFrame, system_text: str, glean_text: str, num_ctx: int, passes: int = 1, id_col: str = "doc_id", counter: Counter = estimate_tokens) -> DataFrame:
    """``id_col, chunks, largest, needed, fits``: whether every request of a document fits the context."""
    passes = max(1, passes)
    size = lambda t: len(t) * 10 // 36 + 1
    by = docs_chunks.groupBy(id_col).agg(F.count(F.lit(1)).alias("chunks"), F.max(counter(F.col("chunk_text"))).alias("largest"))
    extra = (passes - 1) * (F.col("largest") + size(glean_text)) if passes > 1 else F.lit(0)
    needed = F.lit(size(system_text)) + F.col("largest") + F.floor(F.col("largest") / 2).cast("bigint") + 512 + extra
    return by.withColumn("needed", needed).withColumn("fits", F.col("needed") <= num_ctx)
