"""The library's named queries over the standard tables. :mod:`attesta.oracle` has the SQL that gives the same rows.

Tables without replies get them from the rule in :mod:`attesta.sources.replies`, a synthetic stand-in for a model.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attesta.functions import text as T
from attesta.operators import checking, chunking, claims, report, reporting, scoring, spans
from attesta.schemas import TYPES
from attesta.plans import pipeline
from attesta.session import cut
from attesta.sources.replies import ruled, ruled_claims

CHUNK_TOKENS = 1000
SYSTEM = "Extract every fact of the text with the words it rests on."
GLEAN = "List the facts that were left out."

_found: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    _found[fn.__name__] = fn
    return fn


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_found)


def oracle_sql() -> dict[str, str]:
    from attesta.oracle import SQL

    return {k: v for k, v in SQL.items() if k in _found}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def long(c: Column) -> Column:
    return c.cast("bigint")


# Scans, functions and chunks.


@query
def q_scan_nonblank(spark, sf_dir):
    return texts(spark, sf_dir).where(~T.is_blank(F.col("text"))).select("doc_id", long(F.length(T.trim_ws(F.col("text")))).alias("n_chars"))


@query
def q_token_estimate(spark, sf_dir):
    return texts(spark, sf_dir).select("doc_id", T.estimate_tokens(F.col("text")).alias("tokens"))


@query
def q_squash(spark, sf_dir):
    return texts(spark, sf_dir).select("doc_id", F.md5(T.squash(F.col("text"))).alias("squashed"))


@query
def q_fold(spark, sf_dir):
    return texts(spark, sf_dir).select("doc_id", F.md5(T.fold(F.col("text"))).alias("folded"))


@query
def q_paragraphs(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    blocks = F.replace(F.col("html"), F.lit("</p>"), F.lit("\r\n\r\n"))
    return pages.select("page_id", F.posexplode(chunking.paragraphs(blocks)).alias("n", "p")).select("page_id", long(F.col("n")).alias("n"), F.md5("p").alias("paragraph"))


@query
def q_sentences(spark, sf_dir):
    return texts(spark, sf_dir).select("doc_id", F.posexplode(chunking.sentences(T.trim_ws(F.col("text")))).alias("n", "sentence")).withColumn("n", long(F.col("n")))


@query
def q_hard_cuts(spark, sf_dir):
    plain = T.trim_ws(F.regexp_replace("text", r"[.!?\n]", ""))
    rows = texts(spark, sf_dir).select("doc_id", plain.alias("s")).where("s <> ''")
    return rows.select("doc_id", F.posexplode(chunking.hard_cuts(F.col("s"), 100, T.estimate_tokens(F.col("s")))).alias("n", "piece")).select("doc_id", long(F.col("n")).alias("n"), F.md5("piece").alias("piece"))


@query
def q_units(spark, sf_dir):
    rows = texts(spark, sf_dir).where(~T.is_blank(F.col("text")))
    return rows.select("doc_id", F.posexplode(chunking.units(T.trim_ws(F.col("text")), CHUNK_TOKENS)).alias("k", "u")).select("doc_id", long(F.col("k")).alias("k"), F.md5("u.text").alias("unit"), F.col("u.n").alias("tokens"))


def dealt(spark, sf_dir):
    """Texts dealt out by document before the costly steps: all that follows stays with its document, and a file of one row group keeps no core idle."""
    return texts(spark, sf_dir).repartition("doc_id")


def chunks_of(spark, sf_dir):
    return chunking.chunks(dealt(spark, sf_dir), CHUNK_TOKENS)


@query
def q_chunks(spark, sf_dir):
    return chunks_of(spark, sf_dir).select("doc_id", long(F.col("chunk_no")).alias("chunk_no"), F.md5("chunk_text").alias("chunk"), T.estimate_tokens(F.col("chunk_text")).alias("tokens"))


@query
def q_chunk_stats(spark, sf_dir):
    return chunks_of(spark, sf_dir).groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"), F.max(T.estimate_tokens(F.col("chunk_text"))).alias("largest"))


@query
def q_budget_fit(spark, sf_dir):
    return chunking.fits(chunks_of(spark, sf_dir), SYSTEM, GLEAN, 2500, passes=2)


@query
def q_writer_key(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.writer_key(F.col("text")).alias("key"))


@query
def q_checker_key(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.checker_key(F.col("text")).alias("key"))


@query
def q_shorten(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.shorten(F.col("text"), 70).alias("short"), T.took(F.col("turn") * 700).alias("took"))


# Messages and replies.


@query
def q_thread(spark, sf_dir):
    made = claims.thread(table(spark, sf_dir, "conversations"), "conv_id", "turn")
    return made.select("conv_id", F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n").alias("thread"))


@query
def q_merge(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("chunk_no"), F.lit(1).alias("pass_no"), F.posexplode(chunking.sentences(T.trim_ws(F.col("text")))).alias("ord", "fact"))
    return claims.merge(turns).select("doc_id", long(F.col("id")).alias("id"), long(F.col("chunk_no")).alias("chunk_no"), "fact")


@query
def q_guards(spark, sf_dir):
    marks = F.array(F.lit(""), *map(F.lit, claims.TRACE_MARKERS))
    turns = table(spark, sf_dir, "conversations")
    content = F.concat(F.element_at(marks, (F.col("conv_id") % 4).cast("int") + 1), F.col("text"), F.element_at(marks, (F.col("turn") % 4).cast("int") + 1))
    rows = turns.select("conv_id", "turn", content.alias("content"), F.when(F.col("turn") % 3 == 0, F.lit("length")).otherwise(F.lit("stop")).alias("done"))
    return rows.select("conv_id", "turn", claims.truncated(F.col("done")).alias("truncated"), claims.leak(F.col("content")).alias("leak"))


@query
def q_parse_props(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


def replies_of(spark, sf_dir):
    return ruled(chunks_of(spark, sf_dir))


#: How each eleventh reply is spoilt, by rest; the others are sound, the last of them with other keys.
SPOILT = {1: " more", 2: "", 3: '{"facts": [{"id": "1"}]}', 4: '{"facts": [{"id": 9223372036854775808}]}', 5: '{"facts": 3}', 6: '{"facts": [], "x": NaN}'}


def spoilt(spark, sf_dir):
    k = (F.col("doc_id") + F.col("chunk_no")) % 11
    content = F.when(k == 1, F.concat("content", F.lit(SPOILT[1])))
    for n in range(2, 7):
        content = content.when(k == n, F.lit(SPOILT[n]))
    content = content.when(k == 8, F.concat("content", F.lit(claims.TRACE_MARKERS[1])))
    content = content.when(k == 9, F.concat(F.lit('{"facts": [{"id": 3000000000}], "FACTS": '), F.substring("content", 10, 1 << 30)))
    return replies_of(spark, sf_dir).withColumns({"content": content.otherwise(F.col("content")), "done_reason": F.when(k == 7, F.lit("length")).otherwise(F.col("done_reason"))})


@query
def q_dead_letter(spark, sf_dir):
    """Replies that cannot be used, which the dead letter takes, and how many are left of the document."""
    parsed = claims.parse(spoilt(spark, sf_dir))
    return parsed.groupBy("doc_id").agg(F.count_if(F.col("reason").isNotNull()).alias("rejected"), F.count_if(F.col("reason").isNull()).alias("accepted"), F.max("reason").alias("reason"))


@query
def q_parse_replies(spark, sf_dir):
    """Replies of which some are cut short, leak a trace or are spoilt in one of several ways."""
    return claims.parse(spoilt(spark, sf_dir)).select("doc_id", long(F.col("chunk_no")).alias("chunk_no"), "reason", long(F.size("facts")).alias("facts"))


@query
def q_token_accounting(spark, sf_dir):
    return claims.accounting(replies_of(spark, sf_dir).withColumn("pass_no", F.col("chunk_no") % 2 + 1).withColumn("thinking", F.substring("content", 1, 40)))


# Claims checked, merged, placed.


def verified_of(spark, sf_dir, pieces: DataFrame | None = None):
    """Claims of the rule's replies checked against their chunk, without the way through JSON."""
    met = (chunks_of(spark, sf_dir) if pieces is None else pieces).withColumn("pass_no", F.lit(1)).withColumn("facts", ruled_claims(F.col("chunk_text"), F.col("doc_id") + F.col("chunk_no")))
    return claims.exploded(claims.checked(met))


def placed_of(spark, sf_dir):
    return report.located(claims.merge(verified_of(spark, sf_dir), together=True), texts(spark, sf_dir))


@query
def q_verify(spark, sf_dir):
    return verified_of(spark, sf_dir).select("doc_id", long(F.col("chunk_no")).alias("chunk_no"), long(F.col("ord")).alias("ord"), "status", "verbatim")


@query
def q_verify_replies(spark, sf_dir):
    """The same claims by way of JSON replies, parsing and the join of replies to chunks."""
    pieces = chunks_of(spark, sf_dir)
    return claims.verify_counts(claims.verify(claims.parse(ruled(pieces)), pieces))


@query
def q_extract(spark, sf_dir):
    """The whole plan, from texts by way of JSON replies to results."""
    made = pipeline.extract(texts(spark, sf_dir).where(~T.is_blank(F.col("text"))), ruled, CHUNK_TOKENS, on_error="capture")["results"]
    return made.select("doc_id", *(F.col(f"result.summary.{k}").cast("bigint").alias(k) for k in ("total", "verbatim", "inferred", "failed_citations", "unlocated")), long(F.size("result.verbatim_facts")).alias("cited"), long(F.size("result.inferred_facts")).alias("listed"))


@query
def q_verify_counts(spark, sf_dir):
    return claims.verify_counts(verified_of(spark, sf_dir))


@query
def q_null_matrix(spark, sf_dir):
    state = F.when(F.col("verbatim").isNotNull(), "verified").when(report.failed(F.col("verbatim"), F.col("confidence")), "failed").otherwise("inference")
    return verified_of(spark, sf_dir).groupBy("confidence", state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


@query
def q_position(spark, sf_dir):
    return placed_of(spark, sf_dir).where("position IS NOT NULL").select("doc_id", long(F.col("id")).alias("id"), long(F.col("position.line")).alias("line"), long(F.col("position.column")).alias("col"))


@query
def q_cited(spark, sf_dir):
    return report.cited(placed_of(spark, sf_dir)).select("doc_id", long(F.col("id")).alias("id"), "type", "confidence", "verbatim", long(F.col("position.line")).alias("line"))


@query
def q_inferred(spark, sf_dir):
    return report.inferred(placed_of(spark, sf_dir)).withColumn("id", long(F.col("id")))


@query
def q_summary(spark, sf_dir):
    return report.summary(placed_of(spark, sf_dir), texts(spark, sf_dir))


@query
def q_type_histogram(spark, sf_dir):
    return placed_of(spark, sf_dir).groupBy("doc_id", "type").agg(F.count(F.lit(1)).alias("n"))


@query
def q_result_json(spark, sf_dir):
    """Whole results as indented JSON; here its size and the summary read back from it."""
    made = report.build(placed_of(spark, sf_dir), texts(spark, sf_dir)).select("doc_id", report.encode(F.col("result")).alias("json"))
    return made.select("doc_id", *(F.get_json_object("json", f"$.summary.{k}").cast("bigint").alias(k) for k in ("total", "verbatim", "inferred", "failed_citations", "unlocated")))


# Gold spans and scores.


def gold_of(spark, sf_dir):
    """Gold spans for every document: each sentence upper-cased, and for some a benchmark item that most documents lack."""
    docs = dealt(spark, sf_dir).where(~T.is_blank(F.col("text")))
    own = docs.select("doc_id", F.posexplode(chunking.sentences(T.trim_ws(F.col("text")))).alias("gold_no", "s"))
    own = own.select("doc_id", "gold_no", T.shout(F.col("s")).alias("verbatim"), F.element_at(F.array(*map(F.lit, TYPES)), (F.col("gold_no") % 7).cast("int") + 1).alias("type"))
    items = table(spark, sf_dir, "benchmark")
    lacking = docs.select("doc_id").join(items, F.col("doc_id") == F.col("item_id") * 7).select("doc_id", F.lit(1000000).alias("gold_no"), F.col("text").alias("verbatim"), F.lit(None).cast("string").alias("type"))
    return own.union(lacking).withColumn("case", F.col("doc_id"))


@query
def q_anchors(spark, sf_dir):
    made = scoring.anchored(gold_of(spark, sf_dir), texts(spark, sf_dir))
    return made.select("doc_id", F.inline("gold")).select("doc_id", long(F.col("gold_no")).alias("gold_no"), "anchor")


def scores_of(spark, sf_dir, merged: DataFrame | None = None):
    merged = claims.merge(verified_of(spark, sf_dir), together=True) if merged is None else merged
    return scoring.score(scoring.matches(scoring.anchored(gold_of(spark, sf_dir), texts(spark, sf_dir)), merged))


@query
def q_score(spark, sf_dir):
    return scores_of(spark, sf_dir)


@query
def q_run_totals(spark, sf_dir):
    return scoring.run_totals(scores_of(spark, sf_dir))


def records_of(spark, sf_dir):
    """Chunks and checked claims are made once and kept: scores, counts and tokens all read them."""
    pieces = cut(chunks_of(spark, sf_dir), spark)
    verified = cut(verified_of(spark, sf_dir, pieces), spark)
    chunks = pieces.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"))
    by_case = lambda df: df.withColumnRenamed("doc_id", "case")
    return scoring.case_records(scores_of(spark, sf_dir, claims.merge(verified)), by_case(claims.verify_counts(verified)), by_case(claims.accounting(ruled(pieces))), by_case(chunks), None)


@query
def q_case_records(spark, sf_dir):
    names = ("case", "pass", "gold", "matched", "missed", "unanchored", "extracted", "type_mismatch", "inferred", "fabricated", "chunks", "prompt_tokens", "eval_tokens", "extra_requests")
    return records_of(spark, sf_dir).select(*names, *(F.col(f"verify.{k}").alias(k) for k in ("exact", "repaired", "dropped")), F.element_at(reporting.case_lines(), 1).alias("line"))


@query
def q_run_record(spark, sf_dir):
    """One row for the whole run; its time is left out."""
    records = cut(records_of(spark, sf_dir), spark)  # read for the cases and for their totals
    made = pipeline.run_record(records, scoring.run_totals(records), "m", False, 1, CHUNK_TOKENS, 4096, 12)
    return made.select("model", "think", long(F.col("passes")).alias("passes"), long(F.col("num_ctx")).alias("num_ctx"), "pass", long(F.size("cases")).alias("listed"), *(F.col(f"totals.{k}").alias(k) for k in ("cases", "passed", "gold", "matched", "missed", "extracted", "fabricated")))


@query
def q_scoreboard(spark, sf_dir):
    orders = table(spark, sf_dir, "lineitem")
    rows = orders.groupBy(F.col("l_orderkey").alias("case"), F.concat(F.lit("model "), F.col("l_linenumber").cast("string")).alias("model")).agg(F.sum(F.col("l_quantity") % 5).cast("bigint").alias("matched"), F.max(F.col("l_suppkey") % 10).cast("bigint").alias("tok_s"))
    return scoring.scoreboard(rows)


@query
def q_locate_items(spark, sf_dir):
    """Benchmark items in documents that share a sentence with them: found where, and at which line."""
    docs = texts(spark, sf_dir)
    first = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("item"), F.get(chunking.sentences(T.trim_ws(F.col("text"))), F.lit(0)).alias("s"))
    own = docs.select("doc_id", F.explode(chunking.sentences(T.trim_ws(F.col("text")))).alias("s"))
    pairs = own.join(first, "s").select("doc_id", "item_id", "item").distinct()
    found = pairs.join(docs, "doc_id").select("doc_id", "item_id", "text", spans.locate(F.col("text"), F.col("item")).alias("hit"))
    return found.select("doc_id", "item_id", long(F.col("hit.at")).alias("spot"), long(spans.position(F.col("text"), F.col("hit.at"))["line"]).alias("line"))


# The checker.


def flawed_of(spark, sf_dir, placed: DataFrame | None = None):
    """Placed claims as a result's rows, with one flaw planted in each document but every fifteenth, a kind for each rule."""
    own = Window.partitionBy("doc_id")
    kind = F.col("doc_id") % 15
    cited = F.col("verbatim").isNotNull()
    rows = (placed_of(spark, sf_dir) if placed is None else placed).withColumn("cited", cited)
    rows = rows.withColumns({"__cited": F.min(F.when(cited, F.col("id"))).over(own), "__inferred": F.min(F.when(~cited, F.col("id"))).over(own), "__first": F.min(F.when(F.col("id") == 1, F.col("fact"))).over(own)})

    def flaw(k: int, at: str, new: Column, otherwise: Column) -> Column:
        return F.when((kind == k) & (F.col("id") == (F.col(at) if at.startswith("__") else F.lit(int(at)))), new).otherwise(otherwise)

    place = F.col("position")

    def moved(line: Column, column: Column) -> Column:
        return F.when(place.isNotNull(), F.struct(line.alias("line"), column.alias("column")))

    verbatim = flaw(5, "__inferred", F.col("fact"), flaw(7, "__cited", F.lit(None), flaw(8, "__cited", T.shout(F.col("verbatim")), flaw(9, "__cited", F.concat(F.lit('"'), "verbatim", F.lit('"!')), flaw(10, "__cited", F.concat(F.lit("Zq "), "verbatim"), F.col("verbatim"))))))
    position = flaw(11, "__cited", moved(F.lit(0), place["column"]), flaw(12, "__cited", moved(place["line"] + 1000, place["column"]), flaw(13, "__cited", moved(place["line"], place["column"] + 1), place)))
    return rows.select(
        "doc_id", (F.col("id") - 1 + F.when(F.col("cited"), F.lit(0)).otherwise(F.lit(1000000))).alias("ord"), flaw(14, "2", F.lit(1), F.col("id")).alias("id"),
        flaw(1, "__cited", F.lit(" "), flaw(4, "2", T.high(F.col("__first")), F.col("fact"))).alias("fact"), flaw(2, "__cited", F.lit("guess"), F.col("type")).alias("type"),
        flaw(3, "__cited", F.lit("sure"), F.col("confidence")).alias("confidence"), verbatim.alias("verbatim"), position.alias("position"), "cited",
    )


@query
def q_check_findings(spark, sf_dir):
    rows = checking.judged(flawed_of(spark, sf_dir), texts(spark, sf_dir))
    return checking.findings(rows).groupBy("doc_id", "kind", "step").agg(F.count(F.lit(1)).alias("n"), F.min("message").alias("message")).withColumn("step", long(F.col("step")))


@query
def q_check_spans(spark, sf_dir):
    rows = checking.judged(flawed_of(spark, sf_dir), texts(spark, sf_dir))
    return rows.where("span_class IS NOT NULL").groupBy("doc_id", "span_class", "position_class").agg(F.count(F.lit(1)).alias("n"))


@query
def q_check_ids(spark, sf_dir):
    return checking.id_problems(flawed_of(spark, sf_dir))


@query
def q_check_duplicates(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("t"), F.posexplode(chunking.sentences(T.trim_ws(F.col("text")))).alias("k", "fact"))
    rows = turns.select("doc_id", (F.col("t") * 10000 + F.col("k")).alias("ord"), (F.col("t") * 10000 + F.col("k")).alias("id"), "fact", F.lit("other").alias("type"), F.lit("low").alias("confidence"), F.lit(None).cast("string").alias("verbatim"), F.lit(None).cast("struct<line:int,column:int>").alias("position"), F.lit(False).alias("cited"))
    return checking.judged(rows, None).where("duplicate_of IS NOT NULL").select("doc_id", long(F.col("ord")).alias("ord"), long(F.col("duplicate_of")).alias("duplicate_of"))


@query
def q_check_summary(spark, sf_dir):
    """Stated counts against claims, where each fifth document states one claim too many."""
    placed = cut(placed_of(spark, sf_dir), spark)
    rows = flawed_of(spark, sf_dir, placed)
    stated = report.summary(placed).select("doc_id", F.struct((F.col("total") + F.when(F.col("doc_id") % 5 == 0, 1).otherwise(0)).alias("total"), "verbatim", "inferred", "failed_citations", "unlocated").alias("summary"))
    decoded = stated.select("doc_id", F.struct("summary").alias("decoded"), F.lit(None).cast("string").alias("error"))
    return checking.summary_problems(decoded, rows).withColumn("step", long(F.col("step")))


def checked_of(spark, sf_dir):
    made = report.build(placed_of(spark, sf_dir), texts(spark, sf_dir)).select("doc_id", report.encode(F.col("result")).alias("content"))
    return checking.check(made, texts(spark, sf_dir))


@query
def q_check_results(spark, sf_dir):
    """Whole results encoded, strictly decoded and checked against their sources."""
    return checked_of(spark, sf_dir).select("doc_id", "facts", "checked", "exact", "recased", "edge_dirty", "null_inferred", "failed_citations", "positioned", "unlocated", "error", "ok")


@query
def q_check_lines(spark, sf_dir):
    """What a person reads about each checked result."""
    return reporting.check_lines(checked_of(spark, sf_dir)).select("doc_id", F.concat_ws("\n", F.slice("lines", 1, 3), F.element_at("lines", -1)).alias("lines"))


#: Would-be results, by rest of the number, and what the decoder says of each.
RESULTS = {
    1: "{}", 2: '{"facts": []}', 3: '{"summary": {"total": 1.5}}', 4: '{"verbatim_facts": [{"id": 9223372036854775807, "position": {"line": 1}}]} more', 5: '{"inferred_facts": {}}',
    6: '{"SUMMARY": null, "inferred_facts": [{"verbatim": null, "fact": 3}]}', 7: '{"verbatim_facts": [{"positions": null}]}', 8: "null", 9: "[1]",
}


@query
def q_strict_decode(spark, sf_dir):
    """Would-be results: properties of events, and some that are results or nearly so."""
    content = F.col("props")
    for k, text in RESULTS.items():
        content = F.when(F.col("event_id") % 10 == k, F.lit(text)).otherwise(content)
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), content.alias("content"))
    return checking.decode(rows).select("doc_id", "error", long(F.size("decoded.verbatim_facts")).alias("cited"))
