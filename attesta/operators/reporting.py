"""Lines for people about a run: what was extracted, how cases were scored, what the checker found. Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions.text import shorten

from .checking import summary_text


def _line(test: Column | None, *parts) -> Column:
    text = F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    return text if test is None else F.when(test, text)


def _lines(*lines: Column) -> Column:
    return F.array_compact(F.array(*lines))


def run_lines(summary: str = "summary", counts: str = "verify", tokens: str = "tokens") -> Column:
    """About one extraction: ``summary`` as results have it, ``verify (exact, repaired, dropped)`` and ``tokens`` as accounted for."""
    s, v, t = F.col(summary), F.col(counts), F.col(tokens)
    return _lines(
        _line(None, s["total"], " facts, ", s["verbatim"], " cited and ", s["inferred"], " inferred"),
        _line((v["exact"] + v["repaired"] + v["dropped"]) > 0, "spans: ", v["exact"], " exact, ", v["repaired"], " put into the source's words, ", v["dropped"], " not found"),
        _line(s["unlocated"] > 0, s["unlocated"], " cited without a place in the whole text"),
        _line(None, "tokens: ", t["prompt_tokens"], " read, ", t["eval_tokens"], " written"),
        _line(t["think_chars"] > 0, "thinking: ", t["think_chars"], " bytes"),
        _line(t["extra_requests"] > 0, "further passes: ", t["extra_requests"], " requests, ", t["extra_prompt_tokens"], " tokens read, ", t["extra_eval_tokens"], " written"),
    )


def case_lines(case_col: str = "case") -> Column:
    """About one scored case: a row of :func:`attesta.operators.scoring.case_records`."""
    c = F.col
    problems = F.transform(F.coalesce(c("validation.problems"), F.array().cast("array<string>")), lambda p: F.concat(F.lit("  checker: "), p))
    lines = _lines(
        _line(None, c(case_col), F.when(c("pass"), F.lit(": pass, ")).otherwise(F.lit(": fail, ")), c("matched"), " of ", c("gold"), " gold spans, ", c("extracted"), " facts from ", c("chunks"), " chunks"),
        _line(c("unanchored") > 0, "  ", c("unanchored"), " gold spans are not in the source"),
        _line(c("type_mismatch") > 0, "  ", c("type_mismatch"), " of another type than the gold list says"),
        _line(c("fabricated") > 0, "  ", c("fabricated"), " citations failed"),
        _line(c("inferred") > 0, "  ", c("inferred"), " inferred"),
        _line(c("verify.repaired") > 0, "  ", c("verify.repaired"), " spans put into the source's words"),
        _line(c("validation.error").isNotNull(), "  checker: ", c("validation.error")),
        _line(F.coalesce(c("validation.ok"), F.lit(False)), "  checker: good, ", c("validation.exact"), " of ", c("validation.checked"), " spans exact"),
    )
    return F.concat(lines, problems)


def missed_lines(gold: str = "gold", picked: str = "picked") -> Column:
    """The gold spans that no extracted span matched, from a row of :func:`attesta.operators.scoring.matches`."""
    lost = F.filter(F.arrays_zip(F.col(gold).alias("gold"), F.col(picked).alias("picked")), lambda p: p["picked"] == -1)
    return F.transform(lost, lambda p: F.concat(F.lit("  missed: "), shorten(p["gold"]["verbatim"], 70)))


def check_lines(checked: DataFrame, name_col: str = "doc_id") -> DataFrame:
    """``name_col, ok, error, lines`` of :func:`attesta.operators.checking.check` rows."""
    noted = lambda head, notes: F.when(F.size(notes) > 0, F.concat(F.array(F.concat(F.lit(head), F.size(notes).cast("string"))), F.transform(notes, lambda x: F.concat(F.lit("  "), x)))).otherwise(F.array().cast("array<string>"))
    verdict = F.array(F.when(F.col("ok"), F.lit("pass")).otherwise(F.lit("fail")))
    lines = F.concat(F.split(summary_text(), "\n"), noted("warnings: ", F.col("warnings")), noted("problems: ", F.col("problems")), verdict)
    return checked.select(name_col, "ok", "error", F.when(F.col("error").isNull(), lines).otherwise(F.array(F.concat(F.lit("error: "), F.col("error")))).alias("lines"))
