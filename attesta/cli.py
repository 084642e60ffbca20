"""The command line: ``python -m attesta run|benchmark|check``.

Exit codes: 0 done; 1 an error, a failed case or a result with problems; 2 wrong use, or files that cannot be read by ``check``; 130 interrupted.
"""

from __future__ import annotations

import argparse
import os
import sys
import time
from dataclasses import replace

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from attesta.operators import checking, claims, report, reporting
from attesta.plans import pipeline
from attesta.session import local_session
from attesta.sources import prompts, replies, sinks, texts
from attesta.sources.settings import Settings, load

INPUT, OUTPUT, CORPUS, RECORD, RAW = "prompt.md", "result.json", "corpus", "benchmark.json", "result.raw"


def say(*lines: str) -> None:
    for line in lines:
        print(line, file=sys.stderr)


def arguments(args: list[str]) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="attesta", description="Traceable claims from texts.")
    jobs = parser.add_subparsers(dest="job", required=True)
    for name, what in (("run", f"claims of {INPUT}, to {OUTPUT}"), ("benchmark", f"score the gold lists in {CORPUS}")):
        job = jobs.add_parser(name, help=what)
        job.add_argument("--folder", default=".", help="where the settings and all other files are")
        job.add_argument("--model", default="", help="instead of the one in the settings")
        job.add_argument("--no-think", action="store_true", help="without thinking, where the model can think")
    job = jobs.add_parser("check", help="check a finished result")
    job.add_argument("result")
    job.add_argument("--source", default="", help="the text that it was made from")
    return parser.parse_args(args)


def prepared(options: argparse.Namespace, post, get) -> tuple[Settings, replies.Extractor]:
    """The settings of a run, and an extractor for a server that was found to have the model."""
    settings = load(options.folder)
    settings = replace(settings, model=options.model.strip() or settings.model)
    system, schema = prompts.prompt(settings), prompts.schema(settings)
    replies.preflight(settings, get=get)
    settings = replace(settings, think=replies.wanted_thinking(settings, options.no_think, post))
    return settings, replies.live(settings, system, post=post, schema=schema)


def fitting(spark: SparkSession, docs, settings: Settings, system: str) -> None:
    """An error where a request of a document does not fit the context."""
    over = pipeline.chunking.fits(pipeline.chunking.chunks(docs, settings.chunk_tokens), system, replies.GLEAN, settings.num_ctx, settings.passes).where("NOT fits").first()
    if over:
        raise ValueError(f"the largest request needs about {over.needed} tokens, but num_ctx is {settings.num_ctx}: lower chunk_tokens or passes, or raise num_ctx")


def run(spark: SparkSession, options: argparse.Namespace, post, get) -> int:
    settings, extractor = prepared(options, post, get)
    path = settings.resolve(INPUT)
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if not text.strip():
        raise ValueError(f"{path} is empty")
    began, docs = time.time(), spark.createDataFrame([(1, text)], "doc_id long, text string")
    fitting(spark, docs, settings, prompts.prompt(settings))
    made = pipeline.extract(docs, extractor, settings.chunk_tokens, settings.resolve(RAW))
    row = made["results"].select("result.summary", report.encode(F.col("result")).alias("json")).first()
    dest = settings.resolve(OUTPUT)
    with open(dest, "w", encoding="utf-8") as f:
        f.write(row.json)
    about = made["results"].select("doc_id", "result.summary").join(made["counts"].select("doc_id", F.struct("exact", "repaired", "dropped").alias("verify")), "doc_id", "left")
    tokens = claims.accounting(made["replies"])
    about = about.join(tokens.select("doc_id", F.struct(*(c for c in tokens.columns if c != "doc_id")).alias("tokens")), "doc_id", "left")
    say(*about.select(reporting.run_lines().alias("x")).first().x, f"wrote {dest} in {time.time() - began:.1f} s")
    return 0


def benchmark(spark: SparkSession, options: argparse.Namespace, post, get) -> int:
    settings, extractor = prepared(options, post, get)
    folder, began = settings.resolve(CORPUS), time.time()
    gold = texts.read_gold(spark, folder)
    sources = [r.source for r in gold.select("source").distinct().collect()]  # one for each gold list
    rows = []
    for k, name in enumerate(sources):
        with open(os.path.join(folder, name), encoding="utf-8") as f:
            rows.append((k, name, f.read()))
    named = spark.createDataFrame(rows, "doc_id long, source string, text string")
    fitting(spark, named, settings, prompts.prompt(settings))
    made = pipeline.benchmark(named.select("doc_id", "text"), gold.join(named.select("doc_id", "source"), "source"), extractor, settings.chunk_tokens)
    for r in made["records"].select("case", reporting.case_lines().alias("x")).orderBy("case").toLocalIterator():
        say(*r.x)
    totals = made["totals"].first()
    say(f"{totals.passed} of {totals.cases} cases passed")
    record = pipeline.run_record(made["records"], made["totals"], settings.model, settings.think, settings.passes, settings.chunk_tokens, settings.num_ctx, int(1000 * (time.time() - began)))
    sinks.write_record(record, settings.resolve(RECORD))
    return 0 if totals["pass"] else 1


def check(spark: SparkSession, options: argparse.Namespace) -> int:
    try:
        found = []
        for path in filter(None, (options.result, options.source)):
            with open(path, encoding="utf-8") as f:
                found.append(f.read())
    except (OSError, UnicodeDecodeError) as e:
        say(f"error: {e}")
        return 2
    results = spark.createDataFrame([(options.result, found[0])], "name string, content string")
    source = spark.createDataFrame([(options.result, found[1])], "name string, text string") if options.source else None
    row = reporting.check_lines(checking.check(results, source, "name"), "name").first()
    print(options.result, *(f"  {line}" for line in row.lines), sep="\n")
    return 2 if row.error is not None else 0 if row.ok else 1


def main(args: list[str], spark: SparkSession | None = None, post=replies._post, get=replies._get) -> int:
    try:
        options = arguments(args)
    except SystemExit as e:
        return int(e.code or 0)
    try:
        spark = spark or local_session(os.cpu_count() or 1)
        if options.job == "check":
            return check(spark, options)
        return (run if options.job == "run" else benchmark)(spark, options, post, get)
    except KeyboardInterrupt:
        say("interrupted")
        return 130
    except Exception as e:  # noqa: BLE001
        say(f"error: {str(e).splitlines()[0] if str(e) else type(e).__name__}")
        return 1
