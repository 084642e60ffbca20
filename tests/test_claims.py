"""Replies, claims, results, scores and the checker."""

import http.server
import json
import threading

import pytest
from pyspark.sql import functions as F

from attesta.cli import main
from attesta.operators import checking, claims, report, scoring
from attesta.plans import pipeline
from attesta.schemas import CONFIDENCES, REPLY_JSON_SCHEMA, TYPES
from attesta.sources import prompts, replies, sinks
from attesta.sources.settings import Service, Settings, load, valid_think
from attesta.sources.texts import read_gold, read_texts
from attesta.streaming import documents as streams

TEXT = "The mill opened in 1901. It burned down twice. Nobody was hurt."


def fact(i, text, span, confidence="high", kind="event"):
    return {"id": i, "fact": text, "type": kind, "confidence": confidence, "verbatim": span}


def reply(spark, *contents, reason="stop"):
    rows = [(1, k, 1, c, None, 10, 5, 10**9, reason) for k, c in enumerate(contents)]
    return spark.createDataFrame(rows, "doc_id long, chunk_no int, pass_no int, content string, thinking string, prompt_n int, predicted_n int, eval_duration_ns long, done_reason string")


def docs(spark, *texts):
    return spark.createDataFrame([(i + 1, t) for i, t in enumerate(texts)], "doc_id long, text string")


def test_parse_is_lenient_about_keys_and_strict_about_types(spark):
    good = [' {"FACTS": [{"Id": 1, "fact": "a", "extra": 2}]} ', '{"facts": null}', "{}", '{"facts": []}']
    good += ['{"FACTS": [{"id": 1}], "facts": [{"id": 3000000000, "fact": "a"}]}', '{"facts": [{"fact": "a"}], "x": "\\ud800"}', '{"facts": [1], "Facts": null}'][:2]
    bad = ['{"facts": [], "x": NaN}', '{"facts": [{"id": 9223372036854775808}]}', '{"facts": [{"id": "1"}]}', '{"facts": [{"id": 1.5}]}', '{"facts": 3}', '{"facts": []} more', "nope", None, "[]", '{"facts": [{"id": true}]}']
    rows = {r.chunk_no: r for r in claims.parse(reply(spark, *good, *bad)).collect()}
    assert [len(rows[k].facts) for k in range(len(good))] == [1, 0, 0, 0, 1, 1] and rows[4].facts[0].id == 3000000000 and rows[0].facts[0].fact == "a" and rows[0].facts[0].type == ""
    assert [rows[len(good) + k].reason for k in range(len(bad))] == ["unparsable"] * len(bad)


def test_guards(spark):
    rows = claims.parse(reply(spark, "x <channel|> <|think|>", '{"facts":[]}')).orderBy("chunk_no").collect()
    assert [r.reason for r in rows] == ["leaked", None]
    assert claims.parse(reply(spark, '{"facts":[]}', reason="length")).first().reason == "truncated"
    assert spark.range(1).select(claims.leak(F.lit("x <channel|> <|think|>")).alias("m")).first().m == "<|think|>"


def test_dead_letter(spark, tmp_path):
    parsed = claims.parse(reply(spark, "no", '{"facts":[]}'))
    with pytest.raises(sinks.ReplyError):
        sinks.accepted(parsed, str(tmp_path / "dead"))
    assert spark.read.json(str(tmp_path / "dead")).first().reason == "unparsable"
    assert sinks.accepted(parsed, None, "capture").count() == 1


def test_verify_merge_and_build(spark):
    said = [fact(1, "Opened.", "The mill opened in 1901."), fact(2, "Burned.", "IT BURNED DOWN TWICE"), fact(3, "Hurt.", "somebody was hurt", "medium"), fact(4, "Old.", None, "low"), fact(5, "opened", "x"), fact(6, "!!", None, "low"), fact(7, "E", "")]
    d = docs(spark, TEXT, "other text")
    made = pipeline.extract(d.where("doc_id = 1"), lambda chunks: reply(spark, json.dumps({"facts": said})))
    status = {r.ord: r.status for r in made["verified"].collect()}
    assert [status[k] for k in range(7)] == ["exact", "repaired", "dropped", "none", "dropped", "none", "dropped"]
    assert made["counts"].first().asDict() == {"doc_id": 1, "exact": 1, "repaired": 1, "dropped": 3}
    merged = made["merged"].orderBy("id").collect()
    assert [(r.id, r.fact) for r in merged] == [(1, "Opened."), (2, "Burned."), (3, "Hurt."), (4, "Old."), (5, "E")]
    assert merged[1].verbatim == "It burned down twice" and merged[2].confidence == "medium"
    r = report.build(made["placed"], d).orderBy("doc_id").collect()
    assert r[0].result.summary.asDict() == {"total": 5, "verbatim": 2, "inferred": 3, "failed_citations": 2, "unlocated": 0}
    assert [(f.id, f.position.line, f.position.column) for f in r[0].result.verbatim_facts] == [(1, 1, 1), (2, 1, 26)]
    assert r[1].result.summary.total == 0 and r[1].result.verbatim_facts == []
    out = json.loads(made["results"].select(report.encode(F.col("result")).alias("j")).first().j)
    assert "verbatim" not in out["inferred_facts"][0] and out["verbatim_facts"][0]["position"] == {"line": 1, "column": 1}


def case(spark, gold, said):
    d = docs(spark, TEXT)
    g = spark.createDataFrame([("c", 1, k, v, t) for k, (v, t) in enumerate(gold)], "case string, doc_id long, gold_no int, verbatim string, type string")
    c = spark.createDataFrame([(1, *(f[k] for k in ("id", "fact", "type", "confidence", "verbatim"))) for f in said], "doc_id long, id int, fact string, type string, confidence string, verbatim string")
    return scoring.score(scoring.matches(scoring.anchored(g, d), c)).first()


def test_score(spark):
    r = case(spark, [("The mill opened in 1901", None), ("burned DOWN", "quote")], [fact(1, "a", "mill opened"), fact(2, "b", "It burned down twice."), fact(3, "c", None, "low"), fact(4, "d", None)])
    assert (r.matched, r.missed, r.type_mismatch, r.inferred, r.fabricated, r.extracted, r["pass"]) == (2, 0, 1, 1, 1, 4, True)
    r = case(spark, [(w, None) for w in ("mill", "opened", "1901", "twice")], [fact(1, "a", "Nobody")])
    assert (r.missed, r["pass"]) == (4, False)
    r = case(spark, [("absent words", None), ("", None)], [fact(1, "a", None, "low")])
    assert (r.unanchored, r["pass"]) == (2, False)
    r = case(spark, [("mill", None), ("opened", None)], [fact(1, "a", "The mill opened in 1901.")])
    assert (r.matched, r.missed) == (1, 1)


def test_totals(spark):
    cols = "gold long, matched long, missed long, extracted long, fabricated long, pass boolean"
    two = scoring.run_totals(spark.createDataFrame([(5, 4, 1, 6, 0, True), (9, 2, 7, 3, 1, False)], cols)).first()
    assert two.asDict() == {"cases": 2, "passed": 1, "gold": 14, "matched": 6, "missed": 8, "extracted": 9, "fabricated": 1, "pass": False}
    none = scoring.run_totals(spark.createDataFrame([], cols)).first()
    assert none["pass"] and none.gold == 0


def result(cited=(), inferred=(), summary=True, **extra):
    cited = [f | {"position": p} for f, p in cited]
    inferred = [{k: v for k, v in f.items() if k != "verbatim" or v} for f in inferred]
    failed = sum(f["confidence"] != "low" for f in inferred)
    head = {"total": len(cited) + len(inferred), "verbatim": len(cited), "inferred": len(inferred), "failed_citations": failed, "unlocated": sum(f["position"] is None for f in cited)}
    return json.dumps({"summary": head if summary is True else summary, "verbatim_facts": cited, "inferred_facts": inferred} | extra)


def checked(spark, content, text=TEXT):
    rows = spark.createDataFrame([(1, content)], "doc_id long, content string")
    return checking.check(rows, docs(spark, text) if text is not None else None).first()


def test_checker_accepts_and_counts(spark):
    at = {"line": 1, "column": 1}
    r = checked(spark, result([(fact(1, "a", "The mill opened"), at), (fact(2, "b", "THE MILL"), at), (fact(3, "c", '"Nobody was"!'), None)], [fact(4, "d", None, "low"), fact(5, "e", None, "high")]))
    assert r.ok and r.problems == [] and (r.checked, r.exact, r.recased, r.edge_dirty, r.null_inferred, r.failed_citations, r.positioned, r.unlocated) == (3, 1, 1, 1, 1, 1, 2, 1)
    assert len(r.warnings) == 3 and r.type_counts == {"event": 5}
    kinds = "facts long, checked long, exact long, null_inferred long, failed_citations long, recased long, edge_dirty long, positioned long, unlocated long, type_counts map<string,long>"
    row = spark.createDataFrame([tuple(r[k.split()[0]] for k in kinds.split(", "))], kinds)
    assert "5 facts   event=5 \nverbatim: 3 checked (1 exact), 1 inferred" in row.select(checking.summary_text().alias("s")).first().s


@pytest.mark.parametrize(
    ("content", "problem"),
    [
        (result([(fact(1, "a", "a mill closed"), None)]), "fact 1: quotes what the source does not say: \"a mill closed\""),
        (result([(fact(1, " ", "mill"), None)]), "fact 1: has no text"),
        (result([(fact(1, "a", "mill", kind="guess"), None)]), 'fact 1: unknown type "guess"'),
        (result([(fact(1, "a", "mill", "sure"), None)]), 'fact 1: unknown confidence "sure"'),
        (result([(fact(1, "a!", "mill"), None), (fact(2, "A", "mill"), None)]), "fact 2: says the same as fact 1"),
        (result([(fact(1, "a", "mill"), None), (fact(3, "b", "mill"), None)]), "ids must run from 1 to 2 over both lists: found 3 in place of 2"),
        (result([], [fact(1, "a", "mill")]), "fact 1: is listed as inferred, yet quotes a span"),
        (result([(fact(1, "a", None), None)]), "fact 1: is listed as cited, yet quotes nothing"),
        (result([(fact(1, "a", "mill"), {"line": 1, "column": 1})]), 'fact 1: line 1 column 1 is not where the quoted span starts: "mill"'),
        (result([(fact(1, "a", "mill"), {"line": 9, "column": 1})]), "fact 1: line 9 column 1 lies behind the end of the source"),
        (result([(fact(1, "a", "mill"), {"line": 0, "column": 1})]), "fact 1: line 0 column 1 is no position, as both count from 1"),
        (result(summary=None), "the summary is missing"),
        (result(summary={"total": 2}), "summary.total says 2, the facts count 0"),
    ],
)
def test_checker_problems(spark, content, problem):
    r = checked(spark, content)
    assert problem in r.problems and not r.ok and r.error is None


def test_checker_decoding(spark):
    assert "older document" in checked(spark, '{"facts": []}').error
    for bad in ('{"x": 1}', "{", '{"verbatim_facts": [{"id": "1"}]}', '{"summary": {"totals": 1}}'):
        r = checked(spark, bad)
        assert r.error.startswith("no valid result") and not r.ok
    assert checked(spark, result() + " trailing").ok
    assert checked(spark, result([(fact(1, "a", "not there"), {"line": 5, "column": 5})]), None).problems == []
    assert checked(spark, result([(fact(1, "a", ""), None)])).exact == 1


def test_rule_replies_round(spark):
    d = docs(spark, TEXT, "One two. Three!\n\nFour? " * 300)
    g = spark.createDataFrame([("c", 2, 0, "ONE TWO", None), ("d", 1, 0, "nowhere", None)], "case string, doc_id long, gold_no int, verbatim string, type string")
    made = pipeline.benchmark(d, g, replies.ruled)
    assert {r.case: (r.matched, r.unanchored) for r in made["scores"].collect()} == {"c": (1, 0), "d": (0, 1)}
    rec = made["records"].where("case = 'c'").first()
    assert rec.validation.ok and rec.chunks == 2 and rec.verify.exact > 0
    run = pipeline.run_record(made["records"], made["totals"], "m", False, 1, 1000, 4096, 12).first()
    assert run.think == "false" and run["pass"] is False and len(run.cases) == 2 and "unanchored" not in run.totals.asDict()


def test_replay_and_live(spark):
    d = docs(spark, TEXT)
    chunks = pipeline.chunking.chunks(d)
    stored = reply(spark, '{"facts":[]}', '{"facts":[]}')
    assert replies.replayed(stored)(chunks).count() == 1
    asked = Settings("http://h/", "m", 1000, {"num_ctx": 10}, passes=2, think=False)
    assert replies.request(asked, "s", [])["think"] is False and "think" not in replies.request(Settings("h", "m", 1, {"num_ctx": 1}), "s", [])

    def post(url, body, timeout):
        said = '{"facts": [{"id": 1, "fact": "%d", "verbatim": "mill"}]}' % len(body["messages"])
        return {"message": {"content": said}, "eval_count": 3, "done_reason": "stop"}

    got = replies.live(asked, "s", post=post)(chunks).orderBy("pass_no").collect()
    assert [json.loads(r.content)["facts"][0]["fact"] for r in got] == ["2", "4"]
    counts = claims.accounting(spark.createDataFrame(got, replies.REPLIES)).first()
    assert (counts.eval_tokens, counts.extra_requests, counts.extra_eval_tokens) == (3, 1, 3)
    assert replies.supports_thinking(asked, post=lambda *a: {"capabilities": ["thinking"]}) and replies.has_model(asked, {"models": [{"name": "m:latest"}]})


def test_settings_and_files(spark, tmp_path):
    assert valid_think("max") and not valid_think("huge") and not valid_think(3)
    for bad in ({"host": ""}, {"chunk_tokens": 0}, {"options": {}}, {"passes": 0}, {"think": "huge"}):
        with pytest.raises(ValueError):
            Settings(**{"host": "h", "model": "m", "chunk_tokens": 1, "options": {"num_ctx": 1.0}} | bad)
    s = Settings("h", "m", 1, {"num_ctx": 1.0}, base_dir="/b")
    assert s.resolve("x/../y") == "/b/y" and s.resolve("") == "" and s.resolve("/a") == "/a" and s.num_ctx == 1
    (tmp_path / "b.gold.json").write_text(json.dumps({"source": "x/doc.md", "gold": [{"verbatim": "v"}, {"verbatim": "w", "type": "quote"}]}))
    (tmp_path / "doc.md").write_text("text")
    (tmp_path / "blank.md").write_text(" \n")
    got = read_gold(spark, str(tmp_path)).collect()
    assert [(r.case, r.source, r.gold_no, r.verbatim, r.type) for r in got] == [("b.gold.json", "doc.md", 0, "v", None), ("b.gold.json", "doc.md", 1, "w", "quote")]
    assert [r.name for r in read_texts(spark, str(tmp_path / "*.md")).collect()] == ["doc.md"]
    (tmp_path / "c.gold.json").write_text('{"source": "", "gold": []}')
    with pytest.raises(Exception, match="no source"):
        read_gold(spark, str(tmp_path)).collect()


def test_streams(spark, tmp_path):
    docs(spark, TEXT, "A b. C d.").write.parquet(str(tmp_path / "in"))
    got = []
    q = streams.extract_stream(streams.read_documents(spark, str(tmp_path / "in")), replies.ruled, lambda df, epoch: got.extend(df.collect()), str(tmp_path / "ck"))
    q.awaitTermination(60)
    assert sorted(r.doc_id for r in got) == [1, 2] and all(r.result.summary.total > 0 for r in got)
    sinks.write_results(spark.createDataFrame(got), str(tmp_path / "out"), as_text=True)
    assert '"summary"' in spark.read.text(str(tmp_path / "out"), wholetext=True).first().value


def test_rows_of_claims_and_whole_results_agree(spark):
    at = {"line": 1, "column": 1}
    content = result([(fact(1, "a", "The mill opened"), at), (fact(2, "b", "THE MILL"), None), (fact(2, "A!", "Zq"), {"line": 0, "column": 1})], [fact(4, "d", "mill", "low"), fact(5, "", None, "sure", "guess")])
    decoded = checking.decode(spark.createDataFrame([(1, content)], "doc_id long, content string"))
    rows = checking.judged(checking.flattened(decoded), docs(spark, TEXT))
    notes = [r.message for r in checking.findings(rows).orderBy("ord", "step").collect()]
    whole = checked(spark, content)
    assert sorted(notes) == sorted(m for m in whole.problems + whole.warnings if m.startswith("fact ")) and len(notes) == 9
    assert [r.message for r in checking.id_problems(checking.flattened(decoded)).collect()] == [m for m in whole.problems if m.startswith("ids ")]


def settings_folder(tmp_path, **more):
    (tmp_path / "settings.json").write_text(json.dumps({"server": {"host": "http://h", "model": "m"}, "chunk_tokens": 1000, "options": {"num_ctx": 8192}} | more))
    return str(tmp_path)


def server(said, names=("m:latest",), thinks=True):
    asked = []

    def post(url, body, timeout):
        asked.append(body)
        if url.endswith("/api/show"):
            return {"capabilities": ["thinking"] if thinks else []}
        return {"message": {"content": json.dumps({"facts": said})}, "eval_count": 3, "eval_duration": 10**9, "done_reason": "stop"}

    return {"post": post, "get": lambda url, timeout: {"models": [{"name": n} for n in names]}}, asked


def test_command_line_run_and_check(spark, tmp_path, capsys):
    folder = settings_folder(tmp_path)
    said = [fact(1, "Opened.", "The mill opened in 1901."), fact(2, "Burned.", "IT BURNED DOWN TWICE"), fact(3, "Hurt.", None, "low")]
    ends, asked = server(said)
    assert main(["run", "--folder", folder], spark, **ends) == 1 and "error" in capsys.readouterr().err  # no text to read
    (tmp_path / "prompt.md").write_text(TEXT)
    assert main(["run", "--folder", folder, "--no-think"], spark, **ends) == 0
    err = capsys.readouterr().err
    assert "3 facts, 2 cited and 1 inferred" in err and "spans: 1 exact, 1 put" in err
    path = str(tmp_path / "result.json")
    assert main(["check", path, "--source", str(tmp_path / "prompt.md")], spark) == 0 and capsys.readouterr().out.rstrip().endswith("pass")
    (tmp_path / "result.json").write_text(result([(fact(2, "a", "no such words"), None)]))
    assert main(["check", path, "--source", str(tmp_path / "prompt.md")], spark) == 1 and "ids must run" in capsys.readouterr().out
    (tmp_path / "result.json").write_text("nope")
    assert main(["check", path], spark) == 2 and main(["check", str(tmp_path / "none.json")], spark) == 2 and main(["check"], spark) == 2
    assert main(["run", "--folder", folder, "--model", "other"], spark, **ends) == 1 and "it has: m:latest" in capsys.readouterr().err
    ends["get"] = lambda url, timeout: (_ for _ in ()).throw(KeyboardInterrupt())
    assert main(["run", "--folder", folder], spark, **ends) == 130


def test_command_line_benchmark(spark, tmp_path, capsys):
    folder = settings_folder(tmp_path)
    (tmp_path / "corpus").mkdir()
    (tmp_path / "corpus" / "a.md").write_text(TEXT)
    gold = tmp_path / "corpus" / "a.gold.json"
    gold.write_text(json.dumps({"source": "a.md", "gold": [{"verbatim": "mill opened"}]}))
    ends, _ = server([fact(1, "Opened.", "The mill opened in 1901.")], thinks=False)
    assert main(["benchmark", "--folder", folder], spark, **ends) == 0
    assert "a.gold.json: pass, 1 of 1 gold spans, 1 facts from 1 chunks" in capsys.readouterr().err
    assert spark.read.json(str(tmp_path / "benchmark.json")).first().totals.matched == 1
    gold.write_text(json.dumps({"source": "a.md", "gold": [{"verbatim": "no such words"}]}))
    assert main(["benchmark", "--folder", folder], spark, **ends) == 1 and "1 gold spans are not in the source" in capsys.readouterr().err


def test_prompt_schema_and_service(tmp_path):
    s = load(settings_folder(tmp_path, service={"manage": True}))
    assert all(w in prompts.prompt(s) for w in (*prompts.FIELDS, *TYPES, *CONFIDENCES)) and prompts.schema(s) == REPLY_JSON_SCHEMA
    (tmp_path / "system-instruction.md").write_text("Say it.")
    (tmp_path / "schemas").mkdir()
    (tmp_path / "schemas" / "facts.json").write_text('{"type": "object"}')
    assert prompts.prompt(s) == "Say it." and prompts.schema(s) == {"type": "object"}
    (tmp_path / "schemas" / "facts.json").write_text("{")
    with pytest.raises(ValueError, match="no JSON"):
        prompts.schema(s)
    assert (s.service.launch, s.service.startup_timeout) == ("ollama", 60.0) and Service().launch == "" and Service(True, "x", 5).startup_timeout == 5
    for name, text in (("nothing.json", None), ("bad.json", "{")):
        if text:
            (tmp_path / name).write_text(text)
        with pytest.raises(ValueError, match="settings"):
            load(str(tmp_path), name)


class Answers(http.server.BaseHTTPRequestHandler):
    def do_GET(self):  # noqa: N802
        status, body = {"/ok": (200, '{"a": 1}'), "/odd": (200, "<html>"), "/bad": (404, "no such model"), "/own": (200, '{"error": "too hot"}')}[self.path]
        self.send_response(status)
        self.end_headers()
        self.wfile.write(body.encode())

    do_POST = do_GET

    def log_message(self, *args):
        pass


def test_server_errors():
    s = http.server.HTTPServer(("127.0.0.1", 0), Answers)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{s.server_port}"
    assert replies._get(at + "/ok", 5) == {"a": 1}
    for path, words in (("/odd", "no JSON"), ("/bad", "404.*no such model"), ("/own", "too hot")):
        with pytest.raises(replies.ServerError, match=words):
            replies._post(at + path, {}, 5)
    s.shutdown()
    s.server_close()
    with pytest.raises(replies.ServerError, match="cannot be reached"):
        replies._get(at + "/ok", 5)
    with pytest.raises(replies.ServerError, match="it has: b"):
        replies.preflight(Settings(at, "m", 1, {"num_ctx": 1}), get=lambda *a: {"models": [{"name": "b"}]})


def test_rates_and_changes(spark):
    row = claims.with_rate(reply(spark, "x")).first()
    assert row.tokens_per_second == 5.0
    one = lambda *v: spark.range(1).select(claims.any_changed(*map(F.lit, v)).alias("x")).first().x
    assert [one(3, 0, 0), one(0, 1, 0), one(0, 0, 1)] == [False, True, True]
