"""Claims judged in batches: the column functions' results, odd places, and long texts with many claims in little time."""

import itertools
import random
import time

import pytest
from pyspark.sql import functions as F

from attesta.functions import batches
from attesta.functions import text as T
from attesta.operators import checking, claims, report, scoring, spans

PIECES = ["a", "Mill", "É", "İ", "Σ", "σας", "ß", "“", "\'", "—", "-", ".", "!", "(", " ", "  ", "\t", "\n", "\r\n", "\x85", "\xa0", " ", "　", " ", "\x1c", "​", "\U0001d538", "ﬁ"]
PIECES += ["\u1680", "\u2003", "\u2028", "\u3000", "\u200b"]


def odd(n, seed=5):
    rng = random.Random(seed)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randrange(0, 14))) for _ in range(n)]


def test_like_columns(spark):
    texts, parts = odd(300), odd(300, 6)
    rng = random.Random(7)
    for k in range(0, 300, 2):  # half of the spans are parts of their text, some of them altered
        a, b = sorted(rng.randrange(0, len(texts[k]) + 1) for _ in range(2))
        parts[k] = texts[k][a:b] if k % 4 else texts[k][a:b].upper() + "."
    df = spark.createDataFrame(list(zip(itertools.count(), texts, parts)), "i int, t string, s string")
    made = df.select("t", "s", T.fold(F.col("t")).alias("fold"), T.squash(F.col("t")).alias("squash"), T.low(F.col("t")).alias("low"), spans.locate(F.col("t"), F.col("s")).alias("hit"), spans.position(F.col("t"), spans.locate(F.col("t"), F.col("s"))["at"]).alias("place"))
    hits = 0
    for r in made.collect():
        assert (batches.fold(r.t), batches.squash(r.t), batches.low(r.t)) == (r.fold, r.squash, r.low)
        got = batches.Folded(r.t).locate(r.s)
        assert got == (None if r.hit is None else (r.hit.text, r.hit.at))
        if got is not None:
            assert batches.position(r.t, got[1]) == r.place.asDict()
            hits += 1
    assert hits > 50


def test_null_and_empty_lists(spark):
    facts = "facts array<struct<id:bigint,fact:string,type:string,confidence:string,verbatim:string>>"
    one = (1, "f", "other", "low", "THE mill")
    rows = [(1, 0, 1, "The mill.", [one, (2, "g", "other", "low", None), (3, "h", "other", "high", "no mill")]), (2, 0, 1, "The mill.", None), (3, 0, 1, None, [one]), (4, 0, 1, "", [])]
    made = {r.doc_id: r.facts for r in claims.checked(spark.createDataFrame(rows, f"doc_id bigint, chunk_no int, pass_no int, chunk_text string, {facts}")).collect()}
    assert [(x.verbatim, x.status) for x in made[1]] == [("The mill", "repaired"), (None, "none"), (None, "dropped")]
    assert made[2] is None and made[4] == [] and made[3][0].status == "dropped"


@pytest.mark.parametrize("line, column, want", [(2**62, 1, "past"), (1, 2**62, "past"), (-(2**62), 1, "low"), (2, 3, "right"), (3, 1, "past")])
def test_places_beyond_32_bits(spark, line, column, want):
    rows = spark.createDataFrame([(1, 0, 1, "f", "other", "low", "mill", (line, column), True)], "doc_id bigint, ord int, id int, fact string, type string, confidence string, verbatim string, position struct<line:bigint,column:bigint>, cited boolean")
    assert checking.judged(rows, spark.createDataFrame([(1, "a\nb mill")], "doc_id bigint, text string")).first().position_class == want


def test_long_text_with_many_claims(spark):
    n = 4000
    said = [f"Sentence number {k} of a long text speaks of mills, rivers and the year {k * 7}." for k in range(n)]
    docs = spark.createDataFrame([(1, "\n".join(said))], "doc_id bigint, text string")
    merged = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("k", "fact")).select("doc_id", (F.col("k") + 1).alias("id"), "fact", F.lit("other").alias("type"), F.lit("low").alias("confidence"), T.shout(F.col("fact")).alias("verbatim"))
    began = time.time()
    placed = report.located(merged, docs)
    assert [(r.position.line, r.position.column) for r in placed.orderBy("id").collect()] == [(k + 1, 1) for k in range(n)]
    rows = placed.select("doc_id", F.col("id").alias("ord"), "id", "fact", "type", "confidence", "verbatim", "position", F.lit(True).alias("cited"))
    assert {(r.span_class, r.position_class, r.n) for r in checking.judged(rows, docs).groupBy("span_class", "position_class").agg(F.count(F.lit(1)).alias("n")).collect()} == {("recased", "right", n)}
    gold = merged.select(F.col("doc_id").alias("case"), "doc_id", F.col("id").alias("gold_no"), "verbatim", "type")
    assert [x.anchor for x in scoring.anchored(gold, docs).first().gold] == said
    assert time.time() - began < 20
