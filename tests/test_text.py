"""Text functions, chunks and spans against small independent models."""

import random
import re

import pytest
from pyspark.sql import functions as F

from attesta.functions import text as T
from attesta.operators import chunking, spans

WS = set("\t\n\x0b\f\r \x85\xa0     　") | {chr(c) for c in range(0x2000, 0x200B)}


def column(spark, values, expr):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string").select("i", expr(F.col("s")).alias("x")).collect()
    return [r.x for r in sorted(rows, key=lambda r: r.i)]


def py_low(c):
    return "i" if c == "İ" else c.lower() if len(c.lower()) == 1 else c


def py_fold(s):
    """Folded text and the place of each of its characters."""
    out, place = [], []
    for i, c in enumerate(s):
        if c in WS:
            if out and out[-1] != " ":
                out.append(" "), place.append(i)
        else:
            out.append('"' if c in T.QUOTES else "-" if c in T.DASHES else py_low(c)), place.append(i)
    if out and out[-1] == " ":
        out.pop(), place.pop()
    return out, place


def py_locate(text, span):
    norm, place = py_fold(text)
    q = py_fold(span)[0]
    edges = set(' ".,;:!?()[]-')
    trimmed = list(q)
    while trimmed and trimmed[0] in edges:
        trimmed.pop(0)
    while trimmed and trimmed[-1] in edges:
        trimmed.pop()
    for k in (q, trimmed):
        for i in range(len(norm) - len(k) + 1) if k else ():
            if norm[i : i + len(k)] == k:
                return text[place[i] : place[i + len(k) - 1] + 1], place[i]
    return None


def test_white_space_sets(spark):
    got = column(spark, [c + "a" + c for c in sorted(WS)] + ["\x1ca\x1c"], T.trim_ws)
    assert got == ["a"] * len(WS) + ["\x1ca\x1c"]


def test_squash_and_keys(spark):
    assert column(spark, ["  a\t\n b　c ", ""], T.squash) == ["a b c", ""]
    assert column(spark, ["Ab-½ Ⅳ 3!"], T.writer_key) == ["ab3"]
    assert column(spark, ["Ab-½ Ⅳ 3!"], T.checker_key) == ["ab½ⅳ3"]


def test_estimate_and_display(spark):
    assert column(spark, ["", "a" * 36, "😀" * 18], T.estimate_tokens) == [1, 11, 6]
    assert column(spark, ["abcdef", "abc"], lambda c: T.shorten(c, 4)) == ["abc…", "abc"]


def words(spark, text, most):
    return column(spark, [text], lambda c: chunking.split(c, most, T.count_words))[0]


def test_chunk_rules(spark):
    assert words(spark, "one two three", 100) == ["one two three"]
    assert words(spark, "a b c d\n\ne f g h\r\n\r\ni j k l", 4) == ["a b c d", "e f g h", "i j k l"]
    assert words(spark, "a b\n\nc d\n\ne f\n\ng h", 4) == ["a b\n\nc d", "e f\n\ng h"]
    assert words(spark, "A b c. D e f! G h i?", 3) == ["A b c.", "D e f!", "G h i?"]
    assert len(words(spark, "word " * 200, 10)) >= 2
    mixed = "One two. Three four five six seven.\n\nEight nine 3.5 ten. Eleven"
    assert " ".join(words(spark, mixed, 4)).split() == mixed.split()
    assert column(spark, ["It grew 3.5 times. Then it fell."], chunking.sentences)[0] == ["It grew 3.5 times.", "Then it fell."]
    assert column(spark, ["x" * 700 + " " * 700 + "y"], lambda c: F.size(chunking.split(c, 100)))[0] >= 2


def test_blank_text(spark):
    docs = spark.createDataFrame([(1, " \n "), (2, "x"), (3, None)], "doc_id long, text string")
    assert [r.doc_id for r in chunking.chunks(docs).collect()] == [2]
    with pytest.raises(Exception, match="blank text"):
        chunking.chunks(docs, on_blank="fail").collect()
    with pytest.raises(ValueError):
        chunking.split(F.col("text"), 0)


def test_locate_agrees_with_a_plain_model(spark):
    rng = random.Random(7)
    alphabet = list("abcABC ,.!?\"'-") + list("“”‘’«»–—  \n\t") + list("İıßẞſsSςσΣkKK😀éÉ(ǅǆ)[\\]^$*+")
    cases = []
    for _ in range(300):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60)))
        if rng.random() < 0.8 and text:
            i = rng.randrange(len(text))
            span = text[i : i + rng.randint(1, 12)]
            span = rng.choice([span, span.upper(), span + ".", f'"{span}"', span.replace('"', "“").replace("-", "—").replace(" ", "\n ")])
        else:
            span = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 4)))
        cases.append((text, span))
    df = spark.createDataFrame([(i, t, s) for i, (t, s) in enumerate(cases)], "i int, t string, s string")
    got = {r.i: (r.x.text, r.x.at) if r.x else None for r in df.select("i", spans.locate(F.col("t"), F.col("s")).alias("x")).collect()}
    for i, (t, s) in enumerate(cases):
        assert got[i] == py_locate(t, s), (t, s)


def test_locate_cases(spark):
    text = "The Cat said: “No.”\nIt sat\n on the mat."
    want = {"the cat": "The Cat", "it sat on": "It sat\n on", '"No"': "No", "'no.'": "“No.”", "mat..": "mat", "on the mat.": "on the mat.", "dog": None, "": None, "...": None}
    df = spark.createDataFrame([(k,) for k in want], "s string")
    assert {r.s: r.x for r in df.select("s", spans.find(F.lit(text), F.col("s")).alias("x")).collect()} == want


def test_positions(spark):
    text = "ab\ncd😀e\r\nf"
    df = spark.range(len(text) + 1).select("id", spans.position(F.lit(text), F.col("id").cast("int")).alias("p"))
    for r in df.collect():
        before = text[: r.id]
        assert (r.p.line, r.p.column) == (before.count("\n") + 1, len(re.split("\n", before)[-1]) + 1)


def test_budget(spark):
    docs = spark.createDataFrame([(1, "x" * 3600)], "doc_id long, chunk_text string")
    one = chunking.fits(docs, "s" * 36, "g" * 36, 2000).first()
    assert (one.largest, one.needed, one.fits) == (1001, 11 + 1001 + 500 + 512, False)
    two = chunking.fits(docs, "s" * 36, "g" * 36, 4000, passes=2).first()
    assert two.needed == one.needed + 1001 + 11 and two.fits
