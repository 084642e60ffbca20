"""Null and repeated keys, and columns of any name, in every operator."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from attesta.llm import bpe, decontaminate, jaccard, langid, licenses, lmscore, media, passages, quality, toxicity
from attesta.llm.queries import RANKS

TEXT = "one two three four five six seven eight nine ten " * 8
NAMES = "key string, h long, c int, l int, r int, score double, label string, node long, path string, words binary, __text string, n_links int"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(None, TEXT), (None, None), (None, "x y"), (1, TEXT), (1, TEXT), (2, None), (2, "other words"), (3, "")]
    clash = ["k", 1, 2, 3, 4, 0.5, "l", 5, "p/q", b"w", "t", 9]
    return spark.createDataFrame([(i, t, "en", "s", 0, *clash) for i, t in rows], f"doc_id long, text string, lang string, source string, n_chars long, {NAMES}")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")


def keys(df):
    return sorted((r.doc_id is None, r.doc_id or 0) for r in df.collect())


def test_row_operators_keep_every_row(spark, docs, labels):
    want = keys(docs)
    assert keys(bpe.round_trip(docs, RANKS, public_tokenizers.PATTERN)) == want
    assert keys(langid.predict(docs, langid.train(docs))) == want
    assert keys(media.round_trip(docs)) == want
    assert keys(quality.score(docs, quality.train(docs, labels))) == want
    assert keys(toxicity.score(docs, toxicity.train(docs, labels))) == want
    assert keys(lmscore.score(docs, RANKS)) == want
    assert keys(licenses.inherit(licenses.scan(docs, F.col("path")))) == want
    assert keys(jaccard.join(docs)) == want


def test_rows_without_a_key_are_kept_and_not_reported(spark, docs):
    items = spark.createDataFrame([(7, TEXT), (None, TEXT), (8, None)], "item_id long, text string")
    assert {r.doc_id for r in decontaminate.find(docs, items).collect()} == {1}
    assert keys(decontaminate.drop_contaminated(docs, items)) == [k for k in keys(docs) if k != (False, 1)]
    assert passages.find(docs).collect() == []
    assert keys(passages.cut_out(docs)) == keys(docs)
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns and [k for k in keys(kept) if k == (False, 1)] == [(False, 1)]
    assert passages.cut_out(docs).columns == docs.columns


def test_text_keys(spark):
    docs = spark.createDataFrame([("b", TEXT), ("a", TEXT + " end"), ("c", "else")], "name string, body string")
    got = {r.name: (r.class_id, r.n_links) for r in jaccard.join(docs, id_col="name", text_col="body").collect()}
    assert got == {"a": ("a", 1), "b": ("a", 1), "c": ("c", 0)}
    assert {(r.name, r.source_id) for r in passages.find(docs, id_col="name", text_col="body").collect()} == {("b", "a")}
