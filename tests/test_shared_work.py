"""Whole-run records make chunks and checked claims once, however many parts read them."""

import os

import pytest

from attesta import catalogue

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the standard tables are not here")
def test_texts_are_cut_into_chunks_once(spark):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert plan(catalogue.records_of(spark, DATA)).count("documents.parquet") <= 3  # gold spans and their anchors
    assert plan(catalogue.q_check_summary(spark, DATA)).count("documents.parquet") == 0
    assert plan(catalogue.q_run_record(spark, DATA)).count("documents.parquet") == 0
