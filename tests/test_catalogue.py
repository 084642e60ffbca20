"""Every query with SQL gives the SQL's rows on the smallest tables."""

import glob
import os

import duckdb
import pytest

from attesta import catalogue

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the standard tables are not here")
@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, tables, name):
    made = catalogue.queries()[name](spark, DATA)
    columns = sorted(made.columns)
    got = sorted(str([r[c] for c in columns]) for r in made.collect())
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    want = tables.sql(sql)
    assert sorted(want.columns) == columns
    assert got == sorted(str([r[want.columns.index(c)] for c in columns]) for r in want.fetchall())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the standard tables are not here")
def test_every_rule_and_class_occurs(spark):
    made = {n: f(spark, DATA) for n, f in catalogue.queries().items() if n in ("q_check_findings", "q_check_spans", "q_parse_replies", "q_strict_decode")}
    assert {r.step for r in made["q_check_findings"].select("step").collect()} == set(range(13))
    spans = made["q_check_spans"].collect()
    assert {r.span_class for r in spans} == {"exact", "recased", "edge", "paraphrase"} and {r.position_class for r in spans} >= {"right", "wrong", "past", "low"}
    assert {r.reason for r in made["q_parse_replies"].collect()} == {None, "truncated", "leaked", "unparsable"}
    assert len({r.error for r in made["q_strict_decode"].collect()}) == 8


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["doc_id", "total", "verbatim", "inferred", "failed_citations", "unlocated"]
    assert set(e.oracle_sql()) <= set(e.queries())
