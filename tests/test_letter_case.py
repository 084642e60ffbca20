"""Letters whose upper or lower case is longer, or depends on what is around them: the checker's queries give the SQL's rows."""

import duckdb
import pytest

from attesta import catalogue

TEXTS = {
    4: "Die Straße ist zu. Alle fahren weiter.", 19: "Το τέλος είναι εδώ. ΤΟ ΤΈΛΟΣ ΕΊΝΑΙ ΕΔΏ! Και ο λόγος ΛΌΓΟΣ μένει.", 34: "ŉ ǰ ﬁn ΐ ᾳ ǆ. Another one.", 49: "İstanbul ıssız. İSTANBUL ISSIZ kaldı.",
    8: "Ο ΛΌΓΟΣ μένει. Το τέλος ΤΈΛΟΣ.", 9: "Straße und ΤΈΛΟΣ. Mehr.", 10: "Ein Gruß aus İzmir. Σ ς σ.",
}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("case"))
    spark.createDataFrame(list(TEXTS.items()), "doc_id bigint, text string").coalesce(1).write.parquet(f"{out}/documents.parquet")
    return out


@pytest.mark.parametrize("name", ["q_check_findings", "q_check_spans", "q_check_results", "q_check_lines", "q_check_summary", "q_check_ids", "q_position"])
def test_like_sql(spark, folder, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    want = con.sql(catalogue.oracle_sql()[name])
    columns = sorted(want.columns)
    got = sorted(str([r[c] for c in columns]) for r in catalogue.queries()[name](spark, folder).collect())
    assert got == sorted(str([r[want.columns.index(c)] for c in columns]) for r in want.fetchall())
