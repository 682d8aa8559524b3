"""Every query of the dialect against its SQL in DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

from veldt import queries as Q

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in Q.TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return None
        if isinstance(v, float):
            return f"{v:.6f}"
        if isinstance(v, list | tuple):
            return [cell(x) for x in v]
        return str(int(v)) if isinstance(v, bool) else f"{v:.6f}" if type(v).__name__ == "Decimal" and v % 1 else str(v)

    return sorted(repr([cell(r[i]) for i in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_against_duckdb(spark, duck, name):
    got = Q.queries()[name](spark, SF)
    want = duck.sql(Q.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert normal([tuple(r) for r in got.collect()], got.columns) == normal(want.fetchall(), want.columns)


@pytest.mark.parametrize("name", sorted(Q.OTHER_QUERIES))
def test_other_queries_have_rows(spark, name):
    assert Q.queries()[name](spark, SF).count() > 0


def test_codepoint_of_odd_texts(spark, tmp_path):
    """Texts that are null, empty, or begin with the character 0, a byte order mark or a character of any length."""
    odd = [None, "", "\0", "\0a", " ", "\r\na", "\ufeff", "\ufeffa", "\ufffe", "\ufeff\ufeff", "\x7f", "\x80", "\u07ff", "\u0800", "e\u0301", "\u0301e", "\ud7ff", "\ue000", "\uffff", "\U00010000", "\U0010ffff", "\U0001f468\u200d\U0001f469"]
    spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = Q.queries()["fn_codepoint"](spark, str(tmp_path)).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == con.sql(Q.oracle_sql()["fn_codepoint"] + " ORDER BY doc_id").fetchall()
