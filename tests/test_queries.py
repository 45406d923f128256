"""Every query with SQL against DuckDB on the smallest test tables, where they are present."""

import math
import os

import pytest

from notemill.plans import catalog

FOLDER = "/root/testdata/sf0.001"
SQL = catalog.oracle_sql()


def shown(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    return "null" if v is None else str(v)


def compare(spark, query, sql):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{f}'")
    got = query(spark, FOLDER)
    names = sorted(got.columns)
    want = con.sql(f"SELECT {', '.join(names)} FROM ({sql})").fetchall()
    assert sorted(con.sql(sql).columns) == names
    assert sorted(tuple(map(shown, r)) for r in got.select(*names).collect()) == sorted(tuple(map(shown, r)) for r in want)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    compare(spark, catalog.queries()[name], SQL[name])


def test_every_sql_has_a_query():
    assert set(SQL) <= set(catalog.queries())


def test_the_rest_does_not_need_the_llm_part():
    import pathlib

    import notemill

    root = pathlib.Path(notemill.__file__).parent
    for f in root.rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert "notemill.llm" not in f.read_text()
