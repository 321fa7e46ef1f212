"""Every registered query vs its DuckDB statement on the sf0.001 tables
(row count, column names, order-insensitive value hash)."""

import duckdb
import pytest

import __spark_entry__ as E
from threadsmith.plans.driver import QUERIES
from threadsmith.plans.adapters import TABLES
from tests.conftest import SF0001
from tools.oracle_check import digest

SQL = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF0001}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, con, name):
    df = E.queries()[name](spark, SF0001)
    rows = [tuple(r) for r in df.collect()]
    if name not in SQL:
        assert df.columns and isinstance(rows, list)
        return
    res = con.execute(SQL[name])
    cols = [d[0] for d in res.description]
    other = res.fetchall()
    assert sorted(df.columns) == sorted(cols)
    assert len(rows) == len(other)
    assert digest(df.columns, rows)[0] == digest(cols, other)[0]
