"""The registered queries and their SQL fit together."""

import duckdb
import pytest

import __spark_entry__ as entry
from shelfmark import cases


def test_registry(spark):
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and all(callable(q) for q in queries.values()) and all(isinstance(s, str) for s in sql.values())
    assert entry.entry(spark).columns == ["id", "content_hash"]


def plain(value):
    return tuple(map(plain, value)) if isinstance(value, (list, tuple)) else round(value, 9) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(cases.QUERIES))
def test_golden_table(spark, name):
    rows = cases.QUERIES[name](spark, "/root/testdata/sf0.001")
    wanted = duckdb.sql(cases.SQL[name])
    assert rows.columns == wanted.columns
    assert sorted(map(repr, map(plain, map(tuple, rows.collect())))) == sorted(map(repr, map(plain, wanted.fetchall())))
