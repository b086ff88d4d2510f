"""Queries whose results pass the row cap of 5000, against their SQL at sf0.1."""

import duckdb
import pytest
from test_oracle import rows

from loomquery.operators import queries as engine

DATA = "/root/testdata/sf0.1"
NAMES = [n for n in engine.CASES if n.startswith(("q_filter_", "q_lookup_", "q_join_", "q_row_cap", "q_distinct"))]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in engine.TPCH:
        con.sql(f"CREATE VIEW {t} AS FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_returns_every_row(spark, duck, name):
    df = engine.QUERIES[name](spark, DATA)
    want = duck.sql(engine.ORACLE[name])
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(want.columns, want.fetchall())
