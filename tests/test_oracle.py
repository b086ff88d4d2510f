"""Every query of the engine against its SQL."""

import duckdb
import pytest

from loomquery.operators import queries as engine

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in engine.TPCH:
        con.sql(f"CREATE VIEW {t} AS FROM '{DATA}/{t}.parquet'")
    return con


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    norm = lambda v: None if v is None else round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)[:10] if hasattr(v, "isoformat") else str(v)
    return sorted(([norm(r[i]) for i in order] for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(engine.QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = engine.QUERIES[name](spark, DATA)
    want = duck.sql(engine.ORACLE[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(want.columns, want.fetchall())
