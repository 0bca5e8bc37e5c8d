"""The registered queries against their SQL on the smallest tables."""

import duckdb
import pytest

from tarn.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, duck, name):
    got = queries.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    theirs = duck.sql(queries.ORACLES[name])
    assert sorted(theirs.columns) == columns
    key = lambda r: tuple((v is None, str(v)) for v in r)
    clean = lambda rs: sorted((tuple(round(v, 5) if isinstance(v, float) else v for v in r) for r in rs), key=key)
    assert clean(tuple(r) for r in got.select(columns).collect()) == clean(theirs.select(*[duckdb.ColumnExpression(c) for c in columns]).fetchall())


def test_every_operator_has_a_query():
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{i}" for i in range(1, 11)}
