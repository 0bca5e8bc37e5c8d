"""Every query of the core catalogue against its SQL on the smallest tables."""

import duckdb
import pytest

from tarn.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(values):
    return sorted(tuple(round(v, 5) if isinstance(v, float) else v for v in r) for r in values), len(values)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    mine = [tuple(r) for r in got.select(columns).collect()]
    if name not in catalog.ORACLES:  # none at present
        assert mine
        return
    theirs = duck.sql(catalog.ORACLES[name])
    assert sorted(theirs.columns) == columns
    key = lambda r: tuple((v is None, str(v)) for v in r)
    clean = lambda rs: sorted((tuple(round(v, 5) if isinstance(v, float) else v for v in r) for r in rs), key=key)
    assert clean(mine) == clean(theirs.select(*[duckdb.ColumnExpression(c) for c in columns]).fetchall())
