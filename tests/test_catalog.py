"""Every query of the library against its SQL in DuckDB, on the smallest scale factor."""

import datetime
import decimal
import os

import duckdb
import pytest

from quillform.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, (float, decimal.Decimal)):
        return round(float(x), 6)
    if isinstance(x, datetime.datetime):
        return x.isoformat()
    return x


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(plain(v[i]) for i in order) for v in values), key=repr)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    got = rows(df.columns, df.collect())
    if name in catalog.ORACLES:
        done = duck.execute(catalog.ORACLES[name])
        assert got == rows([d[0] for d in done.description], done.fetchall())
    assert got[1]


def test_entry_points_need_no_subpackage():
    import __spark_entry__ as e

    assert set(catalog.QUERIES) <= set(e.queries()) and set(catalog.ORACLES) <= set(e.oracle_sql())
    assert set(e.oracle_sql()) <= set(e.queries())
