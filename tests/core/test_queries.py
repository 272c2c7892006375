"""Every query with SQL gives the same rows in DuckDB."""

import glob
import math
import os

import duckdb
import pytest

from tallyloom.plans import catalog


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def plain(v):
    return ("nan" if math.isnan(v) else round(v, 5)) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf, duck, name):
    df = catalog.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str)
    assert got
    if name in catalog.ORACLES:
        r = duck.execute(catalog.ORACLES[name])
        names = [d[0] for d in r.description]
        assert sorted(names) == cols
        assert got == sorted((tuple(plain(x[names.index(c)]) for c in cols) for x in r.fetchall()), key=str)


def test_entry():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and "pairwise_kappa" in entry.queries()
