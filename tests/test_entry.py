import os

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from tesselon.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(SF):
        pytest.skip("no test data")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    got, expected = catalog.QUERIES[name](spark, SF).toPandas(), duck.execute(catalog.ORACLE_SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(expected.columns) and len(got) == len(expected)
    got, expected = (f[columns].sort_values(columns).reset_index(drop=True) for f in (got, expected))
    for c in columns:
        if got[c].dtype.kind == "f" or expected[c].dtype.kind == "f":
            assert np.allclose(got[c].astype(float), expected[c].astype(float), equal_nan=True), c
        else:
            assert (got[c].astype(str) == expected[c].astype(str)).all(), c


def test_entry_and_registry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
