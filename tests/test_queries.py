"""Every registered query against its SQL on the smallest tables."""

import os
import sys

import duckdb
import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import __spark_entry__ as entry  # noqa: E402
from echofold.plans import catalog  # noqa: E402

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = catalog.QUERIES, catalog.ORACLE


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def tidy(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        try:
            df[c] = df[c].astype(float)
        except (TypeError, ValueError):
            df[c] = df[c].astype(str)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def test_every_sql_has_its_query():
    assert set(SQL) <= set(QUERIES)
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name not in SQL:
        assert list(got.columns)
        return
    a, b = tidy(got), tidy(duck.execute(SQL[name]).df())
    assert list(a.columns) == list(b.columns) and len(a) == len(b)
    for c in a.columns:
        if a[c].dtype == object:
            assert (a[c] == b[c]).all(), c
        else:
            np.testing.assert_allclose(a[c], b[c], rtol=1e-4, atol=2e-4, err_msg=c)
