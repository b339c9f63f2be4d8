"""Each query against the SQL that DuckDB runs on the same tables."""

import duckdb
import pytest

from lumentrail.plans import catalog

DIR = "/root/testdata/sf0.001"
TABLES = "customer embeddings events lineitem orders part".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_rows(spark, duck, name):
    a = catalog.queries()[name](spark, DIR).toPandas()
    b = duck.sql(catalog.oracle_sql()[name]).df()
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    a, b = (x[cols].sort_values(cols, ignore_index=True) for x in (a, b))
    assert len(a) == len(b)
    for c in cols:
        assert ((a[c] == b[c]) | (a[c].isna() & b[c].isna())).all(), c


def test_entry_points():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(catalog.queries()) <= set(e.queries())
