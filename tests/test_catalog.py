"""Every catalogue query with SQL against that SQL, at the smallest scale; none may be empty."""

from __future__ import annotations

import os

import duckdb
import pandas as pd
import pytest

from quire.plans import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def canonical(df: pd.DataFrame) -> list[tuple]:
    def one(v):
        if v is None or v is pd.NA or (isinstance(v, float) and v != v):
            return ""
        return f"{float(v):.6f}" if isinstance(v, (int, float)) or hasattr(v, "dtype") and v.dtype.kind in "iuf" else str(v)

    return sorted(tuple(one(v) for v in row) for row in df[sorted(df.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, db, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    assert len(got)
    if name in catalog.ORACLE_SQL:
        want = db.sql(catalog.ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert canonical(got) == canonical(want)
