"""Every registered query against its DuckDB twin on the smallest tables."""

import decimal
import os

import duckdb
import pandas as pd
import pytest

from tankline.plans.registry import ORACLES, QUERIES
from tankline.plans.tables import BASE

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def rows(pdf):
    def cell(v):
        if v is None or v is pd.NaT or v is pd.NA or v != v:
            return "~"
        if isinstance(v, (int, float, decimal.Decimal)) and not isinstance(v, bool):
            return repr(float(v))
        return str(v).replace(" 00:00:00", "")

    return sorted(tuple(cell(v) for v in r) for r in pdf[sorted(pdf.columns)].astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in BASE:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, duck, name):
    ours, theirs = QUERIES[name](spark, SF).toPandas(), duck.execute(ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    QUERIES[name](spark, SF).count()
