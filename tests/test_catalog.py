"""Every catalogued query agrees with its DuckDB SQL on the smallest tables."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from mediasift.plans import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


def plain(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)].copy()

    def cell(x):
        if x is None or x is pd.NA or (isinstance(x, float) and np.isnan(x)):
            return ""
        return str(bool(x)) if isinstance(x, (bool, np.bool_)) else repr(round(float(x), 9)) if isinstance(x, (int, float, np.number)) else str(x)

    return sorted(tuple(map(cell, row)) for row in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_agrees_with_sql(spark, duck, name):
    ours = catalog.queries()[name](spark, SF).toPandas()
    theirs = duck.execute(catalog.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert plain(ours) == plain(theirs)
