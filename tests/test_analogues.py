"""Every query that SQL can express against DuckDB on the same tables."""

import glob
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from figmill.plans import analogues, checks, figures  # noqa: F401
from figmill.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def cell(v) -> str:
    if isinstance(v, (list, np.ndarray)):
        return str(list(v))
    return "null" if pd.isna(v) else f"{v:.9g}" if isinstance(v, float) else str(v)


def rows(frame: pd.DataFrame) -> list:
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(map(cell, r)) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    assert len(got)
    if name in ORACLES:
        want = duck.execute(ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got.astype(object).where(got.notna(), None)) == rows(want.astype(object).where(want.notna(), None))
