"""Each query that SQL can express gives the SQL's rows over the smallest tables."""

from __future__ import annotations

import os
from numbers import Real

import duckdb
import pandas as pd
import pytest
from barloom.plans import queries  # noqa: F401
from barloom.plans.registry import ORACLES, QUERIES

TABLES = "lineitem part events".split()


def rows(frame: pd.DataFrame) -> list[str]:
    def value(v):
        if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and v != v:
            return None
        return round(float(v), 6) + 0.0 if isinstance(v, Real) else str(v)[:10] if "date" in type(v).__name__.lower() or "stamp" in type(v).__name__.lower() else v

    frame = frame[sorted(frame.columns)]
    return sorted(str(tuple(map(value, r))) for r in frame.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        con.sql(f"create view {t} as from '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    assert rows(QUERIES[name](spark, sf).toPandas()) == rows(con.sql(ORACLES[name]).df())
