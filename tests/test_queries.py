"""Every registered query of the engine itself against its SQL in DuckDB."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from chronolith.plans.queries import QUERIES, SQL


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    df = df.apply(lambda c: c.astype(str) if c.dtype == object else c)
    return df.sort_values(list(df.columns), ignore_index=True)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_equals_sql(spark, duck, sf, name):
    ours = canonical(QUERIES[name](spark, sf).toPandas())
    theirs = canonical(duck.execute(SQL[name]).df())
    assert list(ours.columns) == list(theirs.columns)
    pd.testing.assert_frame_equal(ours, theirs, check_dtype=False)
    assert len(ours) or name in ("ts_violations", "rt_range", "rt_unexpired", "rel_by_example_and")  # few rows at this size
