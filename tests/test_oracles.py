"""Every query with SQL is held against it, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from pixelweft.plans import oracles, queries

DATA = "/root/testdata/sf0.001"
ORACLES = oracles.oracles()


def norm(frame, columns):
    cell = lambda v: "~" if v is None or v != v else repr(round(float(v), 9)) if isinstance(v, float) else str(v)
    return sorted(tuple(cell(v) for v in row) for row in frame[columns].astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, duck, name):
    got, want = queries.QUERIES[name](spark, DATA).toPandas(), duck.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    assert norm(got, columns) == norm(want, columns)


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(oracles.oracles()) <= set(e.queries())
