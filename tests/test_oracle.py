"""Every registered query with an SQL oracle agrees with DuckDB on sf0.001."""

import os
import sys

import pytest

from conftest import ROOT, SF001

sys.path.insert(0, os.path.join(ROOT, "tools"))

import __spark_entry__ as E  # noqa: E402
from check_oracle import duck, frame_hash  # noqa: E402

SQL = E.oracle_sql()
QUERIES = E.queries()


@pytest.fixture(scope="module")
def con():
    return duck(SF001)


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, con, name):
    sdf = QUERIES[name](spark, SF001).toPandas()
    ddf = con.execute(SQL[name]).df()
    assert sorted(sdf.columns) == sorted(ddf.columns)
    assert len(sdf) == len(ddf)
    assert frame_hash(sdf) == frame_hash(ddf)


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["word", "n", "idx"]
    assert df.count() > 0
