"""Every query of the subpackage that has SQL against it."""

import glob
import os

import duckdb
import pytest

from tokenloom.llm import queries

from .conftest import SF


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, con, name):
    got, want = queries.queries()[name](spark, SF), con.sql(queries.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda found: sorted(repr(tuple(r)) for r in found)
    assert rows([r[c] for c in columns] for r in got.collect()) == rows(want.project(", ".join(columns)).fetchall())
