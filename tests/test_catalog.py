"""Every query of the catalogue against its SQL."""

import glob
import math
import os

import duckdb
import numpy as np
import pytest

from tokenloom.plans import catalog, reports, roundtrips  # noqa: F401  the last two add to the catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    if isinstance(v, (list, tuple, np.ndarray)):
        return [plain(x) for x in v]
    if isinstance(v, (float, np.floating)):
        return "NaN" if math.isnan(v) else round(float(v), 5)
    return v.item() if isinstance(v, np.generic) else v


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query(spark, con, name):
    got, want = catalog.QUERIES[name](spark, SF), con.sql(catalog.ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    a = sorted(repr(plain([r[c] for c in columns])) for r in got.collect())
    b = sorted(repr(plain(list(r))) for r in want.project(", ".join(f'"{c}"' for c in columns)).fetchall())
    assert a == b
