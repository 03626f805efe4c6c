"""Exact order statistics against sorted lists."""

import math

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from tokenloom.operators import metrics, selection
from tokenloom.session import table


def frame(spark, xs):
    return spark.createDataFrame([(None if x is None else float(x),) for x in xs], "s double")


@pytest.mark.parametrize("held", [4096, 8])
def test_against_sorted(spark, monkeypatch, held):
    monkeypatch.setattr(selection, "HELD", held)
    monkeypatch.setattr(selection, "RANGES", 5)
    rng = np.random.default_rng(held)
    for xs in (rng.standard_normal(301).tolist(), rng.integers(0, 6, 200).tolist(), [7.0] * 90 + [1.0], np.r_[rng.standard_normal(150), 1e300, -1e300, math.inf, -math.inf, -0.0, 0.0].tolist()):
        df, want = frame(spark, [*xs, None, math.nan]), sorted(xs)
        places = [0, 1, len(xs) // 3, len(xs) // 2, len(xs) - 1]
        assert selection.nth(df, "s", places) == [want[p] for p in places]


def test_median_against_sql(spark, monkeypatch):
    monkeypatch.setattr(selection, "HELD", 8)
    nan, inf = math.nan, math.inf
    for xs in ([], [None], [3], [1, 2], [1, 1, 2, 2], [nan], [1, nan], [1, 2, nan], [None, 5, 4, None], [inf, 1, 2], [-1e308, 1e308], list(range(100)), [*range(50), *[7] * 51], [nan, nan, 1, 2, 3, 4]):
        got = selection.median(frame(spark, xs), "s")
        t = pa.table({"s": pa.array([None if x is None else float(x) for x in xs], pa.float64())})  # noqa: F841  read by the query
        want = duckdb.sql("SELECT median(s) FROM t").fetchall()[0][0]
        assert got == want or (got is not None and want is not None and math.isnan(got) and math.isnan(want)), xs


def test_no_buffer_of_values(spark):
    """The plan holds no aggregate that keeps values, and what comes to the driver doesn't grow with the table."""
    plan = metrics.score_summary(table(spark, "/root/testdata/sf0.01", "documents"), "n_chars")._jdf.queryExecution().executedPlan().toString()
    assert "median(" not in plan and "percentile(" not in plan
    sizes = []
    for sf in ("sf0.01", "sf0.1"):
        docs = table(spark, f"/root/testdata/{sf}", "lineitem")
        assert selection.median(docs, "l_extendedprice") == duckdb.sql(f"SELECT median(l_extendedprice) FROM '/root/testdata/{sf}/lineitem.parquet'").fetchall()[0][0]
        sizes.append(docs.count())
    assert sizes[1] > 5 * sizes[0]
