"""Hard negatives against all scores."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tokenloom.llm import hardneg


def plain(rows, anchor, positives=5, negatives=10, low=30, high=90):
    """rows: (id, label, vector), by whole Python numbers over all pairs."""
    fit = lambda i, g, v: i is not None and g is not None and v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v)
    whole = {(i, g, tuple(math.floor(256 * x) for x in v)) for i, g, v in rows if fit(i, g, v)}
    whole = [r for r in whole if sum(x * x for x in r[2]) < 1 << 62]
    out = []
    for i, g, v in whole:
        if not anchor(i):
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, h) for j, h, w in whole if j != i and len(w) == len(v))
        for s, j, _ in [x for x in scored if x[2] == g][:positives]:
            found = [x for x in scored if x[2] != g and low * -s <= 100 * -x[0] <= high * -s][:negatives]
            out += [(i, j, k, x[1], -s, -x[0]) for k, x in enumerate(found, 1)]
    return sorted(out)


def check(spark, rows, every=10, **options):
    df = spark.createDataFrame([(i, g, v, 3, "x") for i, g, v in rows], "vec_id bigint, label int, embedding array<double>, p int, block string")
    got = hardneg.hard_negatives(df, F.col("vec_id") % every == 0, **options)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = plain(rows, lambda i: i % every == 0, **options)
    assert sorted(map(tuple, got.collect())) == want
    return want


def random_rows(rng, n, dim, labels=3):
    centers = rng.standard_normal((6, dim))
    x = centers[rng.integers(0, 6, n)] + rng.standard_normal((n, dim)) * rng.choice([0.05, 0.5, 1.0], (n, 1))
    x[: n // 10] = np.round(x[: n // 10])  # ties
    return [(int(i), int(rng.choice([0, 0, 0, *range(labels)])), v.tolist()) for i, v in zip(rng.permutation(n), x, strict=True)]


@pytest.mark.parametrize(("values", "blocks"), [(1 << 20, 1 << 15), (40 * 6, 1 << 15), (40 * 6, 3)])
def test_against_all_scores(spark, monkeypatch, values, blocks):
    """In one block, in many with routing by block, and by runs of blocks."""
    monkeypatch.setattr(hardneg, "BLOCK_VALUES", values)
    monkeypatch.setattr(hardneg, "MOST_BLOCKS", blocks)
    rng = np.random.default_rng(13)
    assert check(spark, random_rows(rng, 600, 6))


def test_brackets_hold_and_prune():
    """A score lies in its bracket; near an anchor few rows are checked."""
    rng = np.random.default_rng(3)
    v = np.floor(256 * np.array([r[2] for r in random_rows(rng, 2000, 3)])).astype(np.int64)
    m2 = float((v * v).sum(1).max())
    pivots = hardneg.choose_pivots(hardneg.augmented(v, m2))
    away = hardneg.to_pivots(hardneg.augmented(v, m2), pivots)
    block = hardneg.Block(range(len(v)), ["a", "b"] * (len(v) // 2), list(v), list(away), m2)
    for i in range(0, 2000, 50):
        own = hardneg.to_pivots(np.append(v[i].astype(float), 0.0)[None, :], pivots)[0]
        low, high = block.bracket(v[i], own, np.arange(len(v)))
        s = v @ v[i]
        assert (low <= s).all() and (s <= high).all()
        before = block.checked
        got = block.positives(i, "a", v[i], own, 5)
        assert got == [(j, -x) for x, j in sorted((-int(x), j) for j, x in enumerate(s) if j % 2 == 0 and j != i)[:5]]
        assert block.checked - before <= 1000
    assert block.checked < 0.6 * 40 * 1000


def test_odd_rows(spark):
    inf, nan = math.inf, math.nan
    rows = [(None, 1, [1.0, 0.0]), (0, None, [1.0, 0.0]), (10, 1, None), (20, 1, []), (30, 1, [1.0, None]), (40, 1, [nan, 1.0]), (50, 1, [inf, 1.0]), (60, 1, [1e300, 1.0]), (70, 1, [3e7, 1.0])]
    rows += [(80, 1, [1.0, 0.0]), (80, 1, [1.0, 0.0]), (81, 1, [0.9, 0.1]), (82, 2, [0.5, 0.5]), (83, 2, [0.5, -0.5]), (83, 2, [0.5, -0.5]), (84, 3, [0.0, 0.0]), (90, 3, [0.0, 0.0]), (85, 2, [0.4, 0.0, 0.0])]
    rows += [(100, 5, [1.0, 1.0]), (100, 5, [1.0, 0.2]), (101, 5, [0.7, 0.7]), (101, 6, [0.7, 0.7]), (110, 9, [-1.0, -1.0]), (111, 9, [1.0, 1.0]), (120, 8, [1.0, 0.0, 0.0])]
    want = check(spark, rows)
    assert {r[0] for r in want} >= {80, 90, 100}
    df = spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<double>")
    assert hardneg.hard_negatives(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0
    assert hardneg.hard_negatives(df, F.lit(None).cast("boolean")).count() == 0


def test_large_numbers_and_copies(spark, monkeypatch):
    """Scores beyond 2^53 are exact; a hot label of equal vectors is dealt over many blocks, ties to the smaller id."""
    monkeypatch.setattr(hardneg, "BLOCK_VALUES", 64)
    rng = np.random.default_rng(4)
    rows = [(i, i % 3, [float(x) for x in rng.integers(-(1 << 19), 1 << 19, 3)]) for i in range(60)]
    assert max(abs(r[4]) for r in check(spark, rows)) > 1 << 53
    rows = [(i, 1, [0.5, 0.5]) for i in range(200)] + [(200 + i, 2, [0.4, 0.4]) for i in range(100)]
    check(spark, rows, every=50)


def test_dimensions_without_pivots(spark, monkeypatch):
    """Rarer dimensions beyond the pivots' bound are checked whole, with the same result."""
    monkeypatch.setattr(hardneg, "PIVOT_VALUES", 16 * 5)
    rng = np.random.default_rng(6)
    rows = random_rows(rng, 200, 4) + [(1000 + i, g, v) for i, g, v in random_rows(rng, 100, 7)]
    check(spark, rows)
