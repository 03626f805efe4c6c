"""Nearest neighbours against brute force."""

import numpy as np
from pyspark.sql import functions as F

from tokenloom.llm import neighbours
from tokenloom.session import table

SCHEMA = "vec_id bigint, embedding array<float>, label int, rank int"


def brute(rows, k=5, every=50):
    ok = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, a in ok:
        if q % every == 0:
            best = {}
            for i, b in ok:
                if i != q and len(a) == len(b):
                    best[i] = max(best.get(i, -2.0), float((a * b).sum() / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum()))))
            out[q] = sorted((-s, i) for i, s in best.items())[:k]
    return out


def test_recall(spark):
    df = table(spark, "/root/testdata/sf0.1", "embeddings")
    want = brute([(r.vec_id, r.embedding) for r in df.collect()])
    got = {}
    for r in neighbours.nearest(df, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    assert got.keys() == want.keys() and all(sorted(x) == list(range(1, 6)) for x in got.values())
    hits = sum(len({i for _, i in want[q]} & {i for i, _ in got[q].values()}) for q in want)
    assert hits / (5 * len(want)) >= 0.95
    for q, x in got.items():
        exact = dict((i, -s) for s, i in brute_all(df, q))
        assert all(abs(exact[i] - s) < 1e-12 for i, s in x.values())
        break


def brute_all(df, q):
    return brute([(r.vec_id, r.embedding) for r in df.collect()], k=10**9)[q]


def test_ties_and_edges(spark):
    same = [(i, [1.0, 2.0, 3.0]) for i in range(0, 400)]
    odd = [(None, [1.0, 2.0, 3.0]), (1000, None), (1050, [0.0, 0.0, 0.0]), (1100, [1.0, None, 2.0]), (1150, [float("nan"), 1.0, 1.0]), (1200, [float("inf"), 0.0, 1.0]), (1250, []), (1300, [1.0, 0.0]), (1301, [1.0, 1.0]), (1350, [5.0] * 7), (50, [1.0, 2.0, 3.0])]
    rows = same + odd
    df = spark.createDataFrame([(i, v, 0, 0) for i, v in rows], SCHEMA)
    got = {}
    for r in neighbours.nearest(df, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, round(r.score, 9)))
    want = {q: [(n, i, round(-s, 9)) for n, (s, i) in enumerate(x, 1)] for q, x in brute(rows).items() if x}
    assert {q: sorted(x) for q, x in got.items()} == want
    assert neighbours.nearest(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_repeated_rows_take_one_place(spark):
    rng = np.random.default_rng(5)
    once = [(i, rng.standard_normal(6).tolist()) for i in range(200)]
    near = (np.array(once[50][1]) + 1e-3).tolist()
    # the same vector under more ids, one of them 10 times; and one id on many vectors near a query
    once += [(300, near), (301, near), (302, near)] + [(401, (np.array(once[100][1]) + 1e-4 * n).tolist()) for n in range(20)]
    rows = once + once + [(300, near)] * 8
    got = {}
    for r in neighbours.nearest(spark.createDataFrame([(i, v, 0, 0) for i, v in rows], SCHEMA), F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, round(r.score, 9)))
    want = {q: [(n, i, round(-s, 9)) for n, (s, i) in enumerate(x, 1)] for q, x in brute(once).items()}
    assert {q: sorted(x) for q, x in got.items()} == want


def test_block_counts_ids_once():
    rng = np.random.default_rng(6)
    ids = np.array([1] * 40 + [2] * 40 + list(range(10, 2000)))
    v = np.concatenate([[1.0, 0, 0, 0] + rng.standard_normal((80, 4)) * 1e-3, rng.standard_normal((1990, 4))])
    best = neighbours.Block(np.repeat(ids, 3), np.repeat(v, 3, 0), 5).search(2, np.array([1.0, 0, 0, 0]), 5, 1.0)
    cost = {}
    for i, c in zip(ids.tolist(), (-v[:, 0] / neighbours.lengths(v)).tolist(), strict=True):
        cost[i] = min(cost.get(i, 2.0), c)
    assert [i for _, i in best] == sorted(cost.keys() - {2}, key=lambda i: (cost[i], i))[:5]


def test_cells_cover_space():
    rng = np.random.default_rng(3)
    places = rng.standard_normal((3000, neighbours.DIRECTIONS))
    tree = neighbours.Cells(places, 37)
    at = tree.of(places)
    assert len(tree) == 37 and np.bincount(at, minlength=37).min() > 30
    assert ((tree.low[at] <= places) & (places <= tree.high[at])).all()
    assert (tree.of(rng.standard_normal((50, neighbours.DIRECTIONS)) * 99) >= 0).all()
    assert len(neighbours.Cells(np.ones((50, neighbours.DIRECTIONS)), 9)) == len(neighbours.Cells(places[:0], 9)) == 1
    for q in places[:20]:
        assert set(at[((places - q) ** 2).sum(1) <= neighbours.reach_of(0.1, 0.9)]) <= set(tree.near(q, 0.1, 0.9))
    assert len(tree.near(places[0], float("inf"), 0.98)) == 37


def test_routed_search(spark, monkeypatch):
    """Clusters over many cells, one vector on a third of the rows, ids on rows of several cells, and two dimensions."""
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 128)
    rng = np.random.default_rng(7)
    centres = rng.standard_normal((40, 16))
    rows = [(i, (centres[i % 40] + 0.15 * rng.standard_normal(16)).tolist()) for i in range(2500)]
    rows += [(10_000 + i, centres[0].tolist()) for i in range(1200)] + [(i, centres[(i + 1) % 40].tolist()) for i in range(0, 500, 25)]
    rows += [(20_000 + i, rng.standard_normal(5).tolist()) for i in range(300)] + [(30_000, [1.0, 2.0])]
    want, got = brute(rows), {}
    for r in neighbours.nearest(spark.createDataFrame([(i, v, 0, 0) for i, v in rows], SCHEMA), F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    want = {q: x for q, x in want.items() if x}
    assert got.keys() == want.keys() and all(sorted(x) == list(range(1, 6)) for x in got.values())
    hits = sum(len({i for _, i in want[q]} & {i for i, _ in got[q].values()}) for q in want)
    assert hits / (5 * len(want)) >= 0.95


def test_known_distances_spare_points():
    rng = np.random.default_rng(9)
    v = np.repeat(rng.standard_normal((30, 12)), 60, 0) + 0.05 * rng.standard_normal((1800, 12))
    block, far = neighbours.Block(np.arange(1800), v, 5), neighbours.Block(np.arange(1800), v, 5)
    best = block.search(3, v[3], 5, 0.98)
    within = 2 + 2 * best[-1][0]
    assert far.search(3, v[3], 5, 0.98, within) == best and far.verified <= block.verified < 1800


def test_chi_square():
    x = np.random.default_rng(0).chisquare(8, 200_000)
    for at in (2.0, 7.3, 15.0):
        assert abs((x < at).mean() - neighbours.chi_square_below(at)) < 0.01
