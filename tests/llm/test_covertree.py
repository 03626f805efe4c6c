"""Embedding near-duplicates against all pairs."""

import math
from collections import defaultdict

import numpy as np
import pytest

from tokenloom.llm import covertree


def plain(rows, least=0.98):
    """rows: (id, label, vector); the answer for each distinct row, by all pairs."""
    fit = lambda i, g, v: i is not None and g is not None and v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)
    key = lambda r: (r[0], r[1], None if r[2] is None else tuple(str(x) for x in r[2]))
    whole = list({key(r): r for r in rows}.values())
    links, up = [0] * len(whole), list(range(len(whole)))

    def find(k):
        while up[k] != k:
            k = up[k]
        return k

    for a in range(len(whole)):
        for b in range(a):
            (i, g, u), (j, h, v) = whole[a], whole[b]
            if fit(i, g, u) and fit(j, h, v) and g == h and len(u) == len(v) and covertree.cosine(np.array(u, float), np.array(v, float)) >= least:
                links[a] += 1
                links[b] += 1
                up[find(a)] = find(b)
    least_id = defaultdict(lambda: None)
    for k, r in enumerate(whole):
        if r[0] is not None and (least_id[find(k)] is None or r[0] < least_id[find(k)]):
            least_id[find(k)] = r[0]
    answer = {key(r): (r[0], links[k], least_id[find(k)], r[0] is None or r[0] == least_id[find(k)]) for k, r in enumerate(whole)}
    return sorted(map(repr, (answer[key(r)] for r in rows)))


def check(spark, rows, least=0.98):
    df = spark.createDataFrame([(i, g, v, 1, "x") for i, g, v in rows], "vec_id bigint, label int, embedding array<double>, dim int, node string")
    assert sorted(repr(tuple(r)) for r in covertree.near_vectors(df, least=least).collect()) == plain(rows, least)


def clusters(rng, n, dim, near=0.05):
    """Plain vectors, and groups with noise of several sizes, so that pairs lie on both sides of the threshold."""
    x = rng.standard_normal((n, dim))
    for k in range(n // 3):
        x[k] = x[n - 1 - k % 7] + rng.standard_normal(dim) * near * rng.choice([0, 0.2, 1, 2, 4])
    return x


@pytest.mark.parametrize("dim", [2, 3, 16])
def test_dual_traversal(dim):
    rng = np.random.default_rng(dim)
    for turn in range(6):
        v = clusters(rng, 300, dim)
        v[:20] = v[20:40]
        x, w = covertree.unit(v), rng.integers(1, 4, len(v))
        least = [0.98, 0.9, 0.999, 1 - 1e-12, 0.5, -0.2][turn]
        linked = (x @ x.T >= least) & ~np.eye(len(v), dtype=bool)
        near = np.abs(x @ x.T - least) < 1e-9
        linked = np.where(near & ~np.eye(len(v), dtype=bool), [[covertree.cosine(a, b) >= least for b in v] for a in v] if near.any() else linked, linked)
        for split in (None, 120):
            links = covertree.Links(len(v))
            if split is None:
                root = covertree.tree(x)
                tried = covertree.dual(x, v, w, root, root, least, links)
                wanted = linked
            else:
                tried = covertree.dual(x, v, w, covertree.Node(np.arange(split), 0, float(covertree.apart(x[:split], x[:1]).max())), covertree.tree(x, split), least, links)
                wanted = linked.copy()
                wanted[:split, :split] = wanted[split:, split:] = False
            assert (links.weight == wanted @ w).all()
            root = np.arange(len(v))
            for _ in range(len(v)):
                root = np.minimum(root, np.where(wanted, root[None, :], len(v)).min(1))
            assert (links.root == root).all()
            if dim == 2 and least > 0.95:
                assert tried < len(v) * (len(v) - 1) / 4  # most pairs are pruned or linked whole


def test_children_cover():
    rng = np.random.default_rng(1)
    x = covertree.unit(clusters(rng, 500, 3))
    todo = [covertree.tree(x)]
    while todo:
        n = todo.pop()
        kids = covertree.cover(x, n)
        assert sorted(np.concatenate([k.at for k in kids])) == sorted(n.at) and n.center in {k.center for k in kids}
        for k in kids:
            assert covertree.apart(x[k.at], x[[k.center]]).max() <= k.radius + 1e-7 and (k.radius <= n.radius / 2 or n.radius <= covertree.SLACK)
        if len(kids) > 1 and n.radius > 1e-6:
            c = covertree.apart(x[[k.center for k in kids]], x[[k.center for k in kids]])
            assert (c[np.triu_indices(len(c), 1)] > n.radius / 2 - 1e-7).all()
        todo += [k for k in kids if len(k.at) > 1 and k.radius > 1e-6]


@pytest.mark.parametrize("values", [1 << 18, 128 * 8])
def test_against_all_pairs(spark, monkeypatch, values):
    """In one cell for each label, and in many cells and blocks with rows that visit others."""
    monkeypatch.setattr(covertree, "CELL_VALUES", values)
    monkeypatch.setattr(covertree, "VISITORS", 37)
    rng = np.random.default_rng(5)
    v = clusters(rng, 700, 8)
    rows = [(int(i), int(rng.choice([0, 0, 0, 1])), x.tolist()) for i, x in zip(rng.permutation(700), v, strict=True)]
    check(spark, rows)


def test_hot_copies(spark, monkeypatch):
    """A group of near copies beyond a cell is linked from its sizes; another, on both sides of the threshold, in blocks."""
    monkeypatch.setattr(covertree, "CELL_VALUES", 64 * 8)
    rng = np.random.default_rng(6)
    base = rng.standard_normal((3, 8))
    hot = [base[0] + rng.standard_normal(8) * 1e-4 for _ in range(300)] + [base[1] + rng.standard_normal(8) * 0.12 for _ in range(300)] + [base[2]] * 100
    check(spark, [(i, 4, x.tolist()) for i, x in enumerate(hot)])


def test_odd_rows(spark):
    inf, nan = math.inf, math.nan
    rows = [(None, 1, [1.0, 0.0]), (None, 1, [1.0, 0.0]), (1, None, [1.0, 0.0]), (2, 1, None), (3, 1, []), (4, 1, [0.0, 0.0]), (5, 1, [1.0, None]), (6, 1, [nan, 1.0]), (7, 1, [inf, 1.0])]
    rows += [(8, 1, [1.0, 0.0]), (9, 1, [2.0, 0.0]), (9, 1, [2.0, 0.0]), (10, 2, [1.0, 0.0]), (11, 1, [1.0, 0.0, 0.0]), (12, 1, [-0.0, 1.0]), (13, 1, [0.0, 1.0]), (14, 1, [1e-200, 0.0]), (-3, 1, [1e200, 0.0])]
    rows += [(15, 5, [1.0, 0.0]), (15, 5, [0.0, 1.0]), (16, 5, [0.0, 2.0]), (14, 5, [3.0, 0.1])]
    df = spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<double>")
    got = sorted(map(repr, (tuple(r) for r in covertree.near_vectors(df).collect())))
    want = [(None, 0, None, True)] * 2 + [(i, 0, i, True) for i in range(1, 8)] + [(-3, 3, -3, True), (8, 3, -3, False), (9, 3, -3, False), (9, 3, -3, False), (14, 3, -3, False)]
    want += [(10, 0, 10, True), (11, 0, 11, True), (12, 1, 12, True), (13, 1, 12, False), (15, 1, 14, False), (14, 1, 14, True), (15, 1, 15, True), (16, 1, 15, False)]
    assert got == sorted(map(repr, want))
    assert covertree.near_vectors(df.limit(0)).count() == 0


def test_at_the_threshold(spark):
    """0.6 is met exactly by (1, 0) and (0.6, 0.8)."""
    rows = [(1, 1, [1.0, 0.0]), (2, 1, [0.6, 0.8]), (3, 1, [0.6 - 1e-10, 0.8]), (4, 1, [-1.0, 0.0])]
    check(spark, rows, 0.6)
