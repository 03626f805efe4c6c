"""Near duplicates against all pairs of exact sets."""

import pathlib
import random

import numpy as np
import pandas as pd
import pytest

from tokenloom.llm import common, minhash
from tokenloom.llm.common import documents
from tokenloom.llm.components import components

from .conftest import SF


def brute(rows, width):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()

    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def rows_of(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect()}


@pytest.mark.parametrize("width", [2, 5])
def test_against_all_pairs(spark, width):
    df = documents(spark, SF)
    assert rows_of(minhash.near_duplicates(df, width=width)) == brute([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()], width)


def test_chains_and_hot_groups(docs_of):
    """Chains whose ends are unlike, near copies that differ from their bucket's smallest, and a shared passage."""
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(60)]
    rows, at = [], 0
    for _ in range(80):  # near copies of various distances
        w = list(base)
        for _ in range(rng.randrange(12)):
            w[rng.randrange(60)] = f"v{rng.randrange(10**6)}"
        rows.append((at, " ".join(w)))
        at += 1
    w = list(base)
    for k in range(30):  # a chain
        w[2 * k] = f"c{k}"
        rows.append((at, " ".join(w)))
        at += 1
    for _ in range(40):  # a passage that fills half
        rows.append((at, " ".join(base[:30] + [f"u{rng.randrange(10**6)}" for _ in range(30)])))
        at += 1
    rng.shuffle(rows)
    assert rows_of(minhash.near_duplicates(docs_of(rows), width=2)) == brute(rows, 2)


def test_families(docs_of, monkeypatch):
    """Large families, most of whose members are just not alike enough, in runs smaller than them."""
    monkeypatch.setattr(minhash, "HOLD", 1000)
    rng = random.Random(9)
    base = [f"w{rng.randrange(10**6)}" for _ in range(80)]
    rows = []
    for at in range(150):
        w = list(base)
        for _ in range(rng.choice([3, 6, 8, 9, 10, 12])):
            w[rng.randrange(80)] = f"v{rng.randrange(10**6)}"
        rows.append((at, " ".join(w)))
    rng.shuffle(rows)
    want = brute(rows, 2)
    assert 3 < len({c for _, c, _ in want.values()}) < 150
    assert rows_of(minhash.near_duplicates(docs_of(rows), width=2)) == want


def test_edges(docs_of):
    long = " ".join(f"x{i % 5000}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "One"), (5, "one"), (6, "one two"), (7, long), (8, long + " y"), (9, "ONE")]
    assert rows_of(minhash.near_duplicates(docs_of(rows), width=2)) == brute(rows, 2)
    got = minhash.near_duplicates(docs_of([(None, "a b c"), (1, "a b c"), (1, "a b c")]), width=2).collect()
    assert sorted((r.doc_id is None, r.component_id or 0, r.kept) for r in got) == [(False, 1, True), (False, 1, True), (True, 0, True)]
    assert minhash.near_duplicates(docs_of([])).count() == 0
    kept = minhash.keep_one(docs_of([(3, "a b c d e f"), (2, "A b c d e f"), (4, None)]))
    assert sorted(r.doc_id for r in kept.collect()) == [2, 4] and "n_tokens" in kept.columns


def test_two_texts_under_one_id(docs_of):
    a, b = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    got = minhash.near_duplicates(docs_of([(7, a), (7, b), (9, a + " x"), (5, b + " y"), (11, "z")]), width=2).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == [(5, 40, 5, True), (7, 39, 5, False), (7, 39, 7, True), (9, 40, 7, False), (11, 1, 11, True)]


def test_hubs_of_split_bands():
    """Bands that go on over batches and partitions keep one hub."""
    rows = [(b, n) for b, nodes in ((1, [4]), (2, [3, 3, 5]), (3, list(range(10, 40))), (4, [1]), (5, [2, 9])) for n in nodes]
    for cuts in ([], [1, 2], [6], [3, 20, 30], list(range(1, len(rows)))):
        out = []
        for lo, hi in zip([0, *cuts], [*cuts, len(rows)], strict=True):
            frames = [pd.DataFrame(rows[lo:hi][k : k + 2], columns=["band", "node"]) for k in range(0, hi - lo, 2)]
            out += [tuple(None if pd.isna(x) else int(x) for x in r) for f in minhash.to_hubs(iter(frames)) for r in f.itertuples(index=False)]
        whole: dict = {}
        for b, n, h in out:
            if n is None:
                whole[b] = min(whole.get(b, h), h)
        got = {(h if n is None else n, whole.get(b, h)) for b, n, h in out}
        assert {x for x in got if x[0] != x[1]} == {(5, 3), (9, 2)} | {(n, 10) for n in range(11, 40)}
    assert list(minhash.to_hubs(iter([pd.DataFrame({"band": [], "node": []}, dtype="int64")]))) == []


def test_disk_of_one_group(spark, docs_of, monkeypatch):
    """What lies on disk at once for one large group of near copies is at most four times its texts."""
    rng, base, rows = random.Random(3), [f"w{k}" for k in range(200)], []
    for at in range(1200):
        w = list(base)
        for _ in range(rng.randrange(1, 60)):
            w[rng.randrange(200)] = f"v{rng.randrange(10**6)}"
        rows.append((at, " ".join(w)))
    most, keep = 0, common.Steps.keep

    def measured(self, name, df):
        nonlocal most
        out = keep(self, name, df)
        most = max(most, sum(p.stat().st_size for p in pathlib.Path(self.home.removeprefix("file:")).rglob("*.parquet")))
        return out

    monkeypatch.setattr(common.Steps, "keep", measured)
    assert rows_of(minhash.near_duplicates(docs_of(rows), width=2)) == brute(rows, 2)
    assert 0 < most <= 4 * sum(len(t) for _, t in rows)


def test_coordinates_estimate_similarity():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 900).astype(np.uint64)
    b = np.concatenate([a[:800], rng.integers(0, 2**63, 100).astype(np.uint64)])
    same = (minhash.signature(a) == minhash.signature(b)).mean()
    assert abs(same - 0.8) < 0.12


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, k) for k in range(101, 140)] + [(50, 50)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {i: 0 for i in range(1, 31)} | {k: 100 for k in range(101, 140)}
    assert components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_prefix_lists_lose_nothing(spark):
    """Any two alike sets of different components lie in one group of the lists; sets with too much of their own lie in none."""
    rng = random.Random(8)
    base = list(range(1000, 1060))
    for percent in (80, 50, 95):
        sets = []
        for _ in range(160):
            own = [x for x in base if rng.random() < rng.choice([0.7, 0.95, 1.0])]
            sets.append(sorted({*own, *(rng.randrange(1060, 1300) for _ in range(rng.choice([0, 1, 3, 8, 20])))}) or [1])
        members = [(0, 1000 + k if k % 5 else 1000, k, len(s)) for k, s in enumerate(sets)]
        m = spark.createDataFrame(members, "group bigint, component bigint, node bigint, n_shingles bigint")
        of = spark.createDataFrame(list(enumerate(sets)), "node bigint, shingles array<bigint>")
        got: dict = {}
        for r in minhash._listed(m, of, percent, common.Steps(spark, "t")).collect():
            got.setdefault(r.node, set()).add(r.group)
        alike = 0
        for a in range(160):
            for b in range(a):
                x, y = set(sets[a]), set(sets[b])
                if members[a][1] != members[b][1] and 100 * len(x & y) >= percent * len(x | y):
                    alike += 1
                    assert got[a] & got[b], (a, b, percent)
        assert alike > 20 or percent == 95
    # a template with a seventh of shingles of their own: each shares 6/7 with every other, and none is alike
    rows = [(0, k, k, 140) for k in range(300)]
    of = spark.createDataFrame([(k, [*range(120), *range(1000 * (k + 1), 1000 * (k + 1) + 20)]) for k in range(300)], "node bigint, shingles array<bigint>")
    left = minhash._listed(spark.createDataFrame(rows, m.schema), of, 80, common.Steps(spark, "t"))
    assert left.count() == 0
    assert minhash._eligible(spark.createDataFrame(rows, m.schema), of, 80).count() == 300  # by the share of their own alone they would all be compared
