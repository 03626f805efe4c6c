"""Language-model scoring against a plain count of everything."""

import math
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from tokenloom.llm import lm
from tokenloom.llm.common import documents

from .conftest import SF


def brute(rows):
    """Counts, base score and known tokens of (doc_id, text) rows by the written rules."""
    split = lambda t: [w.lower() for w in (t or "").encode().split()] + [b""]
    train = [split(t) for i, t in rows if i is not None and zlib.crc32(str(i).encode()) % 5 != 1]
    c = Counter(w for s in train for w in s)
    n, v = sum(c.values()), len(c)
    return {i: (len(s := split(t)), sum(c[w] > 0 for w in s), n, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in s)) for i, t in rows}, train


@pytest.mark.parametrize("block", [50, 2_000_000])
def test_against_brute_force(spark, block):
    df = documents(spark, SF).select("doc_id", "text")
    rows = [tuple(r) for r in df.collect()]
    want, _ = brute(rows)
    got = lm.deleted_interpolation(df, block_tokens=block * 20).collect()
    assert len(got) == len(rows)
    for r in got:
        w = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == w[:3]
        assert r.base_score == pytest.approx(w[3], rel=1e-9)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 1)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_blocks_do_not_matter(spark):
    df = documents(spark, SF).select("doc_id", "text")
    a, b = ({r.doc_id: r.score for r in lm.deleted_interpolation(df, block_tokens=t).collect()} for n, t in ((1, 3000), (1, 10**7)))
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], rel=1e-6) for k in a)


def plain_mixture(rows):
    """Scores by an expectation-maximisation over the held-out tokens one by one."""
    c1, c2, k1, k2, held = Counter(), Counter(), Counter(), Counter(), []
    parts = {i: [b"\n", *(w.lower() for w in t.encode().split()), b""] for i, t in rows}
    for i, s in parts.items():
        f = zlib.crc32(str(i).encode()) % 5
        for h, w in zip(s, s[1:]) if f != 1 else ():
            for one, two in [(c1, c2)] + [(k1, k2)] * (f != 2):
                one[w] += 1
                two[h, w] += 1
                two[h] += 1
            if f == 2:
                held.append((h, w))
    n, v, nk = sum(c1.values()), len(c1), sum(k1.values())
    bucket = lambda c: c.bit_length()

    def learn(events):
        l0 = l1 = l2 = 1 / 3
        for _ in range(60):
            a = b = c = 0.0
            for h, w in events:
                x, y, z = l0 / (v + 1), l1 * k1[w] / nk, l2 * k2[h, w] / k2[h] if k2[h] else 0.0
                a, b, c = a + x / (x + y + z), b + y / (x + y + z), c + z / (x + y + z)
            got = [max(q / len(events), 1e-6) for q in (a, b, c)]
            l0, l1, l2 = (q / sum(got) for q in got)
        return [l0, l1, l2]

    every, of = learn(held), {}
    for k in range(lm.BUCKETS):
        events = [(h, w) for h, w in held if bucket(k2[h]) == k]
        of[k] = learn(events) if events else every
    of[0] = [x / (of[0][0] + of[0][1]) for x in of[0][:2]] + [0.0]
    scores = {}
    for i, s in parts.items():
        p = [(of[bucket(c2[h])], h, w) for h, w in zip(s, s[1:])]
        scores[i] = sum(math.log10(l0 / (v + 1) + l1 * c1[w] / n + (l2 * c2[h, w] / c2[h] if c2[h] else 0)) for (l0, l1, l2), h, w in p)
    return scores


def test_score_is_the_mixture(spark, docs_of):
    """Cells of one value are exact; on documents, an eighth of a nat is near it."""
    rows = [(i, " ".join(f"w{(i * j) % 7}" for j in range(12))) for i in range(40)]
    docs = [(r.doc_id, r.text) for r in documents(spark, SF).select("doc_id", "text").where("length(text) < 3000").collect() if r.text]
    for some, near in ((rows, 2e-4), (docs, 1e-3)):
        want = plain_mixture(some)
        for r in lm.deleted_interpolation(docs_of(some)).collect():
            assert r.score == pytest.approx(want[r.doc_id], rel=near)


def test_ranges_grow_with_the_table(spark, docs_of, monkeypatch):
    seen = []
    real = lm.key_rows
    monkeypatch.setattr(lm, "key_rows", lambda ranges, n: seen.append(ranges) or real(ranges, n))
    monkeypatch.setattr(lm, "RANGE_TOKENS", 10)
    rows = [(i, f"a{i % 3} b c{i} " * 20) for i in range(100)]
    small, large = (lm.deleted_interpolation(docs_of(r)).collect() for r in (rows[:10], rows))
    assert seen[1] >= 200 > seen[0] and len(large) == 100 and len(small) == 10


def test_em_prefers_what_explains():
    t = pd.DataFrame([(3, 0, 0, 10.0, 0.0, 30.0), (4, 20, -999, 10.0, 50.0, 0.0)], columns=["b", "i1", "i2", "n", "s1", "s2"])
    w = lm.em_weights(t)
    assert w[3, 2] > 0.9 and w[4, 1] > 0.9 and w[0, 2] == 0 and np.allclose(w.sum(1), 1)


def test_edges(spark, docs_of):
    long = "a b " * 30_000
    rows = [(1, None), (2, ""), (None, "x y"), (3, " \t\n"), (4, "A a Ä ä"), (4, "A a Ä ä"), (5, long)]
    got = lm.deleted_interpolation(docs_of(rows), block_tokens=10).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[1].n_tokens == by[2].n_tokens == by[3].n_tokens == 1 and by[4].n_tokens == 5 and by[5].n_tokens == 60_001
    assert not by[None].held_out and all(math.isfinite(r.score) and r.score <= 0 for r in got)
    assert lm.deleted_interpolation(docs_of([])).count() == 0
    (r,) = lm.deleted_interpolation(docs_of([(None, "x y z")])).collect()
    assert (r.train_tokens, r.n_known, r.score, r.base_score) == (0, 0, 0.0, 0.0)


def test_squeeze_round_trip():
    for a in (np.array([], np.uint64), np.array([1, 2**63], np.uint64), np.arange(5, dtype=np.int32)):
        b = lm.unsqueeze(lm.squeeze(a))
        assert b.dtype == a.dtype and (a == b).all()
