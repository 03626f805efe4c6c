"""The toxicity network: gradients, windows, held-out results and edges."""

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tokenloom.llm import toxicity
from tokenloom.session import table


def test_gradients():
    rng, net = np.random.default_rng(0), toxicity.Network(3)
    net.p = {k: v.astype(float) for k, v in net.p.items()}
    inputs, ids, y = rng.standard_normal((20, toxicity.N_INPUTS)), rng.integers(1, 20, (5, toxicity.WINDOW)), np.array([1, 0, 1, 0, 1.0])
    ids[0, 10:], ids[1, 1:] = 0, 0

    def loss():
        o = net.forward(inputs, ids)
        return (np.log1p(np.exp(-o)) * y + np.log1p(np.exp(o)) * (1 - y)).sum()

    keep = {}
    g = net.backward(keep, toxicity._sigmoid(net.forward(inputs, ids, keep)) - y)
    for name, v in net.p.items():
        flat, i = v.reshape(-1), rng.integers(v.size)
        old = flat[i]
        sides = []
        for e in (1e-3, -1e-3):
            flat[i] = old + e
            sides.append(loss())
        flat[i] = old
        assert (sides[0] - sides[1]) / 2e-3 == pytest.approx(g[name].reshape(-1)[i], abs=2e-4), name


def test_windows_cover():
    for n in (0, 1, 31, 32, 33, 100, 1000):
        w = toxicity.windows_of(np.arange(1, n + 1, dtype=np.int32))
        assert set(w.ravel()) - {0} == set(range(1, n + 1)) and w.shape[1] == toxicity.WINDOW


def test_passages_of_half_a_window_are_whole():
    half, n = toxicity.WINDOW // 2, 1000
    begins = {int(w[0]) for w in toxicity.windows_of(np.arange(1, n + 1, dtype=np.int32))}
    for at in range(1, n - half + 2):
        assert any(b in begins for b in range(at + half - toxicity.WINDOW, at + 1)), at


def test_passage_at_every_offset():
    rng = np.random.default_rng(4)
    clean = lambda n: [f"w{i}" for i in rng.integers(0, 300, n)]
    texts = [" ".join([*clean(30), *(["vile", "scum"] if k % 3 == 0 else []), *clean(10)]) for k in range(300)]
    model = toxicity.train(texts, np.array([k % 3 == 0 for k in range(300)]))
    long = clean(400)
    assert model.scores([" ".join(long)])[0] < 0.5
    planted = [" ".join([*long[:at], "vile", *long[at : at + 12], "scum", *long[at + 12 :]]) for at in range(150, 200)]
    assert (model.scores(planted) >= 0.5).all()


def test_held_out(spark):
    docs, labels = (table(spark, "/root/testdata/sf0.1", n) for n in ("documents", "labels"))
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    got = [r for r in toxicity.score_toxicity(docs, labels).collect() if r.held_out and truth.get(r.doc_id) is not None]
    hit = [r.predicted for r in got if truth[r.doc_id] == 1]
    false = [r.predicted for r in got if truth[r.doc_id] == 0]
    assert np.mean(hit) >= 0.85 and np.mean(false) <= 0.03
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)


def test_edges(spark, docs_of):
    docs = docs_of([(1, None), (2, ""), (3, "fine words " * 30_000), (None, "x"), (4, "12 ?!"), (4, "12 ?!")])
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    got = toxicity.score_toxicity(docs, none).collect()
    assert len(got) == 6 and {r.score for r in got} == {0.0} and not next(r for r in got if r.doc_id is None).held_out
    ids = [i for i in range(60)]
    docs = docs_of([(i, ("bad awful words" if i % 2 else "kind good words") + f" n{i}") for i in ids] + [(None, None), (99, "")])
    labels = spark.createDataFrame([(i, i % 2) for i in ids] + [(1, None)], "doc_id bigint, toxic int")
    by = {r.doc_id: r for r in toxicity.score_toxicity(docs, labels).collect()}
    assert len(by) == 62 and np.mean([by[i].predicted == i % 2 for i in ids]) > 0.95
    assert toxicity.keep_civil(docs, labels).columns == docs.columns
    assert toxicity.score_toxicity(docs_of([]), none).count() == 0


def plain_score(model, text):
    """The score of a text by loops over windows, words and units."""
    p, half = {k: v.astype(float) for k, v in model.net.p.items()}, toxicity.HIDDEN
    sig = lambda x: 1 / (1 + np.exp(-x))
    words = (text or "").lower().encode().translate(toxicity._PARTS).split()
    mask = (1 << toxicity.HASH_BITS) - 1

    def of_word(w):
        x = [model.odds.words[xxhash.xxh32_intdigest(w) & mask]]
        raw = b"\x01" + w + b"\x02"
        for n, odds in zip(toxicity.GRAMS, model.odds.grams, strict=True):
            found = []
            for at in range(len(raw) - n + 1):
                h = n
                for b in raw[at : at + n]:
                    h = (h ^ b) * 0x9E3779B1 & 0xFFFFFFFF
                    h ^= h >> 15
                found.append(odds[h & mask])
            x += [max(found), sum(found) / len(found)] if found else [0.0, 0.0]
        return np.array([*x, 1.0])

    def run(d, xs):
        h, out = np.zeros(half), []
        for x in xs:
            a, b = x @ p[f"w{d}"], h @ p[f"u{d}"]
            z, r = sig(a[:half] + b[:half]), sig(a[half : 2 * half] + b[half : 2 * half])
            n = np.tanh(a[2 * half :] + r * b[2 * half :])
            h = (1 - z) * n + z * h
            out.append(h)
        return out

    best, at = -np.inf, 0
    while True:
        part = words[at : at + toxicity.WINDOW]
        if part:
            xs = [of_word(w) for w in part]
            hs = [np.concatenate(x) for x in zip(run("f", xs), run("b", xs[::-1])[::-1], strict=True)]
            e = np.array([np.tanh(h @ p["wa"] + p["ba"]) @ p["va"] for h in hs])
            e = np.exp(e - e.max())
            c = sum(w * h for w, h in zip(e / e.sum(), hs, strict=True))
        else:
            c = np.zeros(2 * half)
        best = max(best, float(c @ p["wo"] + p["bo"][0]))
        if at + toxicity.WINDOW >= len(words):
            return sig(model.slope * best + model.shift)
        at += toxicity.STRIDE


def test_against_plain_loops():
    rng = np.random.default_rng(8)
    word = lambda: "".join(rng.choice(list("abcdeé")) for _ in range(rng.integers(1, 7)))
    texts = [" ".join([word() for _ in range(rng.integers(1, 90))] + ["vile"] * (k % 2)) for k in range(80)]
    model = toxicity.train(texts, np.arange(80) % 2)
    shown = [*texts[:12], None, "", " ?! ", "vile", " ".join(word() for _ in range(200)), "é" * 30]
    assert np.allclose(model.scores(shown), [plain_score(model, t) for t in shown], atol=2e-4)


def test_sample_is_bounded(spark, monkeypatch):
    """One id on very many rows gives one text to learn from."""
    rows = spark.range(100_000).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("bad thing "), "id").alias("text"))
    docs = rows.union(spark.range(2, 5000).select("id", F.concat(F.lit("good thing "), "id")))
    labels = spark.range(1, 5000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"))
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda texts, *_: seen.append(len(texts)))
    toxicity.learn(docs, labels.union(labels), sample=200)
    toxicity.learn(docs, labels.where("doc_id < 40"), sample=200)
    assert seen[0] <= 200 and seen[0] > 100 and seen[1] <= 39


def plain_draw(docs, labels, sample, longest):
    """The texts and labels to learn from: of each label the first by the hash of the id, of those that have a text."""
    import zlib

    texts = {}
    for i, t in docs:
        if i is not None and t is not None and len(t) <= longest:
            texts.setdefault(i, set()).add(t)
    pairs = {(i, y) for i, y in labels if i is not None and y in (0, 1) and zlib.crc32(str(i).encode()) % 5 and i in texts}
    return texts, pairs


def test_sample_meets_documents_first(spark, monkeypatch):
    """Labels of absent ids change nothing, and texts beyond the bound are replaced by the next drawn."""
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda texts, labels, share: seen.append((list(texts), list(labels), share)))
    rows = [(i, f"text {i}" + (" long" * 100 if i % 3 == 0 else "")) for i in range(400)] + [(5, "text 5 again"), (None, "x"), (401, None)]
    own = [(i, i % 2) for i in range(0, 400, 2)] + [(i, 1) for i in range(1, 400, 4)] + [(7, None), (None, 1), (401, 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    for labels in (own, own + [(i, i % 2) for i in range(1000, 60_000)], own * 3):
        toxicity.learn(docs, spark.createDataFrame(labels, "doc_id bigint, toxic int"), sample=60, longest=100)
    assert seen[0] == seen[1] == seen[2]
    texts, pairs = plain_draw(rows, own, 60, 100)
    got = seen[0]
    assert sum(got[1]) == 30 and len(got[1]) == 60 and got[2] == pytest.approx(sum(y for _, y in pairs) / len(pairs))
    ids = {i: h for i, h in spark.range(401).select("id", F.xxhash64("id")).collect()}
    want = sorted((i, y) for k in (0, 1) for i, y in sorted((p for p in pairs if p[1] == k), key=lambda p: (ids[p[0]], p[0]))[:30])
    assert [y for _, y in want] == got[1] and all(t in texts[i] for (i, _), t in zip(want, got[0], strict=True))


def test_only_long_texts(spark):
    docs = spark.createDataFrame([(i, "word " * 50) for i in range(20)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id bigint, toxic int")
    model = toxicity.learn(docs, labels, longest=10)
    assert model.net is None and model.shift == 0.0
