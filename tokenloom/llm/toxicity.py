"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

Each word enters with word inputs (the smoothed log odds of the whole word) and character inputs (largest and mean log
odds of its 3-, 4- and 5-grams of bytes, with word borders); a forward and a backward gated recurrent layer run over a
window of words, attention pools them, and a logistic output scores the window. Windows overlap by half, so a passage of up to
half a window is whole in one; every window of a text is scored, and the text's score is the calibrated largest. So one
bad line in a very long text counts.

Learning uses a bounded sample of labelled rows: at most ``sample`` texts, one for each of the (id, label) pairs that a
hash of the id draws, half of them labelled 1 where there are as many, each of at most ``longest`` characters. Pairs are drawn
of those that have such a text, so labels without documents, or of documents that are too long, neither take a place nor count
in the labels' shares. However
often an id is repeated, the driver gets one text of it. The log odds that a training text meets come from the other half of the sample, so
the network learns to trust them as far as they carry over. The text's window is learned along: of a text labelled 1,
the window that now scores highest; of the others, that one and one at random.

Defined results: null, empty and wordless texts get the score of an empty window; without labels of both kinds, every
text gets the share of label 1 (0 without labels). A null id is scored, neither learned from nor held out. Repeated rows
are scored each; labels that are null are ignored; further columns are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.llm.common import Steps, fold

WINDOW, STRIDE = 32, 16
HIDDEN, ATTENTION = 8, 8
GRAMS, HASH_BITS = (3, 4, 5), 18
N_INPUTS = 1 + 2 * len(GRAMS) + 1
OUT = "doc_id bigint, held_out boolean, score double, predicted int"
#: ASCII other than letters and digits parts words; so do the bytes of no letter only by ASCII rules.
_PARTS = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def split(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "replace").translate(_PARTS).split()


class Vocabulary:
    """The distinct words of some texts; id 0 is padding."""

    def __init__(self, texts: list[str | None]):
        ids: dict[bytes, int] = defaultdict(count().__next__)
        ids[b""]
        self.docs = [np.fromiter(map(ids.__getitem__, split(t)), np.int32) for t in texts]
        self.words = list(ids)

    def hashes(self) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """A hash of each word, and per n-gram length (hash, word) of every n-gram."""
        mask = (1 << HASH_BITS) - 1
        whole = np.array([xxhash.xxh32_intdigest(w) & mask for w in self.words], np.int64)
        raw = np.frombuffer(b"".join(b"\x01" + w + b"\x02" for w in self.words), np.uint8)
        lengths = np.array([len(w) + 2 for w in self.words])
        owner, ends = np.repeat(np.arange(len(lengths)), lengths), np.cumsum(lengths)
        out = []
        for n in GRAMS:
            if len(raw) < n:
                out.append((np.empty(0, np.int64), np.empty(0, np.int64)))
                continue
            m = len(raw) - n + 1
            inside = np.arange(m) + n <= ends[owner[:m]]
            h = np.full(m, n, np.uint32)
            for j in range(n):
                h = (h ^ raw[j : m + j]) * np.uint32(0x9E3779B1)
                h ^= h >> np.uint32(15)
            out.append(((h[inside] & np.uint32(mask)).astype(np.int64), owner[:m][inside]))
        return whole, out


@dataclass
class Odds:
    """Smoothed log odds of words and n-grams by the number of texts of each label that hold them."""

    words: np.ndarray
    grams: list[np.ndarray]

    def inputs(self, v: Vocabulary) -> np.ndarray:
        whole, grams = v.hashes()
        out = np.zeros((len(v.words), N_INPUTS), np.float32)
        out[:, 0] = self.words[whole]
        for k, ((h, owner), table) in enumerate(zip(grams, self.grams, strict=True)):
            if len(h):
                starts = np.flatnonzero(np.diff(owner, prepend=-1))
                at, value = owner[starts], table[h]
                out[at, 1 + 2 * k] = np.maximum.reduceat(value, starts)
                out[at, 2 + 2 * k] = np.add.reduceat(value, starts) / np.diff(starts, append=len(h))
        out[:, -1] = 1.0
        out[0] = 0.0
        return out


def learn_odds(v: Vocabulary, docs: np.ndarray, labels: np.ndarray, rare: int = 3) -> Odds:
    whole, grams = v.hashes()
    size, sums = 1 << HASH_BITS, [labels[docs].sum() + 1.0, (1 - labels[docs]).sum() + 1.0]

    def table(keys_of) -> np.ndarray:
        n = [np.zeros(size), np.zeros(size)]
        for d in docs:
            n[0 if labels[d] else 1][np.unique(keys_of(np.unique(v.docs[d])))] += 1
        pos, neg = n
        got = np.log((pos + 0.5) / sums[0]) - np.log((neg + 0.5) / sums[1])
        return np.where(pos + neg >= rare, got, 0.0).astype(np.float32)

    tables = []
    for h, owner in grams:
        first = np.searchsorted(owner, np.arange(len(v.words) + 1))

        def keys(ids: np.ndarray, h=h, first=first) -> np.ndarray:
            n = first[ids + 1] - first[ids]
            return h[np.repeat(first[ids] - np.cumsum(n) + n, n) + np.arange(n.sum())]

        tables.append(table(keys))
    return Odds(table(lambda ids: whole[ids]), tables)


def windows_of(doc: np.ndarray) -> np.ndarray:
    """All windows of a text, padded with 0; one of padding only for a text without words."""
    n = 1 + max(0, -(-(len(doc) - WINDOW) // STRIDE))
    flat = np.zeros((n - 1) * STRIDE + WINDOW, np.int32)
    flat[: len(doc)] = doc
    return np.lib.stride_tricks.sliding_window_view(flat, WINDOW)[::STRIDE]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        y = np.exp(-x)
    y += 1
    return np.reciprocal(y, out=y)


class Network:
    """Parameters, forward and backward passes."""

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        init = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {}
        for d in "fb":
            self.p |= {f"w{d}": init(N_INPUTS, 3 * HIDDEN), f"u{d}": init(HIDDEN, 3 * HIDDEN)}
        self.p |= {"wa": init(2 * HIDDEN, ATTENTION), "ba": np.zeros(ATTENTION, np.float32), "va": init(ATTENTION), "wo": init(2 * HIDDEN), "bo": np.zeros(1, np.float32)}

    # Arrays hold (.., unit, window), so that each operation runs along many windows.
    def _run(self, d: str, projected: np.ndarray, ids: np.ndarray, keep: list | None) -> np.ndarray:
        u, h = np.ascontiguousarray(self.p[f"u{d}"].T), np.zeros((HIDDEN, ids.shape[1]), np.float32)
        out = np.empty((len(ids), HIDDEN, ids.shape[1]), np.float32)
        whole = (ids > 0).all(1)
        for t in range(len(ids)) if d == "f" else range(len(ids) - 1, -1, -1):
            x, hu = projected.take(ids[t], 1), u @ h
            last = hu[2 * HIDDEN :]
            gates = x[: 2 * HIDDEN]
            gates += hu[: 2 * HIDDEN]
            gates = _sigmoid(gates)
            z, r = gates[:HIDDEN], gates[HIDDEN:]
            n = x[2 * HIDDEN :]
            n += r * last
            n = np.tanh(n)
            new = h - n
            new *= z
            new += n
            if not whole[t]:
                new = np.where(ids[t] > 0, new, h)
            if keep is not None:
                keep.append((t, h, z, r, n, last, ids[t] > 0))
            h = out[t] = new
        return out

    def forward(self, inputs: np.ndarray, windows: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """The logit of each window."""
        ids, p = np.ascontiguousarray(windows.T), self.p
        tapes = {d: [] if keep is not None else None for d in "fb"}
        h = np.concatenate([self._run(d, np.ascontiguousarray((inputs @ p[f"w{d}"]).T), ids, tapes[d]) for d in "fb"], 1)
        a = np.tanh(p["wa"].T @ h + p["ba"][:, None])
        e = np.where(ids > 0, p["va"] @ a, np.float32(-1e9))
        e = np.exp(e - e.max(0))
        e /= e.sum(0)
        c = (e[:, None] * h).sum(0)
        if keep is not None:
            keep |= {"tapes": tapes, "h": h, "a": a, "e": e, "c": c, "ids": ids, "inputs": inputs}
        return p["wo"] @ c + p["bo"][0]

    def backward(self, keep: dict, d_logit: np.ndarray) -> dict[str, np.ndarray]:
        p, g = self.p, {}
        h, a, e, c, ids = (keep[k] for k in ("h", "a", "e", "c", "ids"))
        g["wo"], g["bo"] = c @ d_logit, d_logit.sum(keepdims=True)
        dc = p["wo"][:, None] * d_logit
        de = (h * dc).sum(1)
        de = e * (de - (e * de).sum(0))
        g["va"] = (a * de[:, None]).sum((0, 2))
        da = de[:, None] * p["va"][:, None] * (1 - a * a)
        g["wa"], g["ba"] = np.matmul(h, da.transpose(0, 2, 1)).sum(0), da.sum((0, 2))
        dh = e[:, None] * dc + p["wa"] @ da
        for k, d in enumerate("fb"):
            u, own = p[f"u{d}"], dh[:, k * HIDDEN : (k + 1) * HIDDEN]
            gw, gu, flow = np.zeros_like(p[f"w{d}"]), np.zeros_like(u), np.zeros((HIDDEN, ids.shape[1]), np.float32)
            for t, before, z, r, n, last, m in reversed(keep["tapes"][d]):
                flow = flow + own[t]
                new = flow * m
                dn = new * (1 - z) * (1 - n * n)
                dz, dr = new * (before - n) * z * (1 - z), dn * last * r * (1 - r)
                gw += keep["inputs"][ids[t]].T @ np.concatenate([dz, dr, dn]).T
                du = np.concatenate([dz, dr, dn * r])
                gu += before @ du.T
                flow = np.where(m, new * z, flow) + u @ du
            g[f"w{d}"], g[f"u{d}"] = gw, gu
        return g

    def step(self, g: dict[str, np.ndarray], rate: float, state: dict) -> None:
        """Adam."""
        state["t"] = state.get("t", 0) + 1
        for k, x in g.items():
            m, v = state.get(k, (0.0, 0.0))
            m, v = 0.9 * m + 0.1 * x, 0.99 * v + 0.01 * x * x
            state[k] = m, v
            self.p[k] = (self.p[k] - rate * (m / (1 - 0.9 ** state["t"])) / (np.sqrt(v / (1 - 0.99 ** state["t"])) + 1e-8)).astype(np.float32)


def logits(net: Network, inputs: np.ndarray, ids: np.ndarray, part: int = 4096) -> np.ndarray:
    return np.concatenate([net.forward(inputs, ids[at : at + part]) for at in range(0, len(ids), part)]) if len(ids) else np.empty(0, np.float32)


@dataclass
class Model:
    odds: Odds | None
    net: Network | None
    slope: float
    shift: float

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.net is None:
            return np.full(len(texts), self.shift)
        v = Vocabulary(texts)
        windows = [windows_of(d) for d in v.docs]
        starts = np.cumsum([0, *map(len, windows)])[:-1]
        got = logits(self.net, self.odds.inputs(v), np.concatenate(windows))
        return _sigmoid(self.slope * np.maximum.reduceat(got, starts).astype(float) + self.shift)


def train(texts: list[str], labels: np.ndarray, share: float | None = None, rounds: int = 4, batch: int = 256, rate: float = 0.02, seed: int = 5) -> Model:
    labels = np.asarray(labels, int)
    if len(set(labels.tolist())) < 2:
        return Model(None, None, 0.0, float(labels.mean()) if len(labels) else 0.0)
    rng, v = np.random.default_rng(seed), Vocabulary(texts)
    half = rng.permutation(len(texts)) % 2
    size = len(v.words)
    # rows of the other half's inputs for each half, one after the other
    inputs = np.concatenate([learn_odds(v, np.flatnonzero(half != k), labels).inputs(v) for k in (0, 1)])
    windows = [np.where(w > 0, w + size * half[i], 0) for i, w in enumerate(map(windows_of, v.docs))]
    flat, starts = np.concatenate(windows), np.cumsum([0, *map(len, windows)])
    net, state = Network(seed), {}
    # before the first round: by the inputs alone
    now = np.concatenate([inputs[flat[at : at + 4096]][:, :, :-1].max(1).sum(1) for at in range(0, len(flat), 4096)])
    for k in range(rounds):
        at, y = [], []
        for i, label in enumerate(labels):
            s, e = starts[i], starts[i + 1]
            at.append(s + int(np.argmax(now[s:e])))
            y.append(label)
            if not label:
                at.append(int(rng.integers(s, e)))
                y.append(0)
        at, y = np.array(at), np.array(y, np.float32)
        weight = np.where(y > 0, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6)).astype(np.float32)
        for _ in range(3):
            order = rng.permutation(len(at))
            for b in range(0, len(order), batch):
                pick, keep = order[b : b + batch], {}
                out = net.forward(inputs, flat[at[pick]], keep)
                net.step(net.backward(keep, (weight[pick] * (_sigmoid(out) - y[pick])).astype(np.float32) / len(pick)), rate / (1 + k), state)
        now = logits(net, inputs, flat)
    top = np.maximum.reduceat(now, starts[:-1]).astype(float)
    slope, shift, here = 1.0, 0.0, labels.mean()
    share = here if share is None else share
    for _ in range(2000):  # calibration of the largest logit, with the labels' shares of all labelled rows
        d = (_sigmoid(slope * top + shift) - labels) * np.where(labels, share / here, (1 - share) / (1 - here))
        slope, shift = max(0.05, slope - 0.05 * float((d * top).mean())), shift - 0.2 * float(d.mean())
    return Model(learn_odds(v, np.arange(len(texts)), labels), net, slope, shift)


def learn(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = 3000, longest: int = 20_000) -> Model:
    """Train on a bounded sample of the labelled rows whose crc32(id as text) mod 5 is not 0."""
    known = labels.where((F.col(label_col).isin(0, 1)) & (fold(F.col(id_col), 5) != 0)).select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).distinct()
    docs = df.where(F.col(text_col).isNotNull() & (F.length(text_col) <= longest)).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    steps = Steps(df.sparkSession, "toxicity")
    known = steps.keep("known", known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi"))  # ids and labels alone
    sizes = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    drawn = [known.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample // 2) for k in (0, 1)]
    few = drawn[0].union(drawn[1])  # at most `sample` rows, so it may be broadcast
    one = docs.join(F.broadcast(few), "doc_id").groupBy("doc_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    got = one.toPandas().sort_values(["doc_id", "text", "label"])
    return train(list(got["text"]), got["label"].to_numpy(), sizes.get(1, 0) / max(1, sum(sizes.values())))


def score_toxicity(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = 128) -> DataFrame:
    """Per row: doc_id, held_out, score and predicted."""
    model = df.sparkSession.sparkContext.broadcast(learn(df, labels, id_col, text_col, label_col))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for at in range(0, len(f), rows):
                part = f.iloc[at : at + rows]
                score = model.value.scores(list(part["text"]))
                yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64"), "held_out": part["held_out"], "score": score, "predicted": (score >= 0.5).astype(np.int32)})

    docs = df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].alias("text"), F.coalesce(fold(df[id_col], 5) == 0, F.lit(False)).alias("held_out"))
    return docs.mapInPandas(run, OUT)


def keep_civil(df: DataFrame, labels: DataFrame, text_col: str = "text", rows: int = 128) -> DataFrame:
    """The rows of ``df`` that are predicted 0, with all columns."""
    model = df.sparkSession.sparkContext.broadcast(learn(df, labels, text_col=text_col))

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(np.concatenate([model.value.scores(list(texts.iloc[at : at + rows])) for at in range(0, len(texts), rows)]))

    return df.where(score(df[text_col]) < 0.5)
