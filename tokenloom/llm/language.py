"""Language identification by error-correcting output codes.

Every language has a codeword; for each bit, a binary naive Bayes classifier over byte n-grams tells the languages with
that bit set from the others, and its mean log odds are calibrated to a value in (-1, 1). Loss-weighted decoding takes
the codeword of least loss, each bit weighted by how well its classifier does on that language; ``ambiguous`` tells that
another codeword is nearly as close.

Learning uses a bounded sample of labelled rows: at most ``sample`` texts, dealt evenly over the languages by a hash of
the id, one for each (id, language) drawn, of at most ``longest`` characters each. However often an id is repeated, the
driver gets one text of it. Every value of the label is learned, up to ``sample`` of them, those with the most ids: each needs a
text of its own in the sample. ``most`` may bound them further. Prediction reads every whole text.

Defined results: null texts and texts without a letter get ``und`` with score 0; with no label to learn from, so does
every text; with one language, every text with a letter gets it. A null id is predicted, neither learned from nor held
out. Repeated rows are judged each; further columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.llm.common import fold

GRAMS, HASH_BITS = (2, 3, 4), 16
OUT = "doc_id bigint, held_out boolean, lang_pred string, score double, ambiguous boolean"
#: All letters are among them, and some numbers, which ``str.isalpha`` tells apart.
_MAYBE_LETTER = re.compile(r"[^\W\d_]")
#: Bytes as the classifiers see them: ASCII letters lower-cased (texts come lower-cased), other ASCII as a space.
_SEEN = np.array([b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256)], np.uint8)


def has_letter(text: str) -> bool:
    return any(m[0].isalpha() for m in _MAYBE_LETTER.finditer(text))


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """(n, bits) of +1 and -1: all splits for few languages, else the best of some random codes."""
    if n < 2:
        return np.ones((n, 0))
    if n <= 6:
        splits = range(1, 1 << (n - 1))
        return np.array([[1.0 if s >> i & 1 else -1.0 for s in splits] for i in range(n)])
    rng, best, most = np.random.default_rng(seed), None, -1
    bits = int(np.ceil(10 * np.log2(n)))
    for _ in range(200 if n <= 256 else 10):
        code = rng.choice([-1.0, 1.0], (n, bits))
        code = code[:, np.abs(code.sum(0)) < n]
        apart = ((code.shape[1] - code @ code.T) / 2 + np.eye(n) * 10**6).min()  # bits in which they differ
        if apart > most:
            best, most = code, apart
    return best


def grams(raw: np.ndarray) -> list[np.ndarray]:
    """Hashes of the byte n-grams that begin at each place."""
    out = []
    for n in GRAMS:
        if len(raw) >= n:
            h = np.full(len(raw) - n + 1, n, np.uint32)
            for j in range(n):
                h = (h ^ raw[j : len(raw) - n + 1 + j]) * np.uint32(0x9E3779B1)
                h ^= h >> np.uint32(15)
            out.append(h & np.uint32((1 << HASH_BITS) - 1))
        else:
            out.append(np.empty(0, np.uint32))
    return out


def raw_bytes(text: str) -> np.ndarray:
    return _SEEN[np.frombuffer(f" {text.lower()} ".encode("utf-8", "replace"), np.uint8)]


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    table: np.ndarray  # (hashes, bits): log odds of each n-gram
    scale: np.ndarray
    shift: np.ndarray
    weights: np.ndarray  # (languages, bits)

    def margins(self, text: str, part: int = 1 << 18) -> np.ndarray:
        """Mean log odds of each bit over all n-grams of the whole text."""
        raw, total, n = raw_bytes(text), np.zeros(self.table.shape[1]), 0
        over = max(GRAMS) - 1
        for at in range(0, max(1, len(raw) - over), part):
            piece = raw[at : at + part + over]
            for size, h in zip(GRAMS, grams(piece), strict=True):
                h = h[: max(0, min(part, len(raw) - size + 1 - at))] if at + part < len(raw) - over else h
                total += self.table[h].sum(0, dtype=np.float64)
                n += len(h)
        return total / max(n, 1)

    def predict(self, text: str | None, margin: float = 0.1) -> tuple[str, float, bool]:
        if not self.languages or text is None or not has_letter(text):
            return "und", 0.0, False
        if len(self.languages) == 1:
            return self.languages[0], 1.0, False
        f = np.tanh(self.scale * self.margins(text) + self.shift)
        loss = (self.weights * np.exp(-self.code * f)).sum(1)
        order = np.argsort(loss, kind="stable")
        odds = np.exp(-8.0 * (loss - loss[order[0]]))
        return self.languages[order[0]], float(1.0 / odds.sum()), bool(loss[order[1]] - loss[order[0]] < margin)


def train(texts: list[str], labels: list[str]) -> Model:
    languages = sorted(set(labels))
    code = codewords(len(languages))
    size = 1 << HASH_BITS
    docs = [np.concatenate(grams(raw_bytes(t))) for t in texts]
    place = {x: k for k, x in enumerate(languages)}
    which = np.array([place[x] for x in labels], int)
    texts_of = np.bincount(which, minlength=len(languages))
    sums = np.full((2, code.shape[1], size), 1e-7)  # of both sides of each bit: as wide as the code, not as the languages
    for h, k in zip(docs, which, strict=True):
        own = np.bincount(h, minlength=size) / (max(1, len(h)) * texts_of[k])  # each text of a language counts alike, and each language
        for b, bit in enumerate(code[k]):
            sums[int(bit < 0), b] += own / max(1, (code[:, b] == bit).sum())
    sums = np.log(sums / sums.sum(2, keepdims=True))
    table = (sums[0] - sums[1]).T.astype(np.float32)
    model = Model(languages, code, table, np.ones(code.shape[1]), np.zeros(code.shape[1]), np.ones(code.shape))
    if len(languages) > 1:
        m = np.array([table[h].mean(0, dtype=np.float64) if len(h) else np.zeros(code.shape[1]) for h in docs])
        target = code[which]
        for b in range(code.shape[1]):  # the middle of the two sides becomes 0, half their distance becomes 1
            yes, no = m[target[:, b] > 0, b].mean(), m[target[:, b] < 0, b].mean()
            model.scale[b] = 2.0 / max(yes - no, 1e-6)
            model.shift[b] = -model.scale[b] * (yes + no) / 2
        right = (np.tanh(model.scale * m + model.shift) * target) > 0
        seen = np.array([right[which == k].mean(0) for k in range(len(languages))])
        model.weights = (seen + 1e-6) / (seen + 1e-6).sum(1, keepdims=True)
    return model


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = 3000, longest: int = 20_000, most: int | None = None) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score, ambiguous; learned where crc32(id as text) mod 4 is not 2."""
    spark = df.sparkSession
    part = fold(df[id_col], 4)
    docs = df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].alias("text"), df[lang_col].alias("lang"), F.coalesce(part == 2, F.lit(False)).alias("held_out"), part.isNotNull().alias("named"))
    labelled = docs.where(F.col("named") & ~F.col("held_out") & F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") <= longest))
    counted = labelled.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("ids")).orderBy(F.desc("ids"), "lang")
    sizes = {r["lang"]: r["ids"] for r in counted.limit(min(sample, most or sample)).collect()}
    each = max(1, sample // max(1, len(sizes)))
    wish = [(x, min(1.0, max(2.0 * each, 100.0) / n)) for x, n in sizes.items()]  # twice what is wanted, so that what is then counted is small
    share = F.broadcast(spark.createDataFrame(wish, "lang string, share double"))  # at most ``sample`` rows
    drawn = labelled.join(share, "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < F.col("share") * 1_000_003)
    one = drawn.groupBy("doc_id", "lang").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    got = one.withColumn("rank", rank).where(F.col("rank") <= each).select("doc_id", "text", "lang").toPandas().sort_values(["doc_id", "text", "lang"])
    model = spark.sparkContext.broadcast(train(list(got["text"]), list(got["lang"])))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(i, h, *model.value.predict(t)) for i, h, t in zip(f["doc_id"], f["held_out"], f["text"], strict=True)]
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in OUT.split(", ")])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    return docs.select("doc_id", "text", "held_out").mapInPandas(run, OUT)
