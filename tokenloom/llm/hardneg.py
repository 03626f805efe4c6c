"""Hard negatives by inner product over a pivot table.

Components become whole numbers, so scores are exact. Each row y gets one more component, sqrt(M^2 - |y|^2), with M the
largest length of its dimension, and an anchor a gets a zero: then |a - y|^2 = |a|^2 + M^2 - 2 a.y, and a large inner product
is a small Euclidean distance. The table stores each row's distances to a few pivots, chosen far from one another from a
bounded sample. By the triangle inequality those and the anchor's own distances to the pivots bracket each score; only rows
whose bracket reaches what is wanted are checked exactly.

Rows are dealt to blocks by ranges of (label, nearest pivot, distance to it), so a hot label or a group of copies is many
blocks. Of each block the range of its labels and of its distances to each pivot is known. An anchor first visits the blocks
that can hold its label, for its positives; then those that can hold another label and whose bracket meets the scores that
its positives ask for. A task holds one block and streams its anchors by; it returns no more than the wanted number of rows
for an anchor and positive. What routes the anchors is a row for each block, or for each run of blocks beyond MOST_BLOCKS.

Defined results: rows with a null id or label, and vectors that are null, empty or hold null or non-finite components, take
no part; a zero vector does; so does none whose score with itself would leave the range of a long (2^62). Labels are compared
as text, vectors within their dimension. Fully equal rows count once. An id on several vectors is several rows, each an
anchor of its own, which are never positives or negatives of one another. Anchors without positives, and positives without
negatives, return no row; so do positives of a negative score, whose range of scores is empty. An empty table gives no rows.
Further columns are not read.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.llm.common import Steps, fit_vector

PIVOTS, SAMPLE_ROWS = 16, 4096
#: Components of a block, of all pivots (dimensions beyond it, the rarest, have no pivots: all their rows are checked), and rows that route anchors.
BLOCK_VALUES, PIVOT_VALUES, MOST_BLOCKS = 1 << 20, 1 << 21, 1 << 15
LONGEST = float(1 << 62)


def augmented(v: np.ndarray, m2: float) -> np.ndarray:
    v = v.astype(float)
    return np.concatenate([v, np.sqrt(np.maximum(0.0, m2 - (v * v).sum(1)))[:, None]], axis=1)


def choose_pivots(points: np.ndarray, most: int = PIVOTS) -> np.ndarray:
    """Far from one another: each the point furthest from those before it."""
    chosen, near = [0], np.linalg.norm(points - points[0], axis=1)
    while len(chosen) < most and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, np.linalg.norm(points - points[chosen[-1]], axis=1))
    return points[chosen]


def to_pivots(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.stack([np.linalg.norm(points - p, axis=1) for p in pivots], axis=1)


def scores(v: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of v with a: doubles hold whole numbers below 2^53, and so all sums on the way."""
    if math.sqrt(float((v.astype(float) ** 2).sum(1).max(initial=0.0)) * float((a.astype(float) ** 2).sum())) < 1 << 52:
        return (v.astype(float) @ a.astype(float)).astype(np.int64)
    return (v.astype(np.int64) * a.astype(np.int64)).sum(1)


def brackets(base: float, near: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lowest, highest) score for distances of at most ``far`` and at least ``near``; base is |a|^2 + M^2."""
    slack = 1.0 + 1e-9 * base
    return (base - far * far) / 2 - slack, (base - near * near) / 2 + slack


class Block:
    """Rows of one dimension with their distances to the pivots."""

    def __init__(self, ids, labels, vectors, away, m2: float | None):
        self.ids, self.labels = np.array(ids, np.int64), np.array(labels, object)
        self.vectors, self.m2 = np.stack(vectors), m2
        self.whole = self.vectors.astype(float)
        self.exact = float((self.whole**2).sum(1).max())
        self.away = np.stack(away) if m2 is not None else None
        self.checked = 0  # rows whose score was computed

    def bracket(self, a: np.ndarray, away: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.m2 is None:
            return np.full(len(at), -np.inf), np.full(len(at), np.inf)
        d, own = self.away[at], away[None, :]
        return brackets(float((a.astype(float) ** 2).sum()) + self.m2, np.abs(d - own).max(1), (d + own).min(1))

    def score(self, a: np.ndarray, at: np.ndarray) -> np.ndarray:
        self.checked += len(at)
        if math.sqrt(self.exact * float((a.astype(float) ** 2).sum())) < 1 << 52:
            return (self.whole[at] @ a.astype(float)).astype(np.int64)
        return scores(self.vectors[at], a)

    def first(self, ids: np.ndarray, s: np.ndarray, k: int) -> np.ndarray:
        return np.lexsort((ids, -s))[:k]

    def positives(self, i: int, label: str, a: np.ndarray, away: np.ndarray, k: int) -> list[tuple[int, int]]:
        """The k best (id, score) of the label; rows are checked in the order of their highest possible score."""
        at = np.flatnonzero((self.labels == label) & (self.ids != i))
        _, high = self.bracket(a, away, at)
        order = np.argsort(-high, kind="stable")
        at, high, ids, s, begin = at[order], high[order], np.empty(0, np.int64), np.empty(0, np.int64), 0
        while begin < len(at) and not (len(s) == k and high[begin] < s[-1]):
            part = at[begin : begin + 64]
            ids, s = np.concatenate([ids, self.ids[part]]), np.concatenate([s, self.score(a, part)])
            best = self.first(ids, s, k)
            ids, s, begin = ids[best], s[best], begin + len(part)
        return list(zip(ids.tolist(), s.tolist(), strict=True))

    def negatives(self, i: int, label: str, a: np.ndarray, away: np.ndarray, wanted: list[tuple[int, int, int]], k: int) -> list[tuple[int, int, int]]:
        """For each (p, lowest, highest) of scores: the k best (p, id, score) of other labels in that range."""
        at = np.flatnonzero((self.labels != label) & (self.ids != i))
        low, high = self.bracket(a, away, at)
        held = []
        for _, least, most in wanted:
            can = (high >= least) & (low <= most)
            if (sure := low[(low >= least) & (high <= most)]).size > k:  # k rows at or above that are in the range
                can &= high >= np.partition(sure, len(sure) - k)[len(sure) - k]
            held.append(can)
        any_of = np.flatnonzero(np.any(held, axis=0)) if held else np.empty(0, np.int64)
        ids, s, out = self.ids[at[any_of]], self.score(a, at[any_of]), []
        for p, least, most in wanted:
            fits = np.flatnonzero((s >= least) & (s <= most))
            best = fits[self.first(ids[fits], s[fits], k)]
            out += [(p, x, y) for x, y in zip(ids[best].tolist(), s[best].tolist(), strict=True)]
        return out


def _tabled(pivots):
    """Add each row's distances to the pivots, the nearest one and its distance."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            away, near, far = np.empty(len(f), object), np.zeros(len(f), np.int32), np.zeros(len(f))
            for dim, at in f.groupby("dim").indices.items():
                m2, p = pivots.value.get(int(dim), (None, None))
                if m2 is None:
                    away[at] = [[] for _ in at]
                    continue
                d = to_pivots(augmented(np.stack(list(f["v"].iloc[at])), m2), p)
                near[at], far[at] = d.argmin(1), d.min(1)
                away[at] = [x.tolist() for x in d]
            yield f.assign(away=away, near=near, far=far)

    return run


def _anchored(pivots):
    """Add an anchor's distances to the pivots; its further component is zero."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            away = []
            for dim, v in zip(f["dim"], f["v"], strict=True):
                m2, p = pivots.value.get(int(dim), (None, None))
                away.append([] if m2 is None else to_pivots(np.append(np.asarray(v, float), 0.0)[None, :], p)[0].tolist())
            yield f.assign(away=away)

    return run


class Routes:
    """The runs of blocks of one dimension: their labels' range and their distances to the pivots."""

    def __init__(self, rows: list, m2: float | None):
        self.first, self.last = np.array([r["first"] for r in rows]), np.array([r["last"] for r in rows])
        self.bounds = sorted({r[c] for r in rows for c in ("low_label", "high_label")})
        code = {x: 2 * i for i, x in enumerate(self.bounds)}
        self.low, self.high, self.m2 = np.array([code[r["low_label"]] for r in rows]), np.array([code[r["high_label"]] for r in rows]), m2
        self.near, self.far = (np.array([r[c] for r in rows], float) for c in ("near", "far"))

    def of(self, label: str) -> int:
        i = bisect_left(self.bounds, label)
        return 2 * i if i < len(self.bounds) and self.bounds[i] == label else 2 * i - 1

    def blocks(self, at: np.ndarray) -> np.ndarray:
        return np.concatenate([np.arange(self.first[i], self.last[i] + 1) for i in at]) if len(at) else np.empty(0, np.int64)

    def same_label(self, label: str) -> np.ndarray:
        c = self.of(label)
        return self.blocks(np.flatnonzero((self.low <= c) & (c <= self.high)))

    def others(self, label: str, a: np.ndarray, away: np.ndarray, least: int, most: int) -> np.ndarray:
        c = self.of(label)
        wanted = (self.low != c) | (self.high != c)
        if self.m2 is not None:
            gap = np.maximum(0.0, np.maximum(self.near - away, away - self.far)).max(1)
            low, high = brackets(float((a.astype(float) ** 2).sum()) + self.m2, gap, (self.far + away).min(1))
            wanted &= (high >= least) & (low <= most)
        return self.blocks(np.flatnonzero(wanted))


def ranges(positives, low: int, high: int) -> list[tuple[int, int, int]]:
    """(p, lowest, highest) score of a negative with low * positive <= 100 * negative <= high * positive."""
    out = [(int(p["p"]), -((-low * int(p["score"])) // 100), high * int(p["score"]) // 100) for p in positives]
    return [x for x in out if x[1] <= x[2]]


def _routed(routes, low: int, high: int):
    """A row of an anchor for each block it visits: for its positives, or if it has them, for its negatives."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for at in range(len(f)):
                one = f.iloc[at : at + 1]
                row = one.iloc[0]
                if (r := routes.value.get(int(row["dim"]))) is None:
                    continue
                if row["positives"] is None:
                    blocks = r.same_label(row["label"])
                elif wanted := ranges(row["positives"], low, high):
                    blocks = r.others(row["label"], np.asarray(row["v"]), np.asarray(row["away"], float), min(x[1] for x in wanted), max(x[2] for x in wanted))
                else:
                    continue
                if len(blocks):
                    yield one.loc[one.index.repeat(len(blocks))].assign(block=blocks)

    return run


MET = "anchor_id bigint, ah bigint, p int, vec_id bigint, score bigint"


def _searched(pivots, k_positives: int, k_negatives: int, low: int, high: int):
    """Rows come sorted by (dim, block, asked): a block's rows, then its anchors. One block is held at a time."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, held, block = None, [], None
        for f in frames:
            found = []
            for dim, number, asked, i, ah, label, v, away, positives in zip(*(f[c] for c in ("dim", "block", "asked", "vec_id", "h", "label", "v", "away", "positives")), strict=True):
                if here != (dim, number):
                    here, held, block = (dim, number), [], None
                v, away = np.asarray(v, np.int64), np.asarray(away, float)
                if not asked:
                    held.append((int(i), label, v, away))
                    continue
                if block is None:
                    if not held:
                        continue
                    block, held = Block(*zip(*held, strict=True), pivots.value.get(int(dim), (None,))[0]), []
                if positives is None:
                    found += [(i, ah, 0, x, s) for x, s in block.positives(int(i), label, v, away, k_positives)]
                else:
                    found += [(i, ah, p, x, s) for p, x, s in block.negatives(int(i), label, v, away, ranges(positives, low, high), k_negatives)]
            yield pd.DataFrame(found, columns=["anchor_id", "ah", "p", "vec_id", "score"]).astype({"anchor_id": "int64", "ah": "int64", "p": "int32", "vec_id": "int64", "score": "int64"})

    return run


def _pivots(rows: DataFrame) -> dict[int, tuple[float, np.ndarray]]:
    """dim: (M^2, pivots), of the most frequent dimensions, from a bounded sample of the rows by a hash of them."""
    sizes = rows.groupBy("dim").agg(F.count("*").alias("n"), F.max("sq").alias("m2")).orderBy(F.desc("n"), "dim").limit(4096).collect()
    kept, room = {}, PIVOT_VALUES
    for r in sizes:
        room -= PIVOTS * (r["dim"] + 1)
        if room >= 0:
            kept[r["dim"]] = (float(r["m2"]), r["n"])
    if not kept:
        return {}
    few = [(d, int((1 << 30) * min(1.0, max(4 * PIVOTS, min(SAMPLE_ROWS, PIVOT_VALUES // len(kept) // (d + 1))) / n))) for d, (_, n) in kept.items()]
    few = F.broadcast(rows.sparkSession.createDataFrame(few, "dim int, share bigint"))  # at most 4,096 rows
    sample = rows.join(few, "dim").where(F.pmod(F.col("h"), F.lit(1 << 30)) < F.col("share")).select("dim", "vec_id", "h", "v").toPandas()
    out = {}
    for dim, own in sample.sort_values(["h", "vec_id"]).groupby("dim"):
        m2 = kept[int(dim)][0]
        out[int(dim)] = (m2, choose_pivots(augmented(np.stack(list(own["v"])), m2)))
    return out


def whole_numbers(v: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component, as doubles, which hold it exactly if it is below 2^53."""
    return F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("double"))


def hard_negatives(
    df: DataFrame, is_anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: the best negatives for each anchor and each of its
    best positives, of those with low * positive_score <= 100 * negative_score <= high * positive_score.
    """
    spark, steps = df.sparkSession, Steps(df.sparkSession, "hardneg")
    vector, fit = fit_vector(df, vector_col, zero=True)
    rows = df.where(fit & F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), whole_numbers(vector, scale).alias("w"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    rows = rows.withColumn("sq", F.aggregate("w", F.lit(0.0), lambda a, x: a + x * x)).where(F.col("sq") < LONGEST)
    rows = rows.select(F.size("w").alias("dim"), "vec_id", "label", F.col("w").cast("array<bigint>").alias("v"), "anchor", "sq")
    rows = rows.withColumn("h", F.xxhash64("label", "v"))
    found_pivots = _pivots(rows)
    pivots = spark.sparkContext.broadcast(found_pivots)

    kind = "dim int, vec_id bigint, label string, v array<bigint>, anchor boolean, h bigint, away array<double>, near int, far double"
    tabled = rows.select("dim", "vec_id", "label", "v", "anchor", "h").mapInPandas(_tabled(pivots), kind)
    values = rows.agg(F.sum(F.col("dim").cast("long"))).first()[0] or 0
    order = ["dim", "label", "near", "far", "vec_id", "h"]
    dealt = tabled.repartitionByRange(max(1, -(-values // BLOCK_VALUES)), *order)
    dealt = dealt.groupBy(*order).agg(*(F.any_value(c).alias(c) for c in ("v", "away")), F.max("anchor").alias("anchor"))  # follows the ranges
    table = steps.keep("table", dealt.withColumn("block", F.spark_partition_id().cast("long")).select("dim", "block", "vec_id", "label", "v", "anchor", "h", "away"))

    span = -(-((table.agg(F.max("block")).first()[0] or 0) + 1) // MOST_BLOCKS)
    pivot_of = lambda f: F.array(*(f(F.get("away", F.lit(i))) for i in range(PIVOTS)))
    known = table.groupBy("dim", F.floor(F.col("block") / span).alias("run")).agg(
        F.min("block").alias("first"), F.max("block").alias("last"), F.min("label").alias("low_label"), F.max("label").alias("high_label"), pivot_of(F.min).alias("near"), pivot_of(F.max).alias("far")
    )  # a row for each dimension and run of blocks
    by_dim: dict[int, list] = {}
    for r in known.collect():
        n = len(found_pivots[r["dim"]][1]) if r["dim"] in found_pivots else 0
        by_dim.setdefault(r["dim"], []).append(r.asDict() | {"near": r["near"][:n], "far": r["far"][:n]})
    routes = spark.sparkContext.broadcast({d: Routes(rs, found_pivots.get(d, (None,))[0]) for d, rs in by_dim.items()})

    pairs = "array<struct<p:int,vec_id:bigint,score:bigint>>"
    layout = ["dim", "block", "asked", "vec_id", "h", "label", "v", "away", "positives"]
    asks = f"dim int, vec_id bigint, h bigint, label string, v array<bigint>, away array<double>, positives {pairs}"
    held = table.withColumn("asked", F.lit(False)).withColumn("positives", F.lit(None).cast(pairs)).select(layout)

    def search(asked: DataFrame) -> DataFrame:
        met = asked.mapInPandas(_routed(routes, low, high), f"{asks}, block bigint").withColumn("asked", F.lit(True)).select(layout)
        both = held.union(met).repartition("dim", "block").sortWithinPartitions("dim", "block", "asked")
        return both.mapInPandas(_searched(pivots, positives, negatives, low, high), MET)

    anchors = table.where("anchor").select("dim", "vec_id", "h", "label", "v").mapInPandas(_anchored(pivots), "dim int, vec_id bigint, h bigint, label string, v array<bigint>, away array<double>")
    rank = lambda keys: F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id"))
    best = search(anchors.withColumn("positives", F.lit(None).cast(pairs))).withColumn("p", rank(["anchor_id", "ah"])).where(F.col("p") <= positives)
    best = steps.keep("positives", best)
    each = best.groupBy("anchor_id", "ah").agg(F.sort_array(F.collect_list(F.struct("p", "vec_id", "score"))).alias("positives"))  # as many as asked for at most
    asking = anchors.join(each.withColumnsRenamed({"anchor_id": "vec_id", "ah": "h"}), ["vec_id", "h"]).select("dim", "vec_id", "h", "label", "v", "away", "positives")
    mined = search(asking).withColumn("rank", rank(["anchor_id", "ah", "p"])).where(F.col("rank") <= negatives)
    mined = mined.withColumnsRenamed({"vec_id": "negative_id", "score": "negative_score"})
    known = best.withColumnsRenamed({"vec_id": "positive_id", "score": "positive_score"})
    return mined.join(known, ["anchor_id", "ah", "p"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
