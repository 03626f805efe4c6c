"""Approximate nearest neighbours by stable projections and incremental search with a chi-square stopping test.

Vectors are brought to length 1 and projected onto a few Gaussian directions. A kd-tree over a bounded sample of the
projections cuts space into cells of about BLOCK_ROWS rows, and every row is dealt to its cell; a cell that holds more,
as many equal vectors do, is several blocks by a hash. Each block's projections are indexed by a kd-tree of its own. A
query visits leaves by their distance from its projection, and verifies points on the original vectors in the order of
projected distance. The squared ratio of projected to true distance is chi-square distributed, so the search stops once a
point nearer than the k-th best would, with probability ``sure``, have been met. Equal vectors of a block are indexed
once, with their smallest ids, so ties are exact. Repeated rows are dropped before they are dealt out, and an id on
several vectors of a block has one place among the k best.

A query is first searched in its own cell. What it finds there bounds its k-th distance, and it then visits only the
cells that the stopping test does not rule out at that distance; a query that finds fewer than k visits all. A query
streams by behind the rows of each block, so a task holds one block. Cosines are computed in double precision on the
original vectors.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components, and rows with a null id, take
no part; vectors meet those of their own dimension only; rows that repeat an id count once for a query, by their best
score, and never meet their own id; a query without candidates returns no row. Further columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.llm.common import Steps

DIRECTIONS, LEAF = 8, 256
BLOCK_ROWS = 8192
#: Cells follow the rows, one for about BLOCK_ROWS of them, up to MOST_CELLS over all dimensions; beyond that cells grow, in more
#: blocks, which are all searched. Their borders come from a sample of PER_CELL rows for each, of DIRECTIONS numbers each.
MOST_CELLS, PER_CELL = 1 << 17, 8
FOUND = "query_id bigint, vec_id bigint, score double"


def chi_square_below(x: float, m: int = DIRECTIONS) -> float:
    """Of an even number of degrees of freedom."""
    if x == math.inf:
        return 1.0
    term = total = 1.0
    for i in range(1, m // 2):
        term *= x / 2 / i
        total += term
    return 1.0 - math.exp(-x / 2) * total


def reach_of(kth: float, sure: float, m: int = DIRECTIONS) -> float:
    """The squared projected distance within which a point at the squared distance ``kth`` lies with probability ``sure``."""
    if kth == math.inf or sure >= 1.0:
        return math.inf
    low, high = 0.0, 1.0
    while chi_square_below(high, m) < sure:
        high *= 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square_below(middle, m) < sure else (low, middle)
    return high * kth


def directions(dim: int) -> np.ndarray:
    return np.random.default_rng(dim).standard_normal((dim, DIRECTIONS))


def lengths(a: np.ndarray) -> np.ndarray:
    return np.sqrt((a * a).sum(1))


def in_order(a: np.ndarray, b: np.ndarray) -> float:
    """The cosine of two vectors, with sums in the order of the components, as SQL has them."""
    ab = aa = bb = 0.0
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        ab, aa, bb = ab + x * y, aa + x * x, bb + y * y
    size = math.sqrt(aa) * math.sqrt(bb)
    return ab / size if 0 < size < math.inf else float((a / lengths(a[None])[0]) @ (b / lengths(b[None])[0]))


class Cells:
    """A kd-tree that cuts the projections of one dimension into cells; without points it is one cell."""

    def __init__(self, places: np.ndarray, cells: int):
        whole = (np.full(DIRECTIONS, -np.inf), np.full(DIRECTIONS, np.inf))
        self.axis, self.cut, self.next = [], [], []  # of inner nodes; a child is an inner node, or minus one less a cell
        boxes, todo = [], [(places, max(1, cells), whole, None)]
        while todo:
            x, wanted, (low, high), parent = todo.pop()
            axis = int(np.argmax(np.ptp(x, 0))) if len(x) > 1 else 0
            middle = float(np.median(x[:, axis])) if len(x) > 1 else 0.0
            left = x[:, axis] <= middle if len(x) > 1 else np.zeros(0, bool)
            if wanted > 1 and left.any() and not left.all():
                here = len(self.axis)
                self.axis.append(axis), self.cut.append(middle), self.next.append([0, 0])
                up, down = low.copy(), high.copy()
                up[axis], down[axis] = middle, middle
                todo += [(x[left], wanted // 2, (low, down), (here, 0)), (x[~left], wanted - wanted // 2, (up, high), (here, 1))]
            else:
                here = -1 - len(boxes)
                boxes.append((low, high))
            if parent:
                self.next[parent[0]][parent[1]] = here
        self.low, self.high = (np.array([b[k] for b in boxes]) for k in (0, 1))

    def __len__(self) -> int:
        return len(self.low)

    def of(self, places: np.ndarray) -> np.ndarray:
        """The cell of each place."""
        at = np.zeros(len(places), np.int64) if self.axis else np.full(len(places), -1)
        axis, cut, after = np.array(self.axis, int), np.array(self.cut), np.array(self.next).reshape(-1, 2)
        while (inner := np.flatnonzero(at >= 0)).size:
            node = at[inner]
            at[inner] = after[node, (places[inner, axis[node]] > cut[node]).astype(int)]
        return -1 - at

    def near(self, place: np.ndarray, kth: float, sure: float) -> np.ndarray:
        """The cells that can hold a point nearer than the squared distance ``kth``, as far as the test doesn't rule it out."""
        gap = np.maximum(0.0, np.maximum(self.low - place, place - self.high))
        return np.flatnonzero((gap * gap).sum(1) <= reach_of(kth, sure))


class Block:
    """Distinct vectors with the smallest ids of each, and a kd-tree over their projections."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], vectors[order]
        same: dict[bytes, list[int]] = {}
        for i, v in enumerate(vectors):
            group = same.setdefault(v.tobytes(), [])
            if len(group) <= k and not (group and ids[group[-1]] == ids[i]):  # one may be the query itself
                group.append(i)
        self.ids = [ids[g] for g in same.values()]
        self.label = np.array([x[0] for x in self.ids])
        held = np.concatenate(self.ids)
        self.repeats = len(np.unique(held)) < len(held)  # an id stands on several vectors
        self.vectors = vectors[[g[0] for g in same.values()]].astype(float)
        self.size = lengths(self.vectors)
        self.places = (self.vectors / self.size[:, None]) @ directions(vectors.shape[1])
        leaves, todo = [], [np.arange(len(self.places))]
        while todo:
            at = todo.pop()
            if len(at) <= LEAF:
                leaves.append(at)
                continue
            axis = int(np.argmax(np.ptp(self.places[at], 0)))
            at = at[np.argpartition(self.places[at, axis], len(at) // 2)]
            todo += [at[: len(at) // 2], at[len(at) // 2 :]]
        self.leaves = leaves
        self.at: dict[int, list[int]] = {}  # the rows of an id, made when a score is wanted
        self.verified = 0  # points compared on the original vectors, by all queries
        self.low, self.high = (np.array([f(self.places[x], 0) for x in leaves]) for f in (np.min, np.max))

    def cosine(self, i: int, query: np.ndarray, near: float) -> float:
        """The cosine of the query with the id's vector, summed in order; of several vectors the one at ``near``."""
        if not self.at:
            self.at = {x: [] for own in self.ids for x in own.tolist()}
            for row, own in enumerate(self.ids):
                for x in own.tolist():
                    self.at[x].append(row)
        return min((in_order(self.vectors[row], query) for row in self.at[i]), key=lambda c: abs(c - near))

    def reached(self, found: np.ndarray, at: np.ndarray, k: int) -> float:
        """The cost by which k + 1 different ids are met among the points at ``at``."""
        if not self.repeats:
            return np.partition(found, k)[k]
        order = np.argsort(found, kind="stable")
        _, first = np.unique(self.label[at[order]], return_index=True)
        return found[order[np.partition(first, k)[k]]] if len(first) > k else math.inf

    def search(self, query_id: int, query: np.ndarray, k: int, sure: float, within: float = math.inf) -> list[tuple[float, int]]:
        """The k best (minus cosine, id), as far as the stopping test lets it look; k are known within the squared distance ``within``."""
        q = query.astype(float)
        size = math.sqrt((q * q).sum())
        p = (q / size) @ directions(len(q))
        gap = np.maximum(0.0, np.maximum(self.low - p, p - self.high))
        bound = (gap * gap).sum(1)
        order = np.argsort(bound, kind="stable")
        waiting, far, best = np.empty(0, np.int64), np.empty(0), []
        most = within / 2 - 1 + 1e-12 if within < math.inf else math.inf  # as minus cosine
        for n, leaf in enumerate(order):
            at = self.leaves[leaf]
            d = self.places[at] - p
            waiting, far = np.concatenate([waiting, at]), np.concatenate([far, (d * d).sum(1)])
            reach = bound[order[n + 1]] if n + 1 < len(order) else math.inf
            ready = far <= reach
            if ready.any():
                now = waiting[ready]
                waiting, far = waiting[~ready], far[~ready]
                found = -(self.vectors[now] * q).sum(1) / (self.size[now] * size)
                self.verified += len(now)
                least = min(most, best[k - 1][0]) if len(best) >= k else most
                if len(found) > k + 1:  # no more than these, with ties, can be among the k best; one may be the query itself
                    least = min(least, self.reached(found, now, k))
                near = found <= least
                for c, i in zip(found[near].tolist(), now[near], strict=True):
                    best += [(c, x) for x in self.ids[i].tolist() if x != query_id]
                firsts: dict[int, float] = {}
                for c, x in sorted(best):
                    firsts.setdefault(x, c)
                best = [(c, x) for x, c in firsts.items()][:k]
            if (len(best) == k or within < math.inf) and reach < math.inf:
                kth = min(within, max(0.0, 2.0 + 2.0 * best[-1][0]) if len(best) == k else math.inf)
                if chi_square_below(reach / kth if kth > 1e-12 else math.inf) >= sure and reach > 0:
                    break
        return best


def _searched(k: int, sure: float):
    """Rows come sorted by (dim, cell, block, asked): a block's vectors, then the queries that meet it. One block is held at a time."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, ids, vectors, block = None, [], [], None
        for f in frames:
            found = []
            for dim, cell, number, asked, i, v, kth in zip(*(f[c] for c in ("dim", "cell", "block", "asked", "vec_id", "embedding", "kth")), strict=True):
                if here != (dim, cell, number):
                    here, ids, vectors, block = (dim, cell, number), [], [], None
                if not asked:
                    ids.append(int(i))
                    vectors.append(np.asarray(v, np.float64))
                elif ids:
                    if block is None:
                        block, vectors = Block(np.array(ids), np.stack(vectors), k), []
                    q = np.asarray(v, np.float64)
                    found += [(int(i), x, block.cosine(x, q, -c)) for c, x in block.search(int(i), q, k, sure, float(kth))]
            yield pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": float})

    return run


def _projected(part: pd.DataFrame) -> np.ndarray:
    v = np.stack([np.asarray(x, np.float64) for x in part["embedding"]])
    return (v / lengths(v)[:, None]) @ directions(v.shape[1])


def _celled(trees):
    """Add each row's cell."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            cell = np.zeros(len(f), np.int64)
            for dim in f["dim"].unique():
                at = np.flatnonzero(f["dim"].to_numpy() == dim)
                if int(dim) in trees.value:
                    cell[at] = trees.value[int(dim)].of(_projected(f.iloc[at]))
            yield f.assign(cell=cell)

    return run


def _routed(trees, sure: float):
    """The further cells that each query has to visit."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for at in range(len(f)):
                one = f.iloc[at : at + 1]
                tree = trees.value.get(int(one["dim"].iloc[0]))
                cells = tree.near(_projected(one)[0], float(one["kth"].iloc[0]), sure) if tree else np.zeros(0, int)
                cells = cells[cells != int(one["cell"].iloc[0])]
                if len(cells):
                    yield one.loc[one.index.repeat(len(cells))].assign(cell=cells)

    return run


def _trees(rows: DataFrame) -> dict[int, Cells]:
    """The cells of each dimension that has more than a block of rows, from a bounded sample of all rows by a hash of them.

    Rows are projected before they come to the driver: PER_CELL * MOST_CELLS short rows at most, but for chance.
    """
    large = rows.groupBy("dim").count().where(F.col("count") > BLOCK_ROWS).orderBy(F.desc("count"), "dim")
    sizes = {r["dim"]: r["count"] for r in large.limit(MOST_CELLS).collect()}
    wish = {dim: -(-n // BLOCK_ROWS) for dim, n in sizes.items()}
    part = min(1.0, MOST_CELLS / max(1, sum(wish.values())))
    cells = {dim: int(w * part) for dim, w in wish.items() if int(w * part) > 1}
    if not cells:
        return {}
    few = [(dim, int((1 << 30) * min(1.0, max(64, PER_CELL * k) / sizes[dim]))) for dim, k in cells.items()]
    few = F.broadcast(rows.sparkSession.createDataFrame(few, "dim int, share bigint"))  # at most half of MOST_CELLS rows
    drawn = rows.join(few, "dim").where(F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(1 << 30)) < F.col("share")).select("dim", "vec_id", "embedding")

    def project(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for _, own in f.groupby("dim"):
                yield pd.DataFrame({"dim": own["dim"], "vec_id": own["vec_id"], "p": list(_projected(own))})

    places = drawn.mapInPandas(project, "dim int, vec_id bigint, p array<double>").toPandas()
    return {int(dim): Cells(np.stack(own.sort_values("vec_id")["p"]), cells[int(dim)]) for dim, own in places.groupby("dim")}


def nearest(df: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, sure: float = 0.98) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for each query row, by cosine, ties to the smaller id."""
    kind = dict(df.dtypes)[vector_col]
    v = F.col(vector_col) if kind in ("array<float>", "array<double>") else F.col(vector_col).cast("array<double>")
    kind = kind if kind == "array<float>" else "array<double>"
    fit = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists(v, lambda x: x != 0)
    rows = df.where(F.col(id_col).isNotNull() & F.coalesce(fit, F.lit(False))).select(F.size(v).alias("dim"), F.col(id_col).cast("long").alias("vec_id"), v.alias("embedding"), F.coalesce(is_query, F.lit(False)).alias("q"))
    steps = Steps(df.sparkSession, "neighbours")
    rows = steps.keep("rows", rows.groupBy("dim", "vec_id", "embedding").agg(F.max("q").alias("q")))
    trees = df.sparkSession.sparkContext.broadcast(_trees(rows))
    placed = rows.mapInPandas(_celled(trees), f"dim int, vec_id bigint, embedding {kind}, q boolean, cell bigint")
    placed = steps.keep("placed", placed)
    steps.drop("rows")
    # a row for each cell: MOST_CELLS and one for each dimension at most
    blocks = steps.keep("blocks", placed.groupBy("dim", "cell").agg(F.ceil(F.count("*") / BLOCK_ROWS).alias("blocks")))
    held = placed.join(blocks, ["dim", "cell"]).select("dim", "cell", F.pmod(F.xxhash64("vec_id", "embedding"), "blocks").alias("block"), F.lit(False).alias("asked"), "vec_id", "embedding", F.lit(0.0).alias("kth"))

    def search(asked: DataFrame) -> DataFrame:
        """(query_id, vec_id, score) of queries (dim, cell, vec_id, embedding, kth) in all blocks of their cells."""
        number = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block")
        met = asked.join(blocks, ["dim", "cell"]).select("dim", "cell", number, F.lit(True).alias("asked"), "vec_id", "embedding", "kth")
        order = ["dim", "cell", "block"]
        found = held.union(met).repartition(*order).sortWithinPartitions(*order, "asked").mapInPandas(_searched(k, sure), FOUND)
        return found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))

    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    best = lambda found: found.withColumn("rank", rank).where(F.col("rank") <= k)
    asked = placed.where("q").select("dim", "cell", "vec_id", "embedding")
    own = steps.keep("own", best(search(asked.withColumn("kth", F.lit(float("inf"))))).select("query_id", "vec_id", "score"))
    if not any(len(t) > 1 for t in trees.value.values()):
        return best(own).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    # the squared distance of the k-th found: with lengths of 1, twice one less the cosine
    known = own.groupBy(F.col("query_id").alias("vec_id")).agg(F.when(F.count("*") >= k, F.greatest(2 - 2 * F.min("score"), F.lit(0.0))).alias("kth"))
    bound = asked.join(known, "vec_id", "left").select("dim", "cell", "vec_id", "embedding", F.coalesce("kth", F.lit(float("inf"))).alias("kth"))
    further = steps.keep("further", bound.mapInPandas(_routed(trees, sure), bound.schema))
    out = own.union(search(further)).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return best(out).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
