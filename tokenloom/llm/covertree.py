"""Embedding near-duplicates: every pair of one label at a cosine of ``least`` or more, by dual traversal of cover trees.

Vectors of length 1 lie apart by sqrt(2 - 2 cosine), so the pairs wanted are those within a radius. A cover tree holds them
in nested levels: the children of a node are points of it more than half its radius apart, its own center first, and each
covers the points nearest to it. Two nodes are compared by the distance of their centers and their covering radii: pairs
that lie apart by more are pruned whole; pairs that lie within the radius whole are linked whole, by the sizes of the nodes;
other pairs go on with their children, down to single points, which are decided by their cosine on the original vectors.

Equal vectors of a label are one point with a weight. On the cluster, a label with more rows than a cell gets the upper
levels of its tree from a bounded sample; all its rows are dealt to the nearest center of their lowest level, and covering
radii are counted over all rows. A row meets the rows of its own cell, and visits each cell before it in order that neither
the covering radius nor the plane midway between both centers rules out, so each pair meets once. A cell whose radius links
all its rows is linked from its sizes alone, without a comparison: a hot group of copies costs as many rows as it has. Other
cells with too many rows are cut into blocks, of which each row visits those before its own. A task holds the rows of one
block and streams visitors by in parts.

Links are counted, not listed: a task returns for each row it links their number and one row of the same component, and
components are joined from those.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components, and rows with a null label, link
with nothing; so do rows with a null id, whose component is null and which are kept. Vectors link within their label, as
text, and their dimension. Rows that repeat id, label and vector count as one vector and get the same result each; an id on
several vectors counts as several, each with its own result. An empty table gives no rows. Further columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.llm.common import Steps, fit_vector
from tokenloom.llm.components import components

#: Components that a cell's vectors, and those of the samples of all labels, should not exceed. Labels that get a tree.
CELL_VALUES, SAMPLE_VALUES, MOST_TREES = 1 << 18, 1 << 21, 4096
#: Distances are exact to this; bounds give way by it, and cosines this near to ``least`` are computed anew.
SLACK, NEAR = 1e-7, 1e-9
PART, VISITORS = 512, 2048
FOUND = "node bigint, links bigint, root bigint"


def cell_rows(dim: int) -> int:
    return max(64, CELL_VALUES // dim)


def radius_of(least: float) -> float:
    return math.sqrt(max(0.0, 2.0 - 2.0 * least))


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of unit vectors."""
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (a @ b.T)))


class Node:
    """Points ``at`` (rows of the tree's array) within ``radius`` of the row ``center``; its children are made when asked for."""

    __slots__ = ("at", "center", "children", "radius")

    def __init__(self, at: np.ndarray, center: int, radius: float):
        self.at, self.center, self.radius, self.children = at, center, radius, None


def cover(x: np.ndarray, node: Node) -> list[Node]:
    """The children: centers more than half the radius apart, each with the points that are nearest to it."""
    if node.radius <= SLACK:
        return [Node(node.at[i : i + 1], int(node.at[i]), 0.0) for i in range(len(node.at))]
    at, half = node.at, node.radius / 2
    chosen, near, own = [node.center], apart(x[at], x[[node.center]])[:, 0], np.zeros(len(at), np.int64)
    while (far := np.flatnonzero(near > half)).size:
        part = far[:PART]
        close, new, covered = apart(x[at[part]], x[at[part]]) <= half, [], np.zeros(len(part), bool)
        for k in range(len(part)):
            if not covered[k]:
                new.append(part[k])
                covered |= close[k]
        for begin in range(0, len(at), 8 * PART):
            rows = slice(begin, begin + 8 * PART)
            d = apart(x[at[rows]], x[at[new]])
            first = d.argmin(1)
            least = d[np.arange(len(d)), first]
            better = least < near[rows]
            near[rows][better], own[rows][better] = least[better], len(chosen) + first[better]
        near[new] = 0.0  # rounding may leave a center nearer to another by less than its own distance to itself
        own[new] = len(chosen) + np.arange(len(new))
        chosen += at[new].tolist()
    order = np.argsort(own, kind="stable")
    cuts = np.searchsorted(own[order], np.arange(len(chosen) + 1))
    return [Node(at[order[a:b]], c, float(near[order[a:b]].max()) if b - a > 1 else 0.0) for c, a, b in zip(chosen, cuts[:-1], cuts[1:], strict=True) if b > a]


def tree(x: np.ndarray, first: int = 0) -> Node:
    """The root over the rows of x from ``first`` on."""
    at = np.arange(first, len(x))
    return Node(at, first, float(apart(x[at], x[[first]]).max()) if len(at) > 1 else 0.0)


class Links:
    """For each point the weight it is linked with, and a point of its component, the smallest in the end."""

    def __init__(self, n: int):
        self.weight, self.root = np.zeros(n, np.int64), np.arange(n)

    def join(self, u: np.ndarray, v: np.ndarray) -> None:
        while True:
            a, b = self.root[u], self.root[v]
            new = a != b
            if not new.any():
                return
            u, v = u[new], v[new]
            np.minimum.at(self.root, np.maximum(a, b)[new], np.minimum(a, b)[new])
            while not np.array_equal(up := self.root[self.root], self.root):
                self.root = up


def dual(x: np.ndarray, original: np.ndarray, weight: np.ndarray, a: Node, b: Node, least: float, links: Links) -> int:
    """Link the pairs of the points of two nodes, or of one with itself; returns how many distances were computed."""
    t, todo, tried = radius_of(least), [] if a is b and len(a.at) == 1 else [(a, b)], 0

    def below(node: Node, other: Node) -> list[Node]:
        if len(node.at) == 1 or node.radius < other.radius / 2:
            return [node]
        if node.children is None:
            node.children = cover(x, node)
        return node.children

    def arrays(nodes: list[Node]) -> tuple[np.ndarray, ...]:
        return np.array([n.center for n in nodes]), np.array([n.radius for n in nodes]), np.array([len(n.at) for n in nodes]), np.array([weight[n.at].sum() for n in nodes])

    def bulk(nodes: list[Node], counted: np.ndarray, added: np.ndarray, others: np.ndarray) -> None:
        """Add to the points below each node; join those to a point of a node that they are linked with."""
        one = counted == 1
        at = np.array([n.center for n in nodes])
        np.add.at(links.weight, at[one], added[one])
        for i in np.flatnonzero(~one & (others >= 0)):
            links.weight[nodes[i].at] += added[i]
            links.join(nodes[i].at, np.full(len(nodes[i].at), others[i]))

    while todo:
        a, b = todo.pop()
        self_pair = a is b
        if self_pair and 2 * a.radius <= t - SLACK:
            links.weight[a.at] += weight[a.at].sum() - weight[a.at]
            links.join(a.at, np.full(len(a.at), a.center))
            continue
        left = below(a, b)
        right = left if self_pair else below(b, a)
        (ac, ar, an, aw), (bc, br, bn, bw) = arrays(left), arrays(right)
        if self_pair:
            todo += [(n, n) for n in left if len(n.at) > 1]
        for begin in range(0, len(left), PART):
            rows = slice(begin, begin + PART)
            c = x[ac[rows]] @ x[bc].T
            wanted = np.arange(len(right))[None, :] > np.arange(begin, begin + len(c))[:, None] if self_pair else np.ones(c.shape, bool)
            tried += int(wanted.sum())
            d, reach = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * c)), ar[rows][:, None] + br[None, :]
            single = (an[rows][:, None] == 1) & (bn[None, :] == 1)
            linked = wanted & np.where(single, c >= least, d + reach <= t - SLACK)
            for i, j in np.argwhere(wanted & single & (np.abs(c - least) < NEAR)):
                linked[i, j] = cosine(original[ac[begin + i]], original[bc[j]]) >= least
            for i, j in np.argwhere(wanted & ~single & ~linked & (d - reach <= t + SLACK)):
                todo.append((left[begin + i], right[j]))
            if linked.any():
                i, j = np.nonzero(linked)
                links.join(ac[rows][i], bc[j])
                met_a, met_b = np.full(len(c), -1), np.full(len(right), -1)
                met_a[i], met_b[j] = bc[j], ac[rows][i]
                bulk(left[rows], an[rows], linked @ bw, met_a)
                bulk(right, bn, aw[rows] @ linked, met_b)
    return tried


def cosine(a: np.ndarray, b: np.ndarray) -> float:
    """In double precision, summed in order."""
    ab = aa = bb = 0.0
    for p, q in zip(a.tolist(), b.tolist(), strict=True):
        ab, aa, bb = ab + p * q, aa + p * p, bb + q * q
    return ab / (math.sqrt(aa) * math.sqrt(bb))


def unit(v: np.ndarray) -> np.ndarray:
    """Of length 1, also where squares would leave the range of doubles."""
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def _linked(least: float):
    """Rows come sorted by (grp, dim, cell, block, visit): a block's rows, then its visitors."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, block, rows, guests = None, None, [], []

        def out(nodes: np.ndarray, weight: np.ndarray, root: np.ndarray) -> pd.DataFrame:
            keep = weight > 0
            return pd.DataFrame({"node": nodes[keep], "links": weight[keep], "root": root[keep]})

        def opened():
            nodes, w, v = np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), np.stack([r[2] for r in rows])
            x, links = unit(v), Links(len(rows))
            root = tree(x)
            if not rows[0][3]:  # else all its rows are linked from its sizes
                dual(x, v, w, root, root, least, links)
            return nodes, w, v, x, links, root

        def visited(block) -> pd.DataFrame:
            nodes, w, v, x, links, root = block
            more, n = np.stack([g[2] for g in guests]), len(nodes)
            both = Links(n + len(guests))
            both.weight[:n], both.root[:n] = links.weight, links.root
            x2, w2 = np.concatenate([x, unit(more)]), np.concatenate([w, [g[1] for g in guests]])
            dual(x2, np.concatenate([v, more]), w2, root, tree(x2, n), least, both)
            links.weight, links.root = both.weight[:n], both.root[:n]
            met = both.root[n:] < n  # a visitor's component begins with a row of the block, if it is linked here
            return out(np.array([g[0] for g in guests])[met], both.weight[n:][met], nodes[both.root[n:][met]])

        def done(block):
            nodes, links = block[0], block[4]
            return out(nodes, links.weight, nodes[links.root])

        for f in frames:
            for grp, dim, cell, number, visit, tight, node, w, v in zip(*(f[c] for c in ("grp", "dim", "cell", "block", "visit", "tight", "node", "w", "embedding")), strict=True):
                if here != (grp, dim, cell, number):
                    if guests and block:
                        yield visited(block)
                    if block or rows:
                        yield done(block or opened())
                    here, block, rows, guests = (grp, dim, cell, number), None, [], []
                row = (int(node), int(w), np.asarray(v, np.float64), bool(tight))
                if not visit:
                    rows.append(row)
                elif rows or block:
                    block, rows = block or opened(), []
                    guests.append(row)
                    if len(guests) == VISITORS:
                        yield visited(block)
                        guests = []
        if guests and block:
            yield visited(block)
        if block or rows:
            yield done(block or opened())

    return run


def leaves(x: np.ndarray, rows: int, wanted: int, least: float) -> np.ndarray:
    """The centers of the lowest level: nodes are opened while they stand for more than ``wanted`` of ``rows`` rows and don't link all."""
    todo, centers = [tree(x)], []
    while todo:
        n = todo.pop()
        if len(n.at) > 1 and len(n.at) * rows > wanted * len(x) and 2 * n.radius > radius_of(least) - SLACK:
            todo += cover(x, n)
        else:
            centers.append(n.center)
    return np.sort(np.array(centers))


def _trees(points: DataFrame, least: float) -> dict[tuple[str, int], np.ndarray]:
    """The centers of each label that has more rows than a cell, from a bounded sample of its rows by a hash of them."""
    n = points.groupBy("grp", "dim").count().where(F.col("count") > F.greatest(F.lit(64), F.floor(F.lit(CELL_VALUES) / F.col("dim"))))
    sizes = {(r["grp"], r["dim"]): r["count"] for r in n.orderBy(F.desc("count"), "grp", "dim").limit(MOST_TREES).collect()}
    if not sizes:
        return {}
    wish = {k: max(16, 4 * c // cell_rows(k[1])) for k, c in sizes.items()}
    share = min(1.0, SAMPLE_VALUES / sum(w * k[1] for k, w in wish.items()))
    few = [(g, d, int((1 << 30) * min(1.0, share * wish[g, d] / c))) for (g, d), c in sizes.items()]
    few = F.broadcast(points.sparkSession.createDataFrame(few, "grp string, dim int, share bigint"))  # at most MOST_TREES rows
    sample = points.join(few, ["grp", "dim"]).where(F.pmod(F.xxhash64("node", F.lit("sample")), F.lit(1 << 30)) < F.col("share")).select("grp", "dim", "node", "embedding").toPandas()
    out = {}
    for (g, d), own in sample.sort_values("node").groupby(["grp", "dim"]):
        x = unit(np.stack([np.asarray(v, np.float64) for v in own["embedding"]]))
        out[g, int(d)] = x[leaves(x, sizes[g, int(d)], cell_rows(int(d)), least)]
    return out


def _celled(trees):
    """Add each row's cell, the nearest center, and the distance from it."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            cell, away = np.zeros(len(f), np.int64), np.full(len(f), 2.0)
            for key, at in f.groupby(["grp", "dim"]).indices.items():
                if (centers := trees.value.get((key[0], int(key[1])))) is not None:
                    for part in np.array_split(at, -(-len(at) * len(centers) // (1 << 21))):
                        d = apart(unit(np.stack([np.asarray(v, np.float64) for v in f["embedding"].iloc[part]])), centers)
                        cell[part] = d.argmin(1)
                        away[part] = d.min(1)
            yield f.assign(cell=cell, away=away)

    return run


def _routed(trees, radii, t: float):
    """A row for each cell before its own that a row has to visit."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for key, at in f.groupby(["grp", "dim"]).indices.items():
                key = (key[0], int(key[1]))
                if (centers := trees.value.get(key)) is None:
                    continue
                for part in np.array_split(at, -(-len(at) * len(centers) // (1 << 20))):
                    rows = f.iloc[part]
                    x, own = unit(np.stack([np.asarray(v, np.float64) for v in rows["embedding"]])), rows["cell"].to_numpy()
                    d, between = apart(x, centers), apart(centers[own], centers)
                    mine = d[np.arange(len(d)), own][:, None]
                    plane = (d * d - mine * mine) <= 2 * between * (t + SLACK) + SLACK  # twice the centers' distance times that from the plane midway
                    near = (d <= radii.value[key][None, :] + t + SLACK) & plane & (np.arange(len(centers))[None, :] < own[:, None])
                    i, j = np.nonzero(near)
                    yield rows.iloc[i].assign(cell=j)[["grp", "dim", "cell", "node", "w", "embedding"]]

    return run


def near_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | Column = "label", least: float = 0.98) -> DataFrame:
    """Per row: vec_id, n_links (other vectors linked directly), component_id (the smallest id reachable) and kept (it is that id)."""
    spark, t = df.sparkSession, radius_of(least)
    v, fit = fit_vector(df, vector_col, zero=False)
    label = F.col(label_col) if isinstance(label_col, str) else label_col
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), label.cast("string").alias("grp"), v.alias("embedding"), fit.alias("fit"))
    joins = F.col("fit") & F.col("vec_id").isNotNull() & F.col("grp").isNotNull()
    keys = ["grp", "dim", "h1", "h2"]
    keyed = rows.select("vec_id", "grp", F.when(joins, F.size("embedding")).alias("dim"), F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit(1), "embedding").alias("h2"), "embedding")
    steps = Steps(spark, "covertree")

    classes = keyed.where("dim IS NOT NULL").groupBy(*keys).agg(F.min("vec_id").alias("first"), F.count_distinct("vec_id").alias("w"))
    classes = classes.repartitionByRange("first").sortWithinPartitions("first", *keys)  # so that nodes are ordered as ids are
    classes = steps.keep("classes", classes.withColumn("node", F.monotonically_increasing_id()))
    own = keyed.where("dim IS NOT NULL").join(classes.withColumnRenamed("first", "vec_id"), [*keys, "vec_id"])
    points = steps.keep("points", own.groupBy("node").agg(*(F.any_value(c).alias(c) for c in ("grp", "dim", "w", "embedding"))))

    found_trees = _trees(points, least)
    trees = spark.sparkContext.broadcast(found_trees)
    kind = dict(points.dtypes)["embedding"]
    placed = steps.keep("placed", points.mapInPandas(_celled(trees), f"node bigint, grp string, dim int, w bigint, embedding {kind}, cell bigint, away double"))
    steps.drop("points")
    size, most = F.count("*"), F.greatest(F.lit(64), F.floor(F.lit(CELL_VALUES) / F.col("dim")))
    cells = placed.groupBy("grp", "dim", "cell").agg(F.max("away").alias("radius"), F.sum("w").alias("total"), F.min("node").alias("least_node"), F.ceil(size / most).alias("blocks"))
    cells = steps.keep("cells", cells.withColumn("tight", 2 * F.col("radius") <= t - SLACK))
    radii = {k: np.full(len(c), -np.inf) for k, c in found_trees.items()}
    if found_trees:  # a row for each center of the samples at most
        few = F.broadcast(spark.createDataFrame(list(found_trees), "grp string, dim int"))
        for r in cells.join(few, ["grp", "dim"]).collect():
            radii[r["grp"], r["dim"]][r["cell"]] = r["radius"]
    radii = spark.sparkContext.broadcast(radii)

    layout = ["grp", "dim", "cell", "block", "visit", "tight", "node", "w", "embedding"]
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).alias("block")
    held = placed.join(cells, ["grp", "dim", "cell"]).select("*", block)
    turns = lambda last: F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("block")
    inner = held.where("NOT tight AND block > 0").withColumnRenamed("block", "own").select("*", turns(F.col("own") - 1))
    visits = placed.mapInPandas(_routed(trees, radii, t), f"grp string, dim int, cell bigint, node bigint, w bigint, embedding {kind}")
    outer = visits.join(cells, ["grp", "dim", "cell"]).select("*", turns(F.col("blocks") - 1))
    met = held.withColumn("visit", F.lit(False)).select(layout)
    for more in (inner, outer):
        met = met.union(more.withColumn("visit", F.lit(True)).select(layout))
    order = ["grp", "dim", "cell", "block"]
    found = met.repartition(*order).sortWithinPartitions(*order, "visit").mapInPandas(_linked(least), FOUND)
    whole = held.where("tight AND total > w").select("node", (F.col("total") - F.col("w")).alias("links"), F.col("least_node").alias("root"))
    found = steps.keep("found", found.union(whole))

    joined = components(found.select(F.col("node").alias("u"), F.col("root").alias("v")), steps)
    roots = joined.join(classes.select(F.col("node").alias("component"), F.col("first").alias("component_id")), "component").select("node", "component_id")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    result = classes.join(counts, "node", "left").join(roots, "node", "left")
    result = result.select(*keys, (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("component_id", "first").alias("component_id"))
    out = keyed.drop("embedding").join(result, keys, "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
