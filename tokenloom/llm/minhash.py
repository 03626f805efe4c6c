"""Near-duplicate detection by circulant MinHash, banding and exact verification.

Two permutations of the 32-bit universe make all coordinates of a signature: sigma scatters the shingles, and coordinate
k is the least value of pi shifted circularly by k over them. Bands of ``BAND_ROWS`` coordinates give bucket keys.

Texts with the same shingle set form a class, a node of the graph, so exact copies cost one row each. No step expands a
bucket into its pairs:
1. the smallest node of a bucket is the hub of its other nodes; each node is verified against the hub it shares most
   buckets with, and the links are joined into components;
2. the nodes that share a bucket with a hub of one component are a group; where a group still holds several components,
   members leave that have too many shingles which no other member has. Of the others, two that are alike share one of the
   rarest shingles that both have: the larger set among as many as may be missing from the smaller one, the smaller set among
   even fewer. Lists of these shingles, from one aggregation, tell which members can still be alike; those that hang together
   over lists are compared exactly across components: dealt in runs of HOLD shingles, two runs in a task, which emits only
   links that join what is apart.
Verification is exact, on 64-bit shingle hashes of the whole texts. Banding misses a pair of similarity s with
probability (1 - s^5)^40: 1.3e-7 at 0.8; nothing else is lost. Members that share most shingles, and have more of their own
than alike texts may, are on no list together, however many they are.

Defined results: texts without words (null too) have the empty set and are linked with nothing; fewer words than the
width make one shingle, the whole sequence; rows with a null id are linked with nothing and kept, with a null component;
rows that repeat an id get the component of their own text, even where the texts differ. An empty table gives no rows.
Further columns are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.llm.common import Steps
from tokenloom.llm.components import components

BANDS, BAND_ROWS = 40, 5
COORDINATES = BANDS * BAND_ROWS
#: Shingles of a run of members that one task compares with another run.
HOLD = 1 << 18
SEEDS = (0x9E3779B9, 0x85EBCA77)
SIGNED = "doc_id bigint, n_shingles bigint, class binary, bands array<bigint>"


def scatter32(x: np.ndarray) -> np.ndarray:
    """A bijection of 32-bit numbers, in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(16)
    return x


def mix(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    x = h * np.uint64(0x9E3779B97F4A7C15) + (w ^ (w >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    ids: dict[bytes, int] = defaultdict(count().__next__)
    docs = [np.fromiter(map(ids.__getitem__, (t or "").encode("utf-8", "surrogatepass").lower().split()), np.int64) for t in texts]
    hashes = np.array([xxhash.xxh64_intdigest(w) for w in ids], np.uint64)
    out = []
    for d in docs:
        if not len(d):
            out.append(np.empty(0, np.uint64))
            continue
        h, n = hashes[d], max(1, len(d) - width + 1)
        key = np.full(n, min(width, len(d)), np.uint64)
        for j in range(min(width, len(d))):
            key = mix(key, h[j : j + n])
        out.append(np.unique(key))
    return out


_SHIFTS = np.arange(COORDINATES, dtype=np.uint32)[:, None]


def signature(shingles: np.ndarray, part: int = 2048) -> np.ndarray:
    """Coordinate k: the least of pi(sigma(x) + k) over the shingles x."""
    spread = scatter32((shingles ^ (shingles >> np.uint64(32))).astype(np.uint32) ^ np.uint32(SEEDS[0]))
    least = np.full(COORDINATES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(spread), part):
        x = spread[None, at : at + part] + _SHIFTS
        x ^= np.uint32(SEEDS[1])
        np.minimum(least, scatter32(x).min(1), out=least)
    return least


def bands(sig: np.ndarray) -> np.ndarray:
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for c in sig.reshape(BANDS, BAND_ROWS).T:
        key = mix(key, c.astype(np.uint64))
    return key.view(np.int64)


def digest(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def _sign(width: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for at in range(0, len(f), 512):
                part = f.iloc[at : at + 512]
                rows = []
                for i, s in zip(part["doc_id"], shingle_sets(list(part["text"]), width), strict=True):
                    rows.append((i, len(s), digest(s), bands(signature(s))) if len(s) else (i, 0, None, None))
                out = pd.DataFrame(rows, columns=["doc_id", "n_shingles", "class", "bands"])
                out["doc_id"] = out["doc_id"].astype("Int64")
                yield out

    return run


def _sets(width: int):
    """The sets of texts that are their class's own; another text under the same id is left out."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for at in range(0, len(f), 512):
                part = f.iloc[at : at + 512]
                of = shingle_sets(list(part["text"]), width)
                own = [len(s) > 0 and digest(s) == bytes(c) for s, c in zip(of, part["class"], strict=True)]
                yield pd.DataFrame({"node": part["node"][own], "shingles": [s.view(np.int64) for s, o in zip(of, own, strict=True) if o]})

    return run


def to_hubs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """From rows (band, node) in this order: (band, node, hub) for each further node of a band, the hub its first one here.

    Of a band that may go on in another partition, the first or last here, a row (band, null, hub) follows. No more than a
    batch is held, however large the band.
    """
    first = last = hub = node = None

    def rows(band, nodes, hubs) -> pd.DataFrame:
        return pd.DataFrame({"band": pd.array(band, "Int64"), "node": pd.array(nodes, "Int64"), "hub": pd.array(hubs, "Int64")})

    for f in frames:
        band, at = f["band"].to_numpy(np.int64), f["node"].to_numpy(np.int64)
        if not len(f):
            continue
        if last is not None:  # the last row before, so that its band goes on
            band, at = np.r_[last, band], np.r_[node, at]
        begins = np.r_[True, band[1:] != band[:-1]]
        hubs = at[begins][np.cumsum(begins) - 1]
        if last is None:
            first = (int(band[0]), int(at[0]))
        else:
            hubs[: len(band) if begins.sum() == 1 else int(np.flatnonzero(begins)[1])] = hub
        more = ~begins & np.r_[False, at[1:] != at[:-1]]
        yield rows(band[more], at[more], hubs[more])
        last, hub, node = int(band[-1]), int(hubs[-1]), int(at[-1])
    if last is not None:
        ends = sorted({first, (last, hub)})
        yield rows([b for b, _ in ends], [None] * len(ends), [h for _, h in ends])


def _hubs(placed: DataFrame, steps: Steps) -> DataFrame:
    """(node, hub) for each node of a band of several, the hub the band's smallest; a pair once for each band.

    Rows are dealt by ranges of (band, node), so a hot band lies in many partitions. Their smallest nodes are at most two
    for each partition, and only those are met by a broadcast.
    """
    dealt = placed.repartitionByRange("band", "node").sortWithinPartitions("band", "node")
    met = steps.keep("met", dealt.mapInPandas(to_hubs, "band bigint, node bigint, hub bigint"))
    across = met.where("node IS NULL").groupBy("band").agg(F.min("hub").alias("whole"), F.max("hub").alias("high")).where("whole < high")
    across = steps.keep("across", across.select("band", "whole"))
    found = met.join(F.broadcast(across), "band", "left").withColumn("node", F.coalesce("node", "hub")).withColumn("hub", F.coalesce("whole", "hub"))
    return found.where("node != hub").select("node", "hub")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose full sets are alike enough."""
    both = pairs.join(sets.toDF("u", "of_u"), "u").join(sets.toDF("v", "of_v"), "v")
    shared = F.size(F.array_intersect("of_u", "of_v"))
    return both.where(100 * shared >= percent * (F.size("of_u") + F.size("of_v") - shared)).select("u", "v")


def _split(members: DataFrame, steps: Steps, name: str) -> DataFrame:
    """The members of groups that hold several components and are not merely a node and the hub it was tried with.

    The groups are a table of their own, so that the join of a hot one is split.
    """
    spans = members.groupBy("group").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n"), F.max("tried").alias("tried"))
    spans = steps.keep(name, spans.where("low < high AND NOT (n = 2 AND tried)").select("group"))
    return members.join(spans, "group", "left_semi")


def _listed(members: DataFrame, sets: DataFrame, percent: int, steps: Steps) -> DataFrame:
    """(group, component, node, n_shingles) of members that can be alike to one of another component, in groups that hang together.

    In the order of shingles in which those of one component alone come first and then the rarest in the group, two sets x
    and y with |x| <= |y| that are alike share a shingle among the first |x| - ceil(2p|x| / (100 + p)) + 1 of x and among
    the first |y| - ceil(p|y| / 100) + 1 of y. A list holds the members with one shingle among those; it counts if a member has
    it among the fewer and it spans components. No pair is formed: members are joined to the smallest of their list.
    """
    each = members.join(sets, "node").select("group", "component", "node", "n_shingles", F.explode("shingles").alias("shingle"))
    shared = each.groupBy("group", "shingle").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n"))
    shared = steps.keep("shared", shared.where("low < high").select("group", "shingle", "n"))
    own = each.join(shared, ["group", "shingle"]).groupBy("group", "node").agg(
        F.any_value("component").alias("component"), F.any_value("n_shingles").alias("n_shingles"), F.sort_array(F.collect_list(F.struct("n", "shingle"))).alias("common")
    )
    own = own.withColumn("alone", F.col("n_shingles") - F.size("common"))
    own = own.withColumn("longer", F.expr(f"n_shingles - ({percent} * n_shingles + 99) div 100 + 1 - alone"))
    own = own.withColumn("shorter", F.expr(f"n_shingles - (2 * {percent} * n_shingles + {99 + percent}) div {100 + percent} + 1 - alone"))
    first = F.slice("common", F.lit(1), F.least(F.col("longer").cast("int"), F.size("common")))
    entries = own.where("longer > 0").select("group", "component", "node", "n_shingles", "shorter", F.posexplode(first).alias("at", "s"))
    entries = steps.keep("entries", entries.select("group", "component", "node", "n_shingles", F.col("s.shingle").alias("shingle"), (F.col("at") < F.col("shorter")).alias("few")))
    lists = entries.groupBy("group", "shingle").agg(F.max("few").alias("few"), F.min("component").alias("low"), F.max("component").alias("high"), F.min("node").alias("hub"))
    lists = steps.keep("lists", lists.where("few AND low < high").select("group", "shingle", "hub"))
    met = entries.join(lists, ["group", "shingle"]).select("component", "node", "n_shingles", "hub").distinct()
    met = steps.keep("listed", met)
    whole = components(met.select(F.col("node").alias("u"), F.col("hub").alias("v")), Steps(steps.spark, "minhash-lists"))
    steps.drop("shared", "entries", "lists")
    named = met.select("component", "node", "n_shingles").distinct().join(whole.toDF("node", "whole"), "node", "left")
    return named.select(F.coalesce("whole", "node").alias("group"), "component", "node", "n_shingles")


def _eligible(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Members without those that have too many shingles that no other of their group has to be alike to any of them.

    A shingle of one member only is in no intersection. One aggregation over the shingles, combined before the shuffle,
    finds those and their owner; its work grows with the members, not with their pairs.
    """
    each = members.join(sets, "node").select("group", "node", F.explode("shingles").alias("shingle"))
    alone = each.groupBy("group", "shingle").agg(F.count("*").alias("n"), F.min("node").alias("node")).where("n = 1")
    alone = alone.groupBy("group", "node").agg(F.count("*").alias("alone"))
    kept = members.join(alone, ["group", "node"], "left")
    return kept.where(100 * (F.col("n_shingles") - F.coalesce("alone", F.lit(0))) >= percent * F.col("n_shingles")).drop("alone")


def _deal(limit: int):
    """Add ``run`` to rows in order: a partition is cut after every ``limit`` shingles."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        before, part = 0, TaskContext.get().partitionId() << 32
        for f in frames:
            total = before + np.cumsum(f["n_shingles"].to_numpy(np.int64))
            f["run"] = part + (total - f["n_shingles"].to_numpy(np.int64)) // limit
            before = int(total[-1]) if len(total) else before
            yield f

    return run


def join_apart(frame: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links (u, v) of components that join what is alike across them, in the groups of at most two runs.

    Exact: for each member, its intersections with all members of a size that allows the similarity and of another
    component are counted in one pass over their shingles. Members of the same run meet where it is paired with itself.
    """
    links = []
    for _, g in frame.groupby("group"):
        label, inverse = np.unique(g["component"].to_numpy(np.int64), return_inverse=True)
        run, each = g["run"].to_numpy(np.int64), list(g["shingles"])
        while len(np.unique(inverse)) > 1:  # leave out what shares too little with all others here, until none is left to leave out
            size = np.array([len(x) for x in each])
            owner = np.repeat(np.arange(len(each)), size)
            _, at, seen = np.unique(np.concatenate(each), return_inverse=True, return_counts=True)
            enough = 100 * np.bincount(owner, seen[at] > 1, len(each)) >= percent * size
            if enough.all():
                break
            inverse, run, each = inverse[enough], run[enough], [x for x, e in zip(each, enough, strict=True) if e]
        if len(np.unique(inverse)) < 2:
            continue
        order = np.argsort(size, kind="stable")
        place = np.concatenate([np.arange(0), *(at[b : b + n] for b, n in zip((np.cumsum(size) - size)[order], size[order], strict=True))])
        size, now, run = size[order], inverse[order], run[order]
        begin, cross, held = np.r_[0, np.cumsum(size)], len(np.unique(run)) > 1, np.zeros(len(seen), bool)
        for x in range(len(size) - 1):
            end = int(np.searchsorted(size * percent, 100 * size[x], "right"))
            wanted = now[x + 1 : end] != now[x]
            if cross:
                wanted &= run[x + 1 : end] != run[x]
            if not wanted.any():
                continue
            held[place[begin[x] : begin[x + 1]]] = True
            shared = np.add.reduceat(held[place[begin[x + 1] : begin[end]]], begin[x + 1 : end] - begin[x + 1], dtype=np.int64)
            held[place[begin[x] : begin[x + 1]]] = False
            alike = wanted & (100 * shared >= percent * (size[x] + size[x + 1 : end] - shared))
            for y in np.unique(now[x + 1 : end][alike]):
                if y != now[x]:
                    links.append((label[max(y, now[x])], label[min(y, now[x])]))
                    now[now == y] = now[x]
    return pd.DataFrame(links, columns=["u", "v"]).astype("int64")


def _joined(members: DataFrame, sets: DataFrame, percent: int, steps: Steps) -> DataFrame:
    """Links (u, v) between components of (group, component, node, n_shingles), from exact comparisons across them.

    Members are dealt in runs of at most HOLD shingles, or one text; two runs of one group are compared in one task,
    which holds no more than them and emits no more links than join what is apart.
    """
    order = ["group", "component", "node"]
    dealt = members.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = steps.keep("runs", dealt.mapInPandas(_deal(HOLD), "group bigint, component bigint, node bigint, n_shingles bigint, run bigint"))
    spans = dealt.groupBy("group", "run").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    pairs = spans.toDF("group", "i", "i_low", "i_high").join(spans.toDF("group", "j", "j_low", "j_high"), "group")
    pairs = pairs.where("i <= j AND least(i_low, j_low) < greatest(i_high, j_high)").select("group", "i", "j")
    wanted = pairs.select("group", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("run"))
    full = wanted.join(dealt, ["group", "run"]).select("i", "j", "group", "run", "component", "node").join(sets, "node")
    return full.groupBy("i", "j").applyInPandas(lambda f: join_apart(f, percent), "u bigint, v bigint")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (the smallest id reachable over links) and kept (it is that id)."""
    docs = df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].alias("text"))
    steps = Steps(df.sparkSession, "minhash")
    signed = steps.keep("signed", docs.mapInPandas(_sign(width), SIGNED))
    named = signed.where("class IS NOT NULL AND doc_id IS NOT NULL")
    classes = named.groupBy("class").agg(F.min("doc_id").alias("doc_id"), F.min("n_shingles").alias("n_shingles"))
    classes = classes.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "class")  # so that nodes are ordered as ids are
    classes = steps.keep("classes", classes.withColumn("node", F.monotonically_increasing_id()))
    own = named.join(classes.select("class", "doc_id", "node"), ["class", "doc_id"])
    votes = _hubs(own.select(F.explode("bands").alias("band"), "node"), steps).repartition("node").groupBy("node", "hub").agg(F.count("*").alias("votes"))
    best = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("votes"), "hub")) == 1
    pairs = steps.keep("pairs", votes.select("node", "hub", best.alias("best")))
    steps.drop("met", "across")

    known = pairs.select("node").union(pairs.select("hub")).distinct()
    known = steps.keep("known", classes.join(known, "node", "left_semi").select("doc_id", "class", "node"))
    texts = docs.join(known.hint("merge"), "doc_id").select("node", "class", "text")  # alike at every size
    sets = steps.keep("sets", texts.mapInPandas(_sets(width), "node bigint, shingles array<bigint>").dropDuplicates(["node"]))
    links = _verified(pairs.where("best").select(F.col("node").alias("u"), F.col("hub").alias("v")), sets, percent)
    found = steps.keep("found", components(links, steps))

    placed = pairs.join(found.toDF("hub", "group"), "hub", "left").withColumn("group", F.coalesce("group", "hub"))
    members = placed.select("group", "node", "best").union(placed.select("group", F.col("hub").alias("node"), F.lit(False)))
    members = members.groupBy("group", "node").agg(F.max("best").alias("tried"))
    members = members.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    members = steps.keep("members", _split(members, steps, "apart").join(classes.select("node", "n_shingles"), "node").select("group", "component", "node", "n_shingles", "tried"))
    left = steps.keep("able", _eligible(members, sets, percent))
    left = _split(left, steps, "still").select("group", "component", "node", "n_shingles")
    left = steps.keep("left", _listed(left, sets, percent, steps))
    steps.drop("known", "pairs", "members", "apart", "able", "still", "listed")
    further = steps.keep("further", components(_joined(left, sets, percent, steps), steps).toDF("component", "whole"))
    steps.drop("sets", "left", "runs")

    joined = found.join(further, "component", "left").select("node", F.coalesce("whole", "component").alias("root"))
    joined = joined.union(further.select(F.col("component").alias("node"), F.col("whole").alias("root")))
    roots = joined.join(classes.select(F.col("node").alias("root"), F.col("doc_id").alias("component")), "root")
    label = classes.join(roots.select("node", "component"), "node", "left").select("class", F.coalesce("component", "doc_id").alias("component"))
    label = steps.keep("label", label)
    steps.drop("found", "further", "classes")
    out = signed.select("doc_id", "n_shingles", "class").join(label, "class", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``df`` that stand for their group, with all columns; a repeated id stays or goes as one.

    An id with several texts goes if one of them stands for less than its group.
    """
    gone = near_duplicates(df, id_col, text_col, width, percent).where("NOT kept").select(F.col("doc_id").alias("_gone")).distinct()
    return df.join(gone, df[id_col] == gone["_gone"], "left_anti")
