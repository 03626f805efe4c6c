"""Language-model scoring by deleted interpolation of bigram, unigram and uniform estimates.

P(w | h) = l2[b] * c(h, w) / c(h) + l1[b] * c(w) / N + l0[b] / (V + 1), with b the frequency bucket of the context h.
The weights come from expectation-maximisation over held-out counts: of the documents learned from, one fold is held out,
its bigrams are looked up in the counts of the others, and the three component probabilities are gathered in a histogram
of bounded size (context buckets times two log ratios), on which EM runs on the driver. The final counts take the
held-out fold in again.

Data flow, built to move keys rather than tokens and to have no hot key:
1. Each task cuts its documents into blocks of about ``block_tokens`` tokens, and reduces a block to its distinct words
   and bigrams, as sorted 64-bit hashes with counts. A block sends each hash once, to a range of the hash space, so the
   most frequent word costs no more than a rare one; ranges are as even as the hash is.
2. Each range sums the counts of its hashes over all blocks and answers every block with the sums, in the block's order.
   There are as many ranges as the characters of the table ask for, so a range stays of one size however large the table.
3. A block's answers meet its token events (the block is built anew for this from the same scan); the result is
   checkpointed, read once for EM and once for scores.
All counts are exact but for 64-bit hash collisions: with n distinct n-grams, below n^2 / 2^65 pairs are expected.

The input must be read again alike (a file scan or a checkpoint): a block that differs in step 3 stops the job, by
signature. Defined results: null texts are empty (one token, the end); rows with a null id are scored, never learned
from, and not held out; repeated rows count each; an empty table gives no rows; with nothing to learn from, the model
and the base give every token 1 / (V + 1) = 1. Further input columns are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.llm.common import cut, fold

END, BEGIN = b"", b"\n"  # neither can be a word
#: What a document does: it is only scored, its counts are kept, or its counts are held out for EM.
SCORED, KEPT, HELD = 0, 1, 2
BUCKETS = 48
CELLS_PER_NAT = 8
#: Effort of the compression, for less disk.
LEVEL = 9
#: Tokens for each range of keys, about, and characters of a token; a range is summed in one task.
RANGE_TOKENS, TOKEN_CHARS = 2_000_000, 6

KEYS = "bucket int, block bigint, kind int, n int, sign bigint, keys binary, kept binary, held binary"
ANSWERS = "block bigint, kind int, bucket int, n int, sign bigint, total binary, held binary, events binary"
BLOCKS = "block bigint, n_types bigint, n_tokens bigint, n_kept bigint, payload binary"
SCORES = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def squeeze(a: np.ndarray) -> bytes:
    """An array as compressed byte planes, with its type in front."""
    a = np.ascontiguousarray(a)
    planes = a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes() if a.size else b""
    return a.dtype.str.encode().ljust(4) + zstandard.ZstdCompressor(level=LEVEL).compress(planes)


def unsqueeze(raw: bytes) -> np.ndarray:
    kind = np.dtype(raw[:4].decode().strip())
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[4:]), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(kind.itemsize, -1).T).view(kind).ravel() if planes.size else np.empty(0, kind)


def steps(a: np.ndarray) -> np.ndarray:
    """Differences of a sorted array, the first value kept; ``cumsum`` undoes it."""
    return np.diff(a, prepend=a.dtype.type(0))


def bundle(parts: dict[str, np.ndarray]) -> bytes:
    out = []
    for name, a in parts.items():
        raw = squeeze(a)
        out += [name.encode().ljust(8), len(raw).to_bytes(8, "little"), raw]
    return b"".join(out)


def unbundle(raw: bytes) -> dict[str, np.ndarray]:
    out, at = {}, 0
    while at < len(raw):
        name, n = raw[at : at + 8].decode().strip(), int.from_bytes(raw[at + 8 : at + 16], "little")
        out[name] = unsqueeze(raw[at + 16 : at + 16 + n])
        at += 16 + n
    return out


def mix(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """A 64-bit key of the pair of keys."""
    x = h * np.uint64(0x9E3779B97F4A7C15) + (w ^ (w >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def tokens(text: str | None) -> list[bytes]:
    """Words, A-Z lower-cased; bytes.lower and bytes.split know ASCII letters and ASCII white space only."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


class Block:
    """Documents of one task, as ids into the block's own vocabulary."""

    def __init__(self) -> None:
        self.vocabulary: dict[bytes, int] = defaultdict(count().__next__)
        self.end, self.begin = self.vocabulary[END], self.vocabulary[BEGIN]
        self.ids: list[np.ndarray] = []
        self.docs: list[int | None] = []
        self.roles: list[int] = []
        self.size = 0

    def add(self, doc_id: int | None, role: int, text: str | None) -> None:
        words = tokens(text)
        ids = np.empty(len(words) + 1, np.int64)
        ids[:-1] = list(map(self.vocabulary.__getitem__, words))
        ids[-1] = self.end
        self.ids.append(ids)
        self.docs.append(doc_id)
        self.roles.append(role)
        self.size += len(ids)

    def seal(self) -> None:
        v = len(self.vocabulary)
        self.lengths = np.array([len(x) for x in self.ids])
        after = np.concatenate(self.ids)
        before = np.empty_like(after)
        before[1:] = after[:-1]
        before[np.cumsum(self.lengths) - self.lengths] = self.begin
        self.pairs, self.at = np.unique(before * v + after, return_inverse=True)
        self.before, self.after = self.pairs // v, self.pairs % v
        self.role = np.repeat(np.array(self.roles), self.lengths)
        hashes = np.array([xxhash.xxh64_intdigest(w) for w in self.vocabulary], np.uint64)
        self.keys = {0: hashes, 1: mix(hashes[self.before], hashes[self.after])}
        self.order = {k: np.argsort(x, kind="stable") for k, x in self.keys.items()}
        self.sign = xxhash.xxh64_intdigest(self.keys[1].tobytes() + self.lengths.tobytes()) >> 1

    def counts(self, role: int) -> dict[int, np.ndarray]:
        """Of words, with the begin mark counted once for each document, and of bigrams."""
        pairs = np.bincount(self.at[self.role == role], minlength=len(self.pairs))
        words = np.bincount(self.after, weights=pairs, minlength=len(self.vocabulary)).astype(np.int64)
        words[self.begin] = sum(r == role for r in self.roles)
        return {0: words, 1: pairs}

    def events(self) -> bytes:
        starts = np.repeat(np.arange(len(self.docs)), self.lengths)
        at = self.at[np.lexsort((self.at, starts))]
        ids = np.array([d if d is not None else 0 for d in self.docs], np.int64)
        return bundle({
            "docs": ids, "null": np.array([d is None for d in self.docs], np.uint8), "roles": np.array(self.roles, np.uint8), "lengths": self.lengths.astype(np.int64),
            "at": steps(at.astype(np.int32)), "before": steps(self.before.astype(np.int32)), "after": self.after.astype(np.int32), "hashes": self.keys[0],
        })


def blocks(frames: Iterator[pd.DataFrame], block_tokens: int) -> Iterator[tuple[int, Block]]:
    """Sealed blocks of a task's documents, with ids that no other task gives."""
    made, b = 0, Block()
    for f in frames:
        made = made or int(f["part"].iloc[0]) << 24 if len(f) else made
        for doc_id, role, text in zip(f["doc_id"], f["role"], f["text"], strict=True):
            b.add(None if pd.isna(doc_id) else int(doc_id), int(role), text)
            if b.size >= block_tokens:
                b.seal()
                yield made, b
                made, b = made + 1, Block()
    if b.docs:
        b.seal()
        yield made, b


def key_rows(ranges: int, block_tokens: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for number, b in blocks(frames, block_tokens):
            kept, held, rows = b.counts(KEPT), b.counts(HELD), []
            for kind in (0, 1):
                order = b.order[kind]
                keys = b.keys[kind][order]
                bucket = ((keys >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
                edges = np.searchsorted(bucket, np.arange(ranges + 1, dtype=np.uint64))
                for r in np.flatnonzero(np.diff(edges)):
                    s = slice(edges[r], edges[r + 1])
                    part = order[s]
                    rows.append((int(r), number, kind, len(part), b.sign, squeeze(steps(keys[s])), squeeze(kept[kind][part].astype(np.uint32)), squeeze(held[kind][part].astype(np.uint32))))
                    if len(rows) == 256:
                        yield pd.DataFrame(rows, columns=[c.split()[0] for c in KEYS.split(", ")])
                        rows = []
            if rows:
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in KEYS.split(", ")])

    return run


def event_rows(block_tokens: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for number, b in blocks(frames, block_tokens):
            yield pd.DataFrame([(number, -1, -1, len(b.pairs), b.sign, None, None, b.events())], columns=[c.split()[0] for c in ANSWERS.split(", ")])

    return run


def answer(group: pd.DataFrame) -> pd.DataFrame:
    """Sums over all blocks of one range of keys, in each block's order; and what the range adds to N and V."""
    out, begin = [], np.uint64(xxhash.xxh64_intdigest(BEGIN))
    bucket = int(group["bucket"].iloc[0])
    for kind, part in group.groupby("kind"):
        keys = [np.cumsum(unsqueeze(k)) for k in part["keys"]]
        known, at = np.unique(np.concatenate(keys), return_inverse=True)
        sums = {c: np.bincount(at, weights=np.concatenate([unsqueeze(x) for x in part[c]]), minlength=len(known)).astype(np.uint64) for c in ("kept", "held")}
        total = sums["kept"] + sums["held"]
        if kind == 0:
            word = known != begin
            out.append((-1 - bucket, 0, bucket, int(np.count_nonzero(total[word])), 0, squeeze(total[word].sum(keepdims=True)), squeeze(sums["kept"][word].sum(keepdims=True)), None))
        done = 0
        for block, n, sign in zip(part["block"], part["n"], part["sign"], strict=True):
            mine = at[done : done + n]
            out.append((int(block), int(kind), bucket, int(n), int(sign), squeeze(total[mine]), squeeze(sums["held"][mine]), None))
            done += n
    return pd.DataFrame(out, columns=[c.split()[0] for c in ANSWERS.split(", ")])


def assemble(group: pd.DataFrame) -> pd.DataFrame:
    """A block's events with its counts; rows of negative blocks carry the shares of N and V."""
    columns = [c.split()[0] for c in BLOCKS.split(", ")]
    block = int(group["block"].iloc[0])
    if block < 0:
        return pd.DataFrame([(block, int(group["n"].iloc[0]), int(unsqueeze(group["total"].iloc[0])[0]), int(unsqueeze(group["held"].iloc[0])[0]), None)], columns=columns)
    if group["sign"].nunique() != 1 or (group["kind"] == -1).sum() != 1:
        raise ValueError(f"block {block} was read twice and differed; give a scan or a checkpoint")
    e = unbundle(group.loc[group["kind"] == -1, "events"].iloc[0])
    counts = {}
    before, after = np.cumsum(e["before"]), e["after"]
    for kind, order in ((0, np.argsort(e["hashes"], kind="stable")), (1, np.argsort(mix(e["hashes"][before], e["hashes"][after]), kind="stable"))):
        part = group[group["kind"] == kind].sort_values("bucket")
        for c in ("total", "held"):
            got = np.empty(len(order), np.uint64)
            got[order] = np.concatenate([unsqueeze(x) for x in part[c]])
            counts[f"{c}{kind}"] = got
    keep = {k: e[k] for k in ("docs", "null", "roles", "lengths", "at", "before", "after")}
    return pd.DataFrame([(block, 0, 0, 0, bundle(keep | counts))], columns=columns)


def context_bucket(c: np.ndarray) -> np.ndarray:
    return np.where(c > 0, np.minimum(np.log2(np.maximum(c, 1.0)).astype(int) + 1, BUCKETS - 1), 0)


def cells(n_kept: int, n_types: int):
    """Per task: how many held-out events fell in each cell, with the sums of their log ratios."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for raw in f["payload"]:
                x = unbundle(raw)
                starts = np.repeat(x["roles"], x["lengths"])
                n = np.bincount(_events(x)[starts == HELD], minlength=len(x["after"]))
                used = np.flatnonzero(n)
                before, after = np.cumsum(x["before"])[used], x["after"][used]
                pair, word = ((x[f"total{k}"] - x[f"held{k}"]).astype(float) for k in (1, 0))
                with np.errstate(divide="ignore", invalid="ignore"):
                    r1 = np.log(word[after] / n_kept * (n_types + 1)) if n_kept else np.full(len(used), -np.inf)
                    r2 = np.log(np.where(word[before] > 0, pair[used] / word[before], 0.0) * (n_types + 1)) - np.where(np.isfinite(r1), r1, 0)
                cut_ = lambda r: np.where(np.isfinite(r), np.floor(np.clip(r, -60, 60) * CELLS_PER_NAT), -999).astype(int)
                g = pd.DataFrame({"b": context_bucket(word[before]), "i1": cut_(r1), "i2": cut_(r2), "n": n[used].astype(float)})
                g["s1"], g["s2"] = np.where(np.isfinite(r1), r1, 0) * g["n"], np.where(np.isfinite(r2), r2, 0) * g["n"]
                if len(g):
                    yield g.groupby(["b", "i1", "i2"], as_index=False).sum()

    return run


def em_weights(table: pd.DataFrame, rounds: int = 60) -> np.ndarray:
    """Weights (uniform, unigram, bigram) of each context bucket, from cells b, i1, i2, n, s1, s2.

    A bucket without held-out events takes the weights of all; for an unseen context the bigram part goes to the others.
    """

    def learn(t: pd.DataFrame) -> np.ndarray:
        n = t["n"].to_numpy()
        one = np.where(t["i1"] > -999, np.exp(t["s1"] / n), 0.0)
        two = np.where(t["i2"] > -999, np.exp(t["s2"] / n) * np.where(t["i1"] > -999, one, 1.0), 0.0)
        p, w = np.stack([np.ones(len(t)), one, two], 1), np.full(3, 1 / 3)
        for _ in range(rounds):
            post = w * p
            w = (post / post.sum(1, keepdims=True) * n[:, None]).sum(0) / n.sum()
            w = np.maximum(w, 1e-6)
            w /= w.sum()
        return w

    every = learn(table) if len(table) else np.full(3, 1 / 3)
    out = np.tile(every, (BUCKETS, 1))
    for b, t in table.groupby("b"):
        out[int(b)] = learn(t)
    out[0, 2] = 0
    return out / out.sum(1, keepdims=True)


def _events(x: dict[str, np.ndarray]) -> np.ndarray:
    return np.cumsum(x["at"])


def scorer(weights: np.ndarray, n: int, v: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for raw in f["payload"]:
                x = unbundle(raw)
                before, after = np.cumsum(x["before"]), x["after"]
                word, pair = x["total0"].astype(float), x["total1"].astype(float)
                l0, l1, l2 = weights[context_bucket(word[before])].T if n else np.array([[1.0], [0.0], [0.0]])
                p = l0 / (v + 1) + l1 * word[after] / max(n, 1) + l2 * pair / np.maximum(word[before], 1)
                base = (word[after] + 0.5) / (n + 0.5 * (v + 1))
                at, doc = _events(x), np.repeat(np.arange(len(x["docs"])), x["lengths"])
                add = lambda values, at=at, doc=doc, x=x: np.bincount(doc, weights=values[at], minlength=len(x["docs"]))
                yield pd.DataFrame({
                    "doc_id": pd.Series(x["docs"], dtype="Int64").mask(x["null"] == 1),
                    "held_out": (x["roles"] == SCORED) & (x["null"] == 0), "n_tokens": x["lengths"], "n_known": add((word[after] > 0).astype(float)).astype(np.int64),
                    "train_tokens": np.full(len(x["docs"]), n), "base_score": add(np.log10(base)), "score": add(np.log10(p)),
                })

    return run


def deleted_interpolation(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_tokens: int = 2_000_000, held_fold: int = 2) -> DataFrame:
    """Scores of all rows, learned from those whose crc32(id as text) mod 5 is not 1; ``held_fold`` serves EM first."""
    spark = df.sparkSession
    chars = df.agg(F.sum(F.length(text_col).cast("long"))).first()[0] or 0
    ranges = max(32, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-chars // (RANGE_TOKENS * TOKEN_CHARS)))
    part = fold(df[id_col], 5)
    role = F.when(part.isNull() | (part == 1), SCORED).when(part == held_fold, HELD).otherwise(KEPT)
    docs = df.select(df[id_col].cast("long").alias("doc_id"), role.alias("role"), df[text_col].alias("text"), F.spark_partition_id().alias("part"))
    answers = docs.mapInPandas(key_rows(ranges, block_tokens), KEYS).groupBy("bucket").applyInPandas(answer, ANSWERS)
    events = docs.mapInPandas(event_rows(block_tokens), ANSWERS)
    sealed = cut(answers.unionByName(events).groupBy("block").applyInPandas(assemble, BLOCKS))
    whole = sealed.where("block < 0").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_types", "n_tokens", "n_kept"))).first()
    full = sealed.where("block >= 0").select("payload")
    kept = full.mapInPandas(cells(whole.n_kept, whole.n_types), "b int, i1 int, i2 int, n double, s1 double, s2 double")
    table = kept.groupBy("b", "i1", "i2").agg(F.sum("n").alias("n"), F.sum("s1").alias("s1"), F.sum("s2").alias("s2")).toPandas()
    return full.mapInPandas(scorer(em_weights(table), whole.n_tokens, whole.n_types), SCORES)
