"""Packing by optimal length buckets.

Dynamic programming over the global length histogram picks the bucket boundaries that minimise padding; inside a
bucket, token-budget batches follow from a row's place. Three linear passes, no unbounded group: the histogram has EXACT
bins and 64 more for each doubling of the longest text (about 2,400 for a million words), and places come from per-chunk counts whose prefix sums are added to a rank
within (bucket, chunk), so that a bucket that holds most rows is still ranked in many tasks.

Defined results: null and empty texts have length 0 and go to the first bucket; an empty table gives no rows; a text
longer than the token budget gets a batch of its own; repeated rows each take a slot. Ties in length are broken by id.
Further input columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.llm.common import WORD, cut

#: Lengths up to this have a bin each; above it, each octave has 64 of equal width.
EXACT = 1024
#: Rows that share a chunk, about, and rows of one id and length that a task makes at a time.
CHUNK_ROWS, REPEATS = 4096, 65_536


def length_bin(length: Column) -> Column:
    """The leading seven bits of a length above EXACT, and their place; in whole numbers."""
    octave = F.length(F.bin(length)) - 1
    fine = EXACT + 64 * octave + F.call_function("shiftright", length, octave - 6)
    return F.when(length <= EXACT, length).otherwise(fine.cast("long"))


def optimal_boundaries(tops: np.ndarray, counts: np.ndarray, sums: np.ndarray, k: int) -> list[int]:
    """At most k boundaries, out of tops (ascending bin maxima), of least total padding.

    Padding of bins i..j under boundary tops[j] is tops[j] * rows - tokens, exactly. Fewer buckets win a tie.
    """
    n = len(tops)
    if not n:
        return []
    k = max(1, min(k, n))
    rows, tokens = np.concatenate([[0.0], np.cumsum(counts, dtype=float)]), np.concatenate([[0.0], np.cumsum(sums, dtype=float)])
    cost = tops[None, :] * (rows[None, 1:] - rows[:-1, None]) - (tokens[None, 1:] - tokens[:-1, None])  # [i, j]: bins i..j
    cost[np.tril_indices(n, -1)] = np.inf
    best, back = [cost[0]], [np.zeros(n, dtype=int)]
    for _ in range(1, k):
        total = np.vstack([np.full(n, np.inf), best[-1][:-1, None] + cost[1:]])  # [i, j]: the last bucket begins at bin i
        at = np.argmin(total, axis=0)
        best.append(total[at, np.arange(n)])
        back.append(at)
    used = int(np.argmin([b[-1] for b in best]))
    cuts, j = [], n - 1
    for level in range(used, -1, -1):
        cuts.append(int(tops[j]))
        j = int(back[level][j]) - 1
    return cuts[::-1]


def histogram(lengths: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin maxima, rows and tokens; bounded by the bin rule, not by the input."""
    got = (
        lengths.groupBy(length_bin(F.col("n_tokens")).alias("bin"))
        .agg(F.max("n_tokens").alias("top"), F.count("*").alias("n"), F.sum("n_tokens").alias("tokens"))
        .collect()
    )
    got.sort(key=lambda r: r["top"])
    return tuple(np.array([r[c] for r in got], dtype=float) for c in ("top", "n", "tokens"))


def pack(df: DataFrame, id_col: str = "doc_id", length: Column | None = None, text_col: str = "text", buckets: int = 16, token_budget: int = 65_536) -> DataFrame:
    """Per row: doc_id, n_tokens, bucket (from 0), bucket_len, batch and slot (from 0 within the bucket), padding.

    A batch of bucket b holds max(1, token_budget // bucket_len) rows, so bucket_len times its rows keeps the budget.
    ``length`` is any integer column; without it, words of ``text_col`` count.
    """
    n = length if length is not None else F.coalesce(F.regexp_count(df[text_col], F.lit(WORD)), F.lit(0))
    lengths = cut(df.select(df[id_col].alias("doc_id"), n.cast("long").alias("n_tokens")))
    tops, counts, sums = histogram(lengths)
    edges = optimal_boundaries(tops, counts, sums, buckets) or [1]
    chunks = 1 << max(6, math.ceil(math.log2(max(1.0, counts.sum() / CHUNK_ROWS))))
    bucket = F.lit(0)
    for i, e in enumerate(edges[:-1]):
        bucket = bucket + (F.col("n_tokens") > e).cast("int")
    drawn = F.conv(F.substring(F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("n_tokens").cast("string")).cast("binary")), 1, 7), 16, 10)
    placed = lengths.withColumn("bucket", bucket).withColumn("chunk", F.pmod(drawn.cast("long"), F.lit(chunks)))
    before = Window.partitionBy("bucket").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("bucket", "chunk").count().select("bucket", "chunk", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    # rows of one id and length are alike: they are counted, and made again from their count, a long count in many tasks
    keyed = placed.groupBy("bucket", "chunk", "doc_id", "n_tokens").agg(F.count("*").alias("rows"))
    earlier = Window.partitionBy("bucket", "chunk").orderBy("doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    keyed = keyed.withColumn("place", F.coalesce(F.sum("rows").over(earlier), F.lit(0))).join(starts, ["bucket", "chunk"])
    keyed = cut(keyed.select("doc_id", "n_tokens", "bucket", "rows", (F.col("start") + F.col("place")).alias("first")))
    few = keyed.where(F.col("rows") <= REPEATS).withColumn("lo", F.lit(0).cast("long"))
    many = keyed.where(F.col("rows") > REPEATS).withColumn("lo", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1, F.lit(REPEATS).cast("long"))))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number, since there is little of it before it is made again
    ranked = few.union(many.repartition(parts, "doc_id", "n_tokens", "lo"))
    ranked = ranked.withColumn("k", F.explode(F.sequence("lo", F.least(F.col("lo") + REPEATS, F.col("rows")) - 1)))
    top = F.element_at(F.array(*(F.lit(e).cast("long") for e in edges)), F.col("bucket") + 1)
    size = F.greatest(F.lit(1), F.floor(F.lit(token_budget) / F.greatest(top, F.lit(1)))).cast("long")
    at = F.col("first") + F.col("k")
    return ranked.select(
        "doc_id",
        "n_tokens",
        "bucket",
        top.alias("bucket_len"),
        F.floor(at / size).cast("long").alias("batch"),
        (at % size).alias("slot"),
        (top - F.col("n_tokens")).alias("padding"),
    )
