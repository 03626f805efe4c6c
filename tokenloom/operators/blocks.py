"""Packing wrapped sequences into blocks of a fixed length; the rest behind the last full block is never emitted.

Null sequences give nothing, an empty one its two marks; repeated rows are packed each; an empty table gives no blocks (an
error for evaluation blocks, which would never be full). Only the order and the tokens are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.functions.sequences import wrap
from tokenloom.operators.positions import with_running

BLOCK = 2048


def pack_blocks(df: DataFrame, order: list[str], tokens: str, bos: int, eos: int, size: int = BLOCK, count: int | None = None) -> DataFrame:
    """(block_id, tokens): sequences wrapped and concatenated in the order, cut at every ``size`` tokens.

    Offsets are computed over sequences, not tokens; each sequence is cut into its stretches of blocks, and only stretches,
    at most one more than its blocks, are grouped. With ``count``, only the first blocks: sequences behind them are left out
    once their offsets are known.
    """
    wrapped = df.select(*order, wrap(F.col(tokens), bos, eos).alias("_w"))
    at = with_running(wrapped, order, F.size("_w"), "_at").where(F.size("_w") > 0)
    at = at if count is None else at.where(F.col("_at") < count * size)
    first, last = F.floor(F.col("_at") / size), F.floor((F.col("_at") + F.size("_w") - 1) / size)
    cut = at.withColumn("block_id", F.explode(F.sequence(first, last)))
    begin = F.greatest(F.col("block_id") * size, F.col("_at"))
    end = F.least((F.col("block_id") + 1) * size, F.col("_at") + F.size("_w"))
    piece = F.slice("_w", (begin - F.col("_at") + 1).cast("int"), (end - begin).cast("int"))
    grouped = cut.select("block_id", F.struct(begin.alias("at"), piece.alias("t")).alias("p")).groupBy("block_id").agg(F.sort_array(F.collect_list("p")).alias("ps"))
    whole = grouped.select("block_id", F.flatten(F.transform("ps", lambda p: p["t"])).alias("tokens"))
    return whole.where(F.size("tokens") == size)


def eval_blocks(df: DataFrame, order: list[str], tokens: str, bos: int, eos: int, size: int = BLOCK, count: int = 3000) -> DataFrame:
    """Exactly ``count`` blocks: the first ones, the corpus repeated where it has fewer."""
    total = df.agg(F.sum(F.size(tokens) + 2)).first()[0]
    if not total:
        raise ValueError("there are no token sequences to make blocks of")
    rounds = -(-count * size // total)
    turns = df.withColumn("_turn", F.explode(F.sequence(F.lit(1), F.lit(int(rounds)))))
    return pack_blocks(turns, ["_turn", *order], tokens, bos, eos, size, count).where(F.col("block_id") < count)


def shuffled(df: DataFrame, seed: int = 101, with_replacement: bool = False, fraction: float = 1.0) -> DataFrame:
    """Rows in a random order of the seed, resampled if asked for."""
    return (df.sample(with_replacement, fraction, seed) if with_replacement else df).orderBy(F.rand(seed))
