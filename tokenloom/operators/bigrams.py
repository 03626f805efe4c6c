"""A native language model over token sequences, and the place where another model plugs in.

The scorer's contract: log_prob sums the log probabilities of all next tokens of the wrapped sequence, n is their number,
log_prob_norm is log_prob / n, or 0 where n is 0. Null sequences are left out by the native model, and get nulls from a
plugged one; rows that repeat an id are summed by the native model; empty tables give no rows. Only the id and the tokens
are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.functions.sequences import steps, wrap


def train_bigrams(df: DataFrame, tokens: str, bos: int, eos: int) -> DataFrame:
    """(context, next, n, total): counts of next tokens and of their contexts."""
    pairs = df.select(F.explode(steps(wrap(F.col(tokens), bos, eos))).alias("s")).groupBy("s.context", "s.next").agg(F.count("*").alias("n"))
    totals = pairs.groupBy("context").agg(F.sum("n").alias("total"))
    return pairs.join(totals, "context")


def score(df: DataFrame, model: DataFrame, id_col: str, tokens: str, bos: int, eos: int, vocab: int) -> DataFrame:
    """(id, log_prob, log_prob_norm, num_tokens) under add-one smoothing; each (sequence, pair) is joined once."""
    pairs = df.select(F.col(id_col).alias("_id"), F.explode(steps(wrap(F.col(tokens), bos, eos))).alias("s")).groupBy("_id", "s.context", "s.next").agg(F.count("*").alias("k"))
    totals = model.select("context", "total").distinct()
    known = pairs.join(totals, "context", "left").join(model.select("context", "next", "n"), ["context", "next"], "left")
    log_p = F.log((F.coalesce("n", F.lit(0)) + 1) / (F.coalesce("total", F.lit(0)) + vocab))
    sums = known.groupBy("_id").agg(F.sum(F.col("k") * log_p).alias("log_prob"), F.sum("k").alias("num_tokens"))
    return sums.select(F.col("_id").alias(id_col), "log_prob", F.when(F.col("num_tokens") > 0, F.col("log_prob") / F.col("num_tokens")).otherwise(0.0).alias("log_prob_norm"), "num_tokens")


def loss(df: DataFrame, model: DataFrame, id_col: str, tokens: str, bos: int, eos: int, vocab: int) -> DataFrame:
    """The mean negative log probability over all positions."""
    return score(df, model, id_col, tokens, bos, eos, vocab).agg((-F.sum("log_prob") / F.sum("num_tokens")).alias("loss"))


def score_with(df: DataFrame, load: Callable[[], Callable[[list[list[int]]], list[tuple[float, int]]]], id_col: str, tokens: str) -> DataFrame:
    """Scores by any model: ``load`` runs once in each Python worker and gives a function of wrapped sequences to (log_prob, n)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for f in frames:
            some = f["t"].notna()
            got = iter(model([list(t) for t in f.loc[some, "t"]]))
            rows = [next(got) if ok else (None, None) for ok in some]
            out = pd.DataFrame({"id": f["id"], "log_prob": [r[0] for r in rows], "log_prob_norm": [None if r[0] is None else r[0] / r[1] if r[1] else 0.0 for r in rows], "num_tokens": pd.array([r[1] for r in rows], "Int64")})
            yield out.astype({"log_prob": float, "log_prob_norm": float})

    kind = dict(df.dtypes)[id_col]
    return df.select(F.col(id_col).alias("id"), F.col(tokens).alias("t")).mapInPandas(run, f"id {kind}, log_prob double, log_prob_norm double, num_tokens bigint").withColumnRenamed("id", id_col)
