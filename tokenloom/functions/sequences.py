"""Column functions over arrays: token sequences, frames and waveforms.

A null array gives null, an empty one the empty result (or null where there is no element to take); each row stands for itself, so
repeated rows and empty tables need no rule. Only the arrays given are read.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def collapse_repeats(tokens: Column) -> Column:
    """Drop every element equal to the one before it."""
    return F.filter(tokens, lambda x, i: (i == 0) | ~x.eqNullSafe(F.get(tokens, i - 1)))


def wrap(tokens: Column, bos: int, eos: int) -> Column:
    """Begin mark, tokens, end mark."""
    return F.concat(F.array(F.lit(bos)), tokens.cast("array<int>"), F.array(F.lit(eos)))


def argmax(scores: Column) -> Column:
    """Place of the first largest element, from 0; null for an empty array."""
    return F.when(F.size(scores) > 0, F.array_position(scores, F.array_max(scores)).cast("int") - 1)


def mean(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x) / F.size(xs)


def layer_norm(xs: Column, eps: float = 1e-5) -> Column:
    """(x - mean) / sqrt(biased variance + eps)."""
    wide = xs.cast("array<double>")
    stats = F.transform(F.array(wide), lambda w: F.struct(w.alias("w"), mean(w).alias("m")))
    full = F.transform(stats, lambda s: F.struct(s["w"].alias("w"), s["m"].alias("m"), F.sqrt(mean(F.transform(s["w"], lambda x: (x - s["m"]) * (x - s["m"]))) + eps).alias("d")))
    return F.get(F.transform(full, lambda s: F.transform(s["w"], lambda x: (x - s["m"]) / s["d"])), F.lit(0))


def first_channel(channels: Column) -> Column:
    """Mono by taking the first channel, as an array of one channel."""
    return F.array(F.get(channels, F.lit(0)))


def steps(wrapped: Column) -> Column:
    """(context, next) for each next token."""
    before = F.slice(wrapped, F.lit(1), F.greatest(F.size(wrapped) - 1, F.lit(0)))
    after = F.slice(wrapped, F.lit(2), F.greatest(F.size(wrapped) - 1, F.lit(0)))
    return F.zip_with(before, after, lambda a, b: F.struct(a.alias("context"), b.alias("next")))


def collate(block: Column) -> dict[str, Column]:
    """Inputs, equal labels and a mask of ones."""
    return {"input_ids": block, "labels": block, "attention_mask": F.array_repeat(F.lit(1), F.size(block))}
