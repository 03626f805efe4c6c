"""Encoders: a registry of vocabularies, and an Arrow-batched UDF around any encoder that tolerates bad rows.

A null or unreadable waveform becomes an error of its row; repeated rows are encoded each; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, ShortType, StringType, StructField, StructType

#: Encoder names and their numbers of tokens.
VOCABULARIES = {"spidr_base": 256, "mhubert": 2000, "hubert-500": 500}
#: Fixed value: messages of expected failures, which a report leaves out though the rows count as errors.
SILENT = ("Cannot subsample F0",)

Encode = Callable[[np.ndarray, int], np.ndarray]


@dataclass(frozen=True)
class Vocabulary:
    name: str
    n_tokens: int

    @property
    def bos(self) -> int:
        return self.n_tokens

    @property
    def eos(self) -> int:
        return self.n_tokens + 1

    @property
    def size(self) -> int:
        return self.n_tokens + 2


_FACTORIES: dict[str, Callable[..., Encode]] = {}


def register(name: str, n_tokens: int, factory: Callable[..., Encode]) -> None:
    VOCABULARIES[name] = n_tokens
    _FACTORIES[name] = factory


def vocabulary(name: str) -> Vocabulary:
    if name not in VOCABULARIES:
        raise ValueError(f"no encoder {name}; there are {sorted(VOCABULARIES)}")
    return Vocabulary(name, VOCABULARIES[name])


def dimension(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(v.name, v.n_tokens, v.bos, v.eos, v.size) for v in map(vocabulary, VOCABULARIES)], "name string, n_tokens int, bos int, eos int, vocab int")


ENCODED = StructType([StructField("tokens", ArrayType(ShortType())), StructField("error", StringType())])


def level_encoder(n_tokens: int = 256) -> Encode:
    """The mean level of 20 ms frames, quantised, without repeats: the one encoder that needs no weights, registered as ``levels``."""

    def encode(wave: np.ndarray, rate: int) -> np.ndarray:
        step = max(1, rate // 50)
        frames = wave[: len(wave) // step * step].reshape(-1, step)
        level = np.sqrt((frames.astype(float) ** 2).mean(1)) if len(frames) else np.empty(0)
        tokens = np.minimum((level * n_tokens).astype(np.int16), n_tokens - 1)
        return tokens[np.concatenate([[True], tokens[1:] != tokens[:-1]])] if len(tokens) else tokens

    return encode


def factory(name: str) -> Callable[..., Encode]:
    """What makes an encoder. A name whose weights aren't here (a vocabulary without a factory) is refused until ``register`` brings it."""
    vocabulary(name)
    if name not in _FACTORIES:
        raise ValueError(f"no encoder is registered for {name}; there are {sorted(_FACTORIES)}")
    return _FACTORIES[name]


def encoder_udf(name: str, **options):
    """struct<tokens, error> of (wave array<float>, rate int): the encoder is made once in each worker, errors become rows."""
    make = factory(name)

    @F.pandas_udf(ENCODED)
    def encode(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        model = make(**options)
        for waves, rates in batches:
            rows = []
            for w, r in zip(waves, rates, strict=True):
                try:
                    rows.append((np.asarray(model(np.asarray(w, np.float32), int(r))).astype(np.int16).tolist(), None))
                except Exception as e:  # a bad row is counted, not fatal
                    rows.append((None, str(e)[:100]))
            yield pd.DataFrame(rows, columns=["tokens", "error"])

    return encode


def split_errors(df: DataFrame, encoded: str = "encoded", silent: tuple[str, ...] = SILENT) -> tuple[DataFrame, DataFrame]:
    """(rows with tokens and no error, rows with an error): the second with ``shown``, false for messages to leave out."""
    error = F.col(f"{encoded}.error")
    quiet = F.lit(False)
    for part in silent:
        quiet = quiet | error.contains(part)
    return df.where(error.isNull()), df.where(error.isNotNull()).withColumn("shown", ~quiet)


register("levels", 256, level_encoder)
