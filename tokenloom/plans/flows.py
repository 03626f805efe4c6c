"""Flows from audio to shards: bulk encoding of a manifest, and preparation of a benchmark of word pairs.

Each file is read, decoded and encoded once: one write deals rows to shards and, with the reason, to a table of errors, and
counts them by status on its way. Audio never leaves the task that reads it.

A null or unreadable file, or one that isn't there, is a row of status error_read; a null id, or one whose key can't be stored,
of error_store; repeated rows are encoded and counted each; empty tables write no shard and count nothing. The columns of the
input, whatever their names, stay beside those added, which must not be there yet.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tokenloom.operators import encoders, evaluate, tables
from tokenloom.operators.positions import _free
from tokenloom.sources import files, tar
from tokenloom.sources.store import Store

#: The shortest audio, in seconds, of bulk encoding and of a benchmark.
BULK_SECONDS, BENCHMARK_SECONDS = 3.0, 0.5
_ENCODED = "tokens array<smallint>, n_samples bigint, native_rate bigint, unread string, error string"


def _encoding(encoder: str, min_seconds: float, body: Callable[[object], bytes], options: dict):
    """A UDF from a column of files, as ``body`` gets their bytes, to tokens and what went wrong. One file is held at a time."""
    factory = encoders.factory(encoder)

    @F.pandas_udf(_ENCODED)
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = factory(**options)

        def one(value) -> tuple:
            try:
                x, n, rate = files.decode_at(bytes(body(value)), least=min_seconds)
            except Exception as e:  # a bad file is counted, not fatal
                return None, None, None, str(e)[:100] or type(e).__name__, None
            if not n or n / rate < min_seconds:
                return None, n, rate, None, None
            try:
                return np.asarray(model(x, files.RATE)).astype(np.int16).tolist(), n, rate, None, None
            except Exception as e:
                return None, n, rate, None, str(e)[:100] or type(e).__name__

        for values in batches:
            out = pd.DataFrame([one(v) for v in values], columns=[c.split()[0] for c in _ENCODED.split(", ")])
            yield out.astype({"n_samples": "Int64", "native_rate": "Int64"})

    return encode


def _encoded(df: DataFrame, of: Column, encoder: str, min_seconds: float, body: Callable[[object], bytes], options: dict) -> DataFrame:
    at = _free(df, "_encoded")
    done = df.withColumn(at, _encoding(encoder, min_seconds, body, options)(of))
    e = F.col(at)
    by_length = tables.status(e["n_samples"], e["native_rate"], e["tokens"], min_seconds)
    status = F.when(e["unread"].isNotNull(), "error_read").otherwise(by_length)
    return done.select(*df.columns, e["n_samples"].alias("n_samples"), e["native_rate"].alias("native_rate"), e["tokens"].alias("tokens"), status.alias("status"), F.coalesce(e["unread"], e["error"]).alias("error"))


def encode_audio(df: DataFrame, encoder: str, min_seconds: float, content: str = "content", **options) -> DataFrame:
    """Rows with a binary column of audio files: add n_samples, native_rate, tokens, status and error; the files go."""
    return _encoded(df, F.col(content), encoder, min_seconds, lambda b: b, options).drop(content)


def encode_paths(df: DataFrame, path: str, root: str, encoder: str, min_seconds: float, store: str = "", **options) -> DataFrame:
    """The same for a column of paths below ``root``, each read by the task that encodes it, from any store."""

    homes: list[Store] = []  # made once in a worker

    def body(p: object) -> bytes:
        homes[:] = homes or [Store(root, store)]
        home, whole = homes[0], str(p)
        if not whole.startswith(home.at("")):
            whole = Store(whole, store).root
        if not whole.startswith(home.at("")):
            raise ValueError(f"the file is not below {root}")
        return home.read(whole[len(home.at("")) :])

    return _encoded(df, F.col(path), encoder, min_seconds, body, options)


def observed_status(df: DataFrame, silent: tuple[str, ...] = encoders.SILENT) -> tuple[DataFrame, Observation]:
    """The rows, and what one action over them will have counted: rows by status, and errors whose message a report leaves out."""
    seen = Observation()
    quiet = F.lit(False)
    for part in silent:
        quiet = quiet | F.coalesce(F.col("error").contains(part), F.lit(False))
    counts = [F.count_if(F.col("status") == s).alias(s) for s in tables.STATUSES]
    return df.observe(seen, *counts, F.count_if(quiet).alias("silenced"), F.count("*").alias("seen")), seen


def write_encoded(records: DataFrame, folder: str, **options) -> dict[str, int]:
    """Write rows (key, tokens, status, error, and meta and source if wanted) in one pass, the good ones to shards, the others to
    the folder's table of errors; returns the counts by status, ``silenced`` and ``seen``.
    """
    stored = F.col("key").isNotNull() & ~F.col("key").contains(".") & ~F.col("key").contains("/") & (F.col("key") != "")
    status = F.when((F.col("status") == "ok") & ~F.coalesce(stored, F.lit(False)), "error_store").otherwise(F.col("status"))
    rows, seen = observed_status(records.withColumn("status", status))
    tar.write_tokens(rows, folder, quarantine="true", **options)
    return dict(seen.get)


def _counts(spark: SparkSession, counts: dict[str, int]) -> DataFrame:
    return spark.createDataFrame([(s, counts[s]) for s in tables.STATUSES if counts[s]], "status string, n bigint")


def encode_manifest(spark: SparkSession, manifest: DataFrame, root: str, encoder: str, folder: str, min_seconds: float = BULK_SECONDS, store: str = "", **options) -> DataFrame:
    """Read and encode a manifest's files below ``root``, write shards of the good ones; returns (status, n).

    Only paths are dealt out, to as many tasks as there are shuffle partitions. A path without a file counts as error_read.
    """
    paths = manifest.select("file_id", "audio_filepath").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    done = encode_paths(paths, "audio_filepath", root, encoder, min_seconds, store, **options)
    records = tar.token_records(done, also=("status", "error", F.col("audio_filepath").alias("source")))
    return _counts(spark, write_encoded(records, folder, store=store))


def prepare_pairs(spark: SparkSession, pattern: str, encoder: str, folder: str, metadata: str, min_seconds: float = BENCHMARK_SECONDS, **options) -> DataFrame:
    """Word pairs with embedded audio to shards under plain keys, and their metadata as CSV; returns (status, n).

    The metadata has every sample, also those whose encoding was skipped.
    """
    pairs = tables.unpivot_pairs(spark.read.parquet(pattern), ["word", "phones"], nested={"audio_bytes": "bytes"})
    evaluate.write_scored(pairs.select("group_id", "file_id", "word", "phones", "voice", "positive", "audio_bytes"), metadata)
    done = encode_audio(pairs.select("file_id", "audio_bytes"), encoder, min_seconds, "audio_bytes", **options)
    records = done.select(F.col("file_id").alias("key"), "tokens", "status", "error", F.col("file_id").alias("source"))
    return _counts(spark, write_encoded(records, folder, naming="shard"))
