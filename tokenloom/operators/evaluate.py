"""Scored tables as files: metadata, cached scores, and folders of one result file for each model.

Values are read by name from CSV with a header; an empty field is null. Empty tables keep their header.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.functions.names import model_info, stem
from tokenloom.operators.metrics import group_accuracy, group_column

#: Types of the columns of scored tables; others stay text.
TYPES = {"positive": "boolean", "log_prob": "double", "log_prob_norm": "double", "num_tokens": "bigint"}


def read_scored(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.option("header", True).csv(path)
    return raw.select(*(F.col(f"`{c}`").try_cast(TYPES[c]).alias(c) if c in TYPES else F.col(f"`{c}`") for c in raw.columns))


def write_scored(df: DataFrame, path: str) -> None:
    """CSV with a header; binary columns (the audio itself) are left out."""
    df.select(*(c for c, t in df.dtypes if t != "binary")).write.mode("overwrite").option("header", True).csv(path)


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def fingerprint(*inputs: DataFrame) -> str:
    """A digest of what tables are read from: the names, sizes and times of their files, and their plans where there are none."""
    digest = hashlib.sha256()
    for df in inputs:
        names = sorted(df.inputFiles())
        for name in names:
            p, fs = _path(df.sparkSession, unquote(name))
            s = fs.getFileStatus(p)
            digest.update(f"{name}:{s.getLen()}:{s.getModificationTime()}\n".encode())
        if not names:
            digest.update(str(df.semanticHash()).encode())
    return digest.hexdigest()


_PRINT = "_fingerprint"


def _kept(spark: SparkSession, path: str, wanted: str | None) -> bool:
    """Whether a table is there, written to its end, and of the wanted inputs. A file by itself is one that was put there."""
    where, fs = _path(spark, path)
    if not fs.exists(where):
        return False
    if fs.getFileStatus(where).isFile():
        return wanted is None
    if not fs.exists(_path(spark, f"{path}/_SUCCESS")[0]):
        return False
    stored = _path(spark, f"{path}/{_PRINT}")[0]
    if wanted is None:
        return True
    return fs.exists(stored) and _read_text(spark, stored, fs) == wanted


def _read_text(spark: SparkSession, path, fs) -> str:
    with_utf8 = spark._jvm.java.io.InputStreamReader(fs.open(path), "UTF-8")
    reader = spark._jvm.java.io.BufferedReader(with_utf8)
    try:
        return reader.readLine() or ""
    finally:
        reader.close()


def scored_once(spark: SparkSession, path: str, make: Callable[[], DataFrame], force: bool = False, inputs: tuple[DataFrame, ...] = ()) -> DataFrame:
    """The scored table at a path: read if it is there, else (or if forced) made and written first.

    It is there once a write has succeeded, and only for the same inputs, if they are given: what a failed write has left, or
    a table made from files that have changed since, is made anew. Overwriting takes the marks of the table before away first.
    """
    wanted = fingerprint(*inputs) if inputs else None
    if force or not _kept(spark, path, wanted):
        write_scored(make(), path)
        if wanted:
            where, fs = _path(spark, f"{path}/{_PRINT}")
            out = fs.create(where, True)
            try:
                out.write(bytearray(wanted.encode()))
            finally:
                out.close()
    return read_scored(spark, path)


def result_files(spark: SparkSession, folder: str) -> list[str]:
    """The .csv files or folders directly in a folder."""
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().toString() for s in fs.listStatus(where) if s.getPath().getName().endswith(".csv"))


def files_by_header(spark: SparkSession, paths: list[str]) -> dict[str, list[str]]:
    """The CSV files (also those inside folders) of each header line, from one scan; files without a line are left out.

    The driver gets the names of the files, one for each model, and the few headers that they have.
    """
    if not paths:
        return {}
    lines = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("begin"), F.monotonically_increasing_id().alias("at"))
    first = lines.where("begin = 0").groupBy("file").agg(F.min_by("value", "at").alias("head"))
    out: dict[str, list[str]] = {}
    for r in first.orderBy("file").collect():
        out.setdefault(r["head"], []).append(r["file"])
    return out


def model_results(spark: SparkSession, folder: str, score: str = "log_prob_norm") -> DataFrame:
    """encoder, arch, size, accuracy, filename: one row for each result file of a known architecture.

    Files that can't be read, or lack the score or the flag, are skipped. Files of one header are one scan, so the plan has a
    branch for each of a few headers, however many models there are.
    """
    schema = "path string, group_id string, positive boolean, score double"
    every = spark.createDataFrame([], schema)
    for files in files_by_header(spark, result_files(spark, folder)).values():
        df = spark.read.option("header", True).csv([unquote(f) for f in files])
        if score not in df.columns or "positive" not in df.columns or group_column(df) not in df.columns:
            continue
        own = F.col("_metadata.file_path")
        path = F.when(F.substring_index(own, "/", -2).rlike(r"\.csv/"), F.regexp_replace(own, "/[^/]*$", "")).otherwise(own)
        every = every.union(df.select(F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))).alias("path"), F.col(group_column(df)).alias("group_id"), F.col("positive").try_cast("boolean"), F.col(score).try_cast("double")))
    known = every.select("path").distinct().select("path", stem(F.col("path")).alias("filename"))
    known = known.select("*", *(c.alias(k) for k, c in model_info(F.col("filename")).items())).where(F.col("arch").isin("lstm", "gpt2"))
    accuracy = group_accuracy(every, "score", "positive", ["path", "group_id"]).groupBy("path").agg(F.avg("accuracy").alias("accuracy"))
    return known.join(accuracy, "path", "left").select("encoder", "arch", "size", F.coalesce("accuracy", F.lit(0.0)).alias("accuracy"), "filename")
