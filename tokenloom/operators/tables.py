"""Manifests, pair tables, token look-ups and row status.

Nulls, empty tables: manifests keep null paths; a look-up gives null for a null key; empty tables stay empty with their
columns. Repeated rows stay, except of stored values, where the last counts. Columns that clash in a look-up are refused by
Spark as ambiguous only if read; the key and the value are the only columns taken from the stored side.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tokenloom.functions.names import eta, file_name, parent, sample_key


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def resolve_manifest(spark: SparkSession, name: str, folder: str) -> str:
    """An existing path, or the .csv or .parquet of that name in the folder."""
    for path in (name, f"{folder}/{name}.csv", f"{folder}/{name}.parquet"):
        if _exists(spark, path):
            return path
    raise FileNotFoundError(f"no manifest {name} in {folder}")


def adapt_manifest(df: DataFrame, prefer_path: bool = False) -> DataFrame:
    """``path`` serves as ``audio_filepath``: where that is missing, or always if preferred; required columns are checked."""
    if "path" in df.columns and ("audio_filepath" not in df.columns or prefer_path):
        df = df.drop("audio_filepath").withColumnRenamed("path", "audio_filepath")
    if missing := {"file_id", "audio_filepath"} - set(df.columns):
        raise ValueError(f"the manifest lacks {sorted(missing)}")
    return df


def load_manifest(spark: SparkSession, path: str, schema: StructType | str | None = None, prefer_path: bool = False) -> DataFrame:
    """A manifest of either format; of the columns path and audio_filepath the second counts, or the first if preferred."""
    if path.endswith(".csv"):
        reader = spark.read.option("header", True)
        return adapt_manifest((reader.schema(schema) if schema else reader).csv(path), prefer_path)
    if path.endswith(".parquet"):
        return adapt_manifest(spark.read.parquet(path), prefer_path)
    raise ValueError(f"manifests are .csv or .parquet, not {path}")


def load_rows(spark: SparkSession, path: str) -> DataFrame:
    """CSV with all values as strings, or JSON lines."""
    if path.endswith(".csv"):
        return spark.read.option("header", True).csv(path)
    if path.endswith((".jsonl", ".json")):
        return spark.read.json(path)
    raise ValueError(f"rows are .csv, .jsonl or .json, not {path}")


def save_rows(frames: list[DataFrame], path: str) -> None:
    """CSV or JSON lines with the union of the columns, in the order first seen; without frames, nothing is written."""
    if not frames:
        return
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    if path.endswith(".csv"):
        out.write.mode("overwrite").option("header", True).csv(path)
    elif path.endswith(".jsonl"):
        out.write.mode("overwrite").json(path)
    else:
        raise ValueError(f"rows are saved as .csv or .jsonl, not {path}")


def unpivot_pairs(df: DataFrame, fields: list[str], id_col: str = "id", nested: dict[str, str] | None = None) -> DataFrame:
    """Two rows of each pair, from one scan: group_id, file_id, the fields, voice, positive.

    A field f comes from positive_f and negative_f; ``nested`` names further ones and the member of the structs positive
    and negative that each comes from. Null values stay; a null voice makes a null file_id; repeated pairs come repeated.
    """

    def side(name: str, flag: bool) -> Column:
        own = [F.col(f"{name}_{f}").alias(f) for f in fields] + [F.col(f"{name}.{m}").alias(f) for f, m in (nested or {}).items()]
        return F.struct(*own, F.lit(flag).alias("positive"))

    long = df.select(F.col(id_col).alias("group_id"), "voice", F.explode(F.array(side("positive", True), side("negative", False))).alias("s"))
    flat = long.select("group_id", "voice", "s.*")
    return flat.withColumn("file_id", sample_key(F.col("group_id"), F.col("voice"), F.col("positive")))


def latest(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """One row for each key: the value that comes last in the order."""
    return df.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(value))


def look_up(meta: DataFrame, tokens: DataFrame, key: str, order: list[str], value: str = "tokens") -> DataFrame:
    """Every row of ``meta`` once, with the last value stored under its key, or null."""
    return meta.join(latest(tokens, key, order, value), key, "left")


#: What becomes of a row, in the order in which the reasons are looked at; the last are found when a good row is stored.
STATUSES = ("error_read", "error_empty", "skipped_short", "error_encode", "error_no_tokens", "ok", "error_store")


def status(n_samples: Column, rate: Column, tokens: Column, min_seconds: float = 3.0) -> Column:
    """The first reason to skip a row, or ok: no samples, too short (strictly), no encoding, no tokens."""
    return (
        F.when(n_samples <= 0, "error_empty")
        .when(n_samples / rate < min_seconds, "skipped_short")
        .when(tokens.isNull(), "error_encode")
        .when(F.size(tokens) == 0, "error_no_tokens")
        .otherwise("ok")
    )


def save_manifest(df: DataFrame, path: str) -> None:
    """file_id and audio_filepath by folder, then name: one CSV part in order, or for .txt one path a line."""
    by = df.orderBy(parent(F.col("audio_filepath")), file_name(F.col("audio_filepath")), "file_id")
    if path.endswith(".csv"):
        by.select("file_id", "audio_filepath").coalesce(1).write.mode("overwrite").option("header", True).csv(path)
    elif path.endswith(".txt"):
        by.select("audio_filepath").coalesce(1).write.mode("overwrite").text(path)
    else:
        raise ValueError(f"manifests are saved as .csv or .txt, not {path}")


def numbered(df: DataFrame, name: str = "line") -> DataFrame:
    """Add each row's number from 0 to the rows of one file as it is read, in however many parts: one count a part is collected."""
    at = F.monotonically_increasing_id()  # the part above 33 bits that count its rows
    counts = dict(df.groupBy(F.shiftright(at, 33).alias("part")).count().collect())
    starts = [0, *accumulate(counts.get(k, 0) for k in range(max(counts, default=0)))]
    first = F.get(F.array(*(F.lit(n).cast("long") for n in starts)), F.shiftright(F.col(name), 33).cast("int"))
    return df.withColumn(name, at).withColumn(name, first + F.col(name).bitwiseAND((1 << 33) - 1))


def progress(statuses: DataFrame, elapsed: float, total: int) -> DataFrame:
    """Counts of a column ``status`` as written, skipped_short and skipped_error, the rate a second, and hours and minutes to go."""
    s, ok = F.col("status"), F.count_if(F.col("status") == "ok")
    counts = statuses.agg(ok.alias("written"), F.count_if(s == "skipped_short").alias("skipped_short"), F.count_if(s.startswith("error")).alias("skipped_error"), F.count("*").alias("seen"))
    return _with_rate(counts, elapsed, total)


def progress_of(spark: SparkSession, counts: dict[str, int], elapsed: float, total: int) -> DataFrame:
    """The same from what a write has counted by status while it ran, without a pass of its own."""
    row = (counts.get("ok", 0), counts.get("skipped_short", 0), sum(n for s, n in counts.items() if s.startswith("error")), sum(counts.get(s, 0) for s in STATUSES))
    return _with_rate(spark.createDataFrame([row], "written bigint, skipped_short bigint, skipped_error bigint, seen bigint"), elapsed, total)


def _with_rate(counts: DataFrame, elapsed: float, total: int) -> DataFrame:
    rate = F.when(F.lit(elapsed) > 0, F.col("written") / F.lit(elapsed)).otherwise(0.0)
    left = F.when(F.col("rate") > 0, (F.lit(total) - F.col("seen")) / F.col("rate")).otherwise(0.0)
    return counts.withColumn("rate", rate).withColumn("_left", left).withColumns({"eta": eta(F.col("_left"))}).drop("_left")
