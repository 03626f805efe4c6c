"""A training-data pipeline over ``documents``: each stage is written as Parquet and read again by the next.

toxicity drops what it predicts toxic; quality drops what the rules reject; near_duplicates keeps one document of each
group, on shingles of five words at a similarity of 0.8; pii replaces personal data in the texts; packing returns where
each document goes: doc_id, n_tokens, bucket, bucket_len, batch, slot, padding.

Defined results of the whole: texts that are null, empty or of fewer than 20 words fail the quality rules and go; very long
texts are judged whole; fully equal rows of one id stay or go as one, and each that stays gets a slot; an id on several
texts stays only with all of them; rows with a null id are judged and never counted as copies; an empty table gives no
rows; columns of documents beyond COLUMNS, clashing names or not, are left out by the first stage. Each stage says below
what it does with its own input.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.llm import minhash, packing, pii, quality, toxicity
from tokenloom.llm.common import checkpoint_dir, documents, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows predicted not toxic, on whole texts; null and empty texts score as an empty window and stay. Without
    labels of both kinds, rows go only if all labels are 1.
    """
    return toxicity.keep_civil(docs, table(spark, sf_dir, "labels")).select(*COLUMNS)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that keep the base rules and the threshold table; null, empty and short texts go."""
    return quality.keep_good(docs).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row of the smallest id of each group of texts alike in 80 % of their shingles of five words;
    texts without words and null ids stay.
    """
    return minhash.keep_one(docs).select(*COLUMNS)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, personal data replaced by its kind in brackets, n_chars counted anew; null texts stay null, with a null
    count.
    """
    return pii.redact(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A slot for every row, repeated ones too; a null or empty text has length 0."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_rules", drop_poor),
    ("near_duplicates", drop_near_duplicates),
    ("pii", hide_personal_data),
    ("packing", pack),
]

#: SQL can't express the network of the first stage; tests hold every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what they write lies in the session's shared folder."""
    docs, home = documents(spark, sf_dir), f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{home}/{name}")
        docs = spark.read.parquet(f"{home}/{name}")
    return docs
