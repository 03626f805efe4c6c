"""What several operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.session import checkpoint_dir, cut, table

__all__ = ["BLANKS", "WORD", "Steps", "checkpoint_dir", "cut", "documents", "fit_vector", "fold", "let", "split_words", "table"]

#: White space of the word rule, and the rule itself.
BLANKS = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


class Steps:
    """Tables between the steps of one run, as Parquet in the session's shared folder; they cut the lineage and survive lost executors."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.home = spark, f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def keep(self, name: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.home}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.home}/{name}")

    def drop(self, *names: str) -> None:
        """Delete tables that no later step reads."""
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.home}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(n).cast("bigint"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once for the row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def split_words(text: Column) -> Column:
    """The words of a text; an empty array for null or blank texts."""
    return let(
        F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS)),
        lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, r"[\x20\x09-\x0D]+", -1)),
    )


def fit_vector(df: DataFrame, column: str, zero: bool) -> tuple[Column, Column]:
    """A column of vectors as floats or doubles, and whether each is one: not null or empty, all components finite, and not all
    zero unless ``zero`` allows it.
    """
    kind = dict(df.dtypes)[column]
    v = F.col(column) if kind in ("array<float>", "array<double>") else F.col(column).cast("array<double>")
    fit = (F.size(v) > 0) & F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return v, F.coalesce(fit if zero else fit & F.exists(v, lambda x: x != 0), F.lit(False))
