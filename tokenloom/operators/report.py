"""Model comparison: an ordered table with the places of bars.

Names of no known architecture, null ones too, are left out; repeated names each have a bar; null accuracies stay null; an
empty table gives no bars.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.functions.names import model_info
from tokenloom.operators.positions import with_running


def compare(results: DataFrame, name: str = "filename", known: tuple[str, ...] = ("lstm", "gpt2")) -> DataFrame:
    """encoder, arch, size and accuracy of the models of known architectures."""
    info = model_info(F.col(name))
    return results.select(*(c.alias(k) for k, c in info.items()), "accuracy", name).where(F.col("arch").isin(*known))


def bar_positions(models: DataFrame) -> DataFrame:
    """Order lstm before gpt2, then encoder and size; x grows by 1, by 1.25 where the next bar changes architecture.

    Places are global positions by ranges of the order. There are two architectures, so x follows from the place and the
    number of bars of the first: no window spans the table.
    """
    first = (F.col("arch") != "lstm").cast("int")
    placed = with_running(models.withColumn("_second", first), ["_second", "encoder", "size", "filename"], name="_place")
    any_first = bool(models.where(F.col("arch") == "lstm").head(1))
    gap = F.when((F.col("_second") == 1) & F.lit(any_first), 0.25).otherwise(0.0)
    return placed.withColumn("x", F.col("_place") + gap).withColumn("place", (F.col("_place") + 1).cast("int")).drop("_place", "_second")
