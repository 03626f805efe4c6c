"""Frames to tokens: nearest centroids."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Numbers of centroids that one broadcast holds; larger tables are searched in parts of this size, one after the other.
HELD = 4_000_000


def group_means(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(cluster, centroid): the mean vector of each key."""
    parts = df.where(F.col(key).isNotNull()).select(F.col(key).alias("cluster"), F.posexplode(vector).alias("i", "x"))
    means = parts.groupBy("cluster", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return means.groupBy("cluster").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("centroid"))


def _nearest(x: np.ndarray, table: np.ndarray, norms: np.ndarray, slack: float = 1e-9) -> tuple[np.ndarray, np.ndarray]:
    """The first of the nearest rows of ``table`` for each row of x, and its squared distance.

    The expansion of the square rounds, so all rows within its rounding bound of the least are compared directly.
    """
    square = (x * x).sum(1, keepdims=True)
    d = norms - 2 * x @ table.T + square
    near = d <= d.min(1, keepdims=True) + slack * (norms.max() + square)
    row, col = np.nonzero(near)
    exact = ((x[row] - table[col]) ** 2).sum(1)
    begins = np.flatnonzero(np.diff(row, prepend=-1))
    least = np.minimum.reduceat(exact, begins)
    first = np.minimum.reduceat(np.where(exact == np.repeat(least, np.diff(begins, append=len(row))), col, len(table)), begins)
    return first, least


def nearest_centroid(df: DataFrame, centroids: DataFrame, id_col: str, vector: str) -> DataFrame:
    """(id, cluster): the nearest by squared distance in double precision, ties to the smaller cluster.

    Null vectors and null centroids take no part, and neither do vectors whose length isn't that of the centroids; without
    centroids there are no rows. Repeated rows are quantised each; further columns are not read. Centroids are a model, but
    its size is checked: a table of more than HELD numbers is broadcast in parts, which a row meets one after the other.
    """
    table = centroids.where(F.col("centroid").isNotNull())
    n, dim = table.agg(F.count("*"), F.max(F.size("centroid"))).first()
    kind, most = dict(centroids.dtypes)["cluster"], max(1, HELD // max(1, dim or 1))
    begin = [F.col(id_col).alias("id"), F.col(vector).alias("v"), F.lit(None).cast(kind).alias("cluster"), F.lit(float("inf")).alias("distance")]
    found = df.where(F.col(vector).isNotNull() & (F.size(vector) == F.lit(dim or 0)) & F.lit(n > 0)).select(*begin)
    rows = table.orderBy("cluster").toLocalIterator()

    def improved(before: DataFrame, names: list, held: np.ndarray) -> DataFrame:
        shared = df.sparkSession.sparkContext.broadcast((names, held, (held**2).sum(1)))

        def run(frames):
            names, table, norms = shared.value
            for f in frames:
                for at in range(0, len(f), 1024):
                    g = f.iloc[at : at + 1024]
                    first, least = _nearest(np.stack([np.asarray(v, float) for v in g["v"]]), table, norms)
                    better = least < g["distance"].to_numpy()  # parts are in the order of the cluster, so an earlier one wins a tie
                    cluster = [names[i] if b else c for i, b, c in zip(first, better, g["cluster"], strict=True)]
                    yield g.assign(cluster=cluster, distance=np.where(better, least, g["distance"]))

        return before.mapInPandas(run, before.schema)

    for at in range(0, n, most):
        part = [next(rows) for _ in range(min(most, n - at))]
        found = improved(found, [r.cluster for r in part], np.array([r.centroid for r in part], float))
    return found.select(F.col("id").alias(id_col), "cluster")


def save_centroids(df: DataFrame, path: str, mode: str = "error") -> None:
    """Rows (model, k, cluster, centroid) as a table with a folder for each model and number of clusters."""
    df.select("cluster", "centroid", "model", "k").write.mode(mode).partitionBy("model", "k").parquet(path)


def load_centroids(spark: SparkSession, path: str, model: str, k: int) -> DataFrame:
    """(cluster, centroid) of one model and number of clusters, from its folder alone; a key that isn't there is an error."""
    found = spark.read.parquet(path).where((F.col("model") == model) & (F.col("k") == k)).select("cluster", "centroid")
    if not found.head(1):
        raise ValueError(f"there are no centroids of the model {model} with {k} clusters")
    return found
