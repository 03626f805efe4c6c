"""Global positions without a single-task window, and what is built on them: shards and prefix sums.

Rows with a null in the order come first, as Spark sorts them. Rows of equal order get neighbouring positions in an order of
no meaning; fully equal rows each get their own. An empty table gives no rows. Columns may have any names but that of the
result, which is refused.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.session import cut


def _free(df: DataFrame, name: str, *more: str) -> str:
    """A column name that ``df`` does not have, and that is none of ``more``."""
    taken = {c.lower() for c in [*df.columns, *more]}
    while name.lower() in taken:
        name += "_"
    return name


def _sums(keys: DataFrame, order: list[str], size: str, name: str) -> DataFrame:
    """Add the sum of ``size`` over all rows before to a narrow table.

    Rows are range-partitioned by the order and checkpointed; each partition is summed on its own, and the sums of the
    partitions before it, one number for each partition, are added.
    """
    part = _free(keys, "_part")
    parts = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut(keys.repartitionByRange(parts, *order).withColumn(part, F.spark_partition_id()))
    totals = {r[part]: r["n"] for r in placed.groupBy(part).agg(F.sum(size).alias("n")).collect()}
    starts = [0, *accumulate(totals.get(i, 0) or 0 for i in range(max(totals, default=0)))]
    within = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(size).over(within), F.lit(0)) + F.get(F.array(*(F.lit(s).cast("long") for s in starts)), F.col(part))
    return placed.withColumn(name, before).drop(part)


def _met(df: DataFrame, found: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Rows with the column ``name`` that was found for their keys; null keys are alike."""
    own = {c: _free(df, f"_of_{c}") for c in keys}
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(k)) for c, k in own.items()))
    return df.join(found.select(*(F.col(c).alias(k) for c, k in own.items()), name), same).drop(*own.values())


def with_running(df: DataFrame, order: list[str], size: Column | None = None, name: str = "position") -> DataFrame:
    """Add the sum of ``size`` over all rows before, in the order; with no size, the row's position from 0.

    Only the order and the size are range-partitioned and checkpointed; further columns, however wide, are shuffled once, to
    meet their sums.
    """
    if name.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"the table has a column {name} already")
    weight, place, mark = (_free(df, n, name) for n in ("_size", "_place", "_mark"))
    others = [c for c, t in df.dtypes if c not in order and "map<" not in t]
    sized = df.withColumn(weight, (F.lit(1) if size is None else size).cast("long"))
    if set(df.columns) <= set(order):
        return _sums(sized, order, weight, name).select(*df.columns, name)
    # rows of equal order are told apart by a hash of the others, so that only rows equal in all meet in one task
    marked = sized.withColumn(mark, F.xxhash64(weight, *others))
    tie = Window.partitionBy(*order, mark).orderBy(weight)
    placed = marked.withColumn(place, F.row_number().over(tie))
    summed = _sums(placed.select(*order, mark, place, weight), [*order, mark, place], weight, name).drop(weight)
    return _met(placed, summed, [*order, mark, place], name).select(*df.columns, name)


def within(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """Add the row's place in its group, from 1, without a task that holds a whole group."""
    at = _free(df, "_at")
    placed = with_running(df, [*keys, *order], name=at)
    first = placed.groupBy(*keys).agg(F.min(at).alias(name))
    return _met(placed, first, keys, name).withColumn(name, F.col(at) - F.col(name) + 1).select(*df.columns, name)


def strided(df: DataFrame, order: list[str], tasks: int, task: int) -> DataFrame:
    """Rows whose position leaves the remainder ``task``."""
    return with_running(df, order).where(F.col("position") % tasks == task)


def contiguous(df: DataFrame, order: list[str], tasks: int) -> DataFrame:
    """Add ``task``: equal runs of the order, the remainder to the last; with fewer rows than tasks, all rows to the last."""
    ranked = with_running(df, order)
    chunk = ranked.count() // tasks
    if not chunk:
        return ranked.withColumn("task", F.lit(tasks - 1).cast("long"))
    return ranked.withColumn("task", F.least(F.floor(F.col("position") / chunk), F.lit(tasks - 1)).cast("long"))


def task_shard(df: DataFrame, order: list[str], column: str, tasks: int, task: int) -> tuple[int, int, Iterator]:
    """(rows in all, rows of a task's contiguous shard, its values of one column in the order), fetched a partition at a time."""
    every = contiguous(df, order, tasks)
    own = every.where(F.col("task") == task)
    return every.count(), own.count(), (r[0] for r in own.orderBy("position").select(column).toLocalIterator())
