"""Contrastive metrics: how often a positive scores above a negative of its group.

Rules: rows with a null score, flag or group take no part; a tie is a loss; NaN neither beats nor is beaten, but counts;
groups without both kinds are left out; a group's value is the share of (positive, negative) pairs won; the result is the
mean over groups, 0.0 without any.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.operators.selection import median

#: Score ranges that a large group is split into, so that one group's ranks are found in many tasks, and the different scores that
#: make a group large.
RANGES, LARGE = 64, 4096


def _clean(df: DataFrame, score: str, positive: str, keys: list[str]) -> DataFrame:
    known = df.select(*keys, F.col(positive).alias("_pos"), F.col(score).cast("double").alias("_score"))
    return known.where(" AND ".join(f"`{c}` IS NOT NULL" for c in [*keys, "_pos", "_score"]))


def group_accuracy(df: DataFrame, score: str, positive: str, keys: list[str], collapsed: bool = False) -> DataFrame:
    """Per group: n_pos, n_neg, won (pairs), accuracy; ``collapsed`` counts equal positives once and NaN above all numbers.

    Equal scores are summed first; ranks come from a running sum inside (group, score range) and the totals of the ranges
    below. Ranges are the quantiles of a large group's own scores, so no group meets in one task, however large it is or near
    its scores are; a group of few scores is one range.
    """
    clean = _clean(df, score, positive, keys)
    sums = [F.sum(F.col("_pos").cast("long")).alias("p"), F.sum((~F.col("_pos")).cast("long")).alias("n")]
    tied = clean.groupBy(*keys, "_score").agg(*sums)
    if collapsed:
        tied = tied.withColumn("p", F.least("p", F.lit(1)))
    numbers = tied.where(~F.isnan("_score")).select(*keys, "_score")
    large = numbers.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > LARGE).drop("_n")
    quantiles = F.percentile_approx("_score", [k / RANGES for k in range(1, RANGES)], 2000).alias("_edges")
    edges = numbers.join(large, keys, "left_semi").groupBy(*keys).agg(quantiles)
    part = F.size(F.filter(F.array_distinct(F.coalesce("_edges", F.array().cast("array<double>"))), lambda e: F.col("_score") > e))
    last = F.lit(RANGES) if collapsed else F.lit(-1)
    ranged = tied.join(edges, keys, "left").withColumn("_range", F.when(F.isnan("_score"), last).otherwise(part)).drop("_edges")
    here = Window.partitionBy(*keys, "_range").orderBy("_score").rowsBetween(Window.unboundedPreceding, -1)
    below = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    won = F.when(F.col("_range") >= 0, F.col("p") * F.coalesce(F.sum("n").over(here), F.lit(0))).otherwise(0)
    per_range = ranged.withColumn("w", won).groupBy(*keys, "_range").agg(*(F.sum(c).alias(c) for c in ("p", "n", "w")))
    lower = F.coalesce(F.sum(F.when(F.col("_range") >= 0, F.col("n")).otherwise(0)).over(below), F.lit(0))
    per_group = per_range.withColumn("w", F.col("w") + F.when(F.col("_range") >= 0, F.col("p") * lower).otherwise(0)).groupBy(*keys)
    out = per_group.agg(F.sum("p").alias("n_pos"), F.sum("n").alias("n_neg"), F.sum("w").alias("won")).where("n_pos > 0 AND n_neg > 0")
    return out.withColumn("accuracy", F.col("won").cast("double") / (F.col("n_pos") * F.col("n_neg")))


def _mean(groups: DataFrame) -> DataFrame:
    return groups.agg(F.coalesce(F.avg("accuracy"), F.lit(0.0)).alias("accuracy"), F.count("*").alias("n_groups"))


def discrimination_accuracy(df: DataFrame, score: str, positive: str = "positive", group: str = "group_id") -> DataFrame:
    return _mean(group_accuracy(df, score, positive, [group]))


def discrimination_accuracy_pairs(df: DataFrame, score: str, positive: str = "positive", group: str = "group_id") -> DataFrame:
    """The same by joining the pairs; for small groups, and as a check of the ranks."""
    clean = _clean(df, score, positive, [group])
    pos, neg = (clean.where(c).select(group, F.col("_score").alias(n)) for c, n in ((F.col("_pos"), "p"), (~F.col("_pos"), "n")))
    wins = (F.col("p") > F.col("n")) & ~F.isnan("p") & ~F.isnan("n")
    return _mean(pos.join(neg, group).groupBy(group).agg(F.avg(wins.cast("double")).alias("accuracy")))


def collapsed_accuracy(df: DataFrame, score: str, positive: str = "positive", group: str = "group_id") -> DataFrame:
    """A variant: equal positives of a group count once, and NaN is above all numbers."""
    return _mean(group_accuracy(df, score, positive, [group], collapsed=True))


def accuracy_by(df: DataFrame, category: str, score: str, positive: str = "positive", group: str = "group_id") -> DataFrame:
    """(category, accuracy, n_groups); a category without a full group has 0.0."""
    groups = group_accuracy(df, score, positive, [category, group]).groupBy(category).agg(F.avg("accuracy").alias("a"), F.count("*").alias("n"))
    every = df.where(F.col(category).isNotNull()).select(category).distinct()
    return every.join(groups, category, "left").select(category, F.coalesce("a", F.lit(0.0)).alias("accuracy"), F.coalesce("n", F.lit(0)).alias("n_groups"))


def score_summary(df: DataFrame, score: str) -> DataFrame:
    """Counts of rows, scored and missing; min, interpolated median, max, mean, and both standard deviations.

    The median is exact, from counts of ranges when the plan is built, so that no task holds the distinct scores.
    """
    s = F.col(score).cast("double")
    return df.agg(
        F.count("*").alias("total"), F.count(s).alias("scored"), (F.count("*") - F.count(s)).alias("missing"),
        F.min(s).alias("min"), F.lit(median(df, score)).cast("double").alias("median"), F.max(s).alias("max"), F.avg(s).alias("mean"),
        F.stddev_samp(s).alias("std_samp"), F.stddev_pop(s).alias("std_pop"),
    )


def n_unique(column: Column) -> Column:
    """Distinct values, null counting as one."""
    return F.count_distinct(column) + F.coalesce(F.max(column.isNull().cast("int")), F.lit(0))


def group_column(df: DataFrame) -> str:
    """group_id, or word_id in older tables."""
    return "group_id" if "group_id" in df.columns else "word_id"


def accuracy_report(df: DataFrame, scores: tuple[str, ...] = ("log_prob", "log_prob_norm"), positive: str = "positive", category: str = "voice") -> DataFrame:
    """(score, category, accuracy, n_groups): each score over all rows (a null category) and by category.

    Scores that the table lacks are left out, and so are categories where it has none. The group is group_id, or word_id.
    """
    group = group_column(df)
    kind = dict(df.dtypes).get(category, "string")
    parts = []
    for s in (s for s in scores if s in df.columns):
        parts.append(discrimination_accuracy(df, s, positive, group).select(F.lit(s).alias("score"), F.lit(None).cast(kind).alias(category), "accuracy", "n_groups"))
        if category in df.columns:
            parts.append(accuracy_by(df, category, s, positive, group).select(F.lit(s).alias("score"), category, "accuracy", "n_groups"))
    if not parts:
        raise ValueError(f"the table has none of the scores {list(scores)}")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
