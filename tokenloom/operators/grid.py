"""Summaries of hyper-parameter grids from a loss log (config, seed, kind, step, loss).

Null losses are left out of means; a run without a kind of loss has null for it; a step logged twice takes the larger loss
at a milestone; an empty log gives no rows. Further columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tokenloom.operators.positions import _free
from tokenloom.session import cut

MILESTONES = (100, 500)


def run_results(log: DataFrame) -> DataFrame:
    """Per (config, seed): losses at the milestones (null if not logged), and the last train and eval losses."""
    train, held = F.col("kind") == "train", F.col("kind") == "eval"
    return log.groupBy("config", "seed").agg(
        *(F.max(F.when(train & (F.col("step") == m), F.col("loss"))).alias(f"loss_{m}") for m in MILESTONES),
        F.max_by(F.when(train, F.col("loss")), F.when(train, F.col("step"))).alias("final_train_loss"),
        F.max_by(F.when(held, F.col("loss")), F.when(held, F.col("step"))).alias("final_eval_loss"),
    )


def grid_summary(results: DataFrame) -> DataFrame:
    """Per config: means and population deviations over seeds, ranked by mean eval loss, null last.

    Ties are ranked by the first run where results tell ``run``, else by name. Where they tell ``elapsed`` and ``n_params``,
    the mean time and the first run's parameters follow.
    """
    names = [*(f"loss_{m}" for m in MILESTONES), "final_train_loss", "final_eval_loss"]
    sums = [f(c).alias(f"{c}_{n}") for c in names for f, n in ((F.avg, "mean"), (F.stddev_pop, "std"))]
    first = F.col("run") if "run" in results.columns else F.col("seed")
    more = [F.avg("elapsed").alias("elapsed_mean")] if "elapsed" in results.columns else []
    more += [F.min_by("n_params", first).alias("n_params")] if "n_params" in results.columns else []
    seen = [F.min("run").alias("_seen")] if "run" in results.columns else [F.lit(0).alias("_seen")]
    out = results.groupBy("config").agg(*sums, F.count("*").alias("n_seeds"), *more, *seen)
    # one row for each configuration: a grid is small
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.col("final_eval_loss_mean").asc_nulls_last(), "_seen", "config"))).drop("_seen")


def seed_detail(results: DataFrame, summary: DataFrame) -> DataFrame:
    """Every run with its configuration's rank; ``place`` orders them by rank, then seed."""
    ranked = results.join(summary.select("config", "rank"), "config")
    return ranked.withColumn("place", F.row_number().over(Window.orderBy("rank", "seed")))


#: The grid's configurations and the sizes of its models.
CONFIGS = (
    ("paper_default", "large", 1e-4, 0.98, 0.01, 0.0),
    ("optimal", "small", 1e-2, 0.99, 0.0, 5.0),
    ("opt-low_lr", "small", 1e-4, 0.99, 0.0, 5.0),
    ("opt-no_clip", "small", 1e-2, 0.99, 0.0, 0.0),
    ("opt-with_wd", "small", 1e-2, 0.99, 0.01, 5.0),
    ("opt-beta2_98", "small", 1e-2, 0.98, 0.0, 5.0),
    ("large-opt_train", "large", 1e-2, 0.99, 0.0, 5.0),
    ("small-paper_tr", "small", 1e-4, 0.98, 0.01, 0.0),
)
SEEDS = (42, 123, 456)


def configurations(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(CONFIGS), "config string, model string, lr double, beta2 double, wd double, grad_norm double")


def with_configuration(summary: DataFrame, configs: DataFrame | None = None) -> DataFrame:
    """A summary with its configurations' settings; an unknown configuration is an error, not a lost row."""
    known = configurations(summary.sparkSession) if configs is None else configs
    found = F.coalesce(F.col("model"), F.raise_error(F.concat(F.lit("no configuration "), F.col("config"))).cast("string"))
    return summary.join(known, "config", "left").withColumn("model", found)


def read_log(lines: DataFrame, text: str = "value", accumulate: int = 1) -> DataFrame:
    """(config, seed, kind, step, loss) of a trainer's JSON lines (config, seed, rank, step, loss, eval_loss).

    A line may hold either loss or both; lines of other ranks than 0 and lines without a loss give nothing. Train losses are
    divided by the accumulation steps, eval losses are not.
    """
    line = F.from_json(text, "config string, seed int, rank int, step bigint, loss double, eval_loss double")
    flat = lines.select(line.alias("l")).where("coalesce(l.rank, 0) = 0")
    kinds = F.array(
        F.struct(F.lit("train").alias("kind"), normalised(F.col("l.loss"), F.lit(accumulate)).alias("loss")),
        F.struct(F.lit("eval").alias("kind"), F.col("l.eval_loss").alias("loss")),
    )
    long = flat.select("l.config", "l.seed", "l.step", F.explode(kinds).alias("k"))
    return long.where("k.loss IS NOT NULL AND step IS NOT NULL").select("config", "seed", "k.kind", "step", "k.loss")


def normalised(loss: Column, accumulate: Column) -> Column:
    """A train loss that was summed over accumulation steps, for one of them."""
    return loss / accumulate


def raw_results(log: DataFrame) -> DataFrame:
    """(config, seed, json): the losses of each run by step, as JSON with steps as texts; a step logged twice keeps its last."""
    once = log.groupBy("config", "seed", "kind", "step").agg(F.max_by("loss", F.struct("step", "loss")).alias("loss"))
    by_kind = lambda k: F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("kind") == k, F.struct("step", "loss")))))
    maps = once.groupBy("config", "seed").agg(by_kind("train").alias("train_losses"), by_kind("eval").alias("eval_losses"))
    return maps.select("config", "seed", F.to_json(F.struct("config", "seed", "train_losses", "eval_losses")).alias("json"))


def plan_runs(spark: SparkSession, configs: list[str] | None = None, seeds: list[int] | None = None) -> DataFrame:
    """Every configuration with every seed, the grid's own unless given: two short lists, not data."""
    configs, seeds = configs or [c[0] for c in CONFIGS], seeds or list(SEEDS)
    return spark.createDataFrame([(c, s) for s in seeds for c in configs], "config string, seed int")


def with_seeds(configs: DataFrame, seeds: list[int] | None = None) -> DataFrame:
    """Every row of a table of configurations with every seed of a short list, without a join."""
    return configs.withColumn("seed", F.explode(F.array(*(F.lit(s) for s in seeds or SEEDS))))


def early_stop(log: DataFrame, keys: list[str], patience: int = 3) -> DataFrame:
    """Per key: the first step that ends ``patience`` evaluations without a new lowest loss, and the best loss so far.

    Steps are dealt by ranges of (keys, step), so a long log of one key lies in many tasks; each finds its own, and a row for
    each key and range tells what came before: the lowest loss, the number of rows, and where the last improvement was.
    """
    part = _free(log, "_part")
    parts = int(log.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(log.select(*keys, "step", "loss").repartitionByRange(parts, *keys, "step").withColumn(part, F.spark_partition_id()))
    here = Window.partitionBy(*keys, part).orderBy("step")
    earlier = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    first, at = here.rowsBetween(Window.unboundedPreceding, -1), [*keys, part]

    def with_earlier(rows: DataFrame, **found: tuple[Column, Column]) -> DataFrame:
        """Add, for each name, what a first aggregate of each range and a second one over the ranges before make of it."""
        ranges = rows.groupBy(*at).agg(*(a.alias(n) for n, (a, _) in found.items()))
        ranges = ranges.select(*at, *(then.over(earlier).alias(n) for n, (_, then) in found.items()))
        own = {c: f"_of_{c}" for c in at}
        same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(k)) for c, k in own.items()))
        return rows.join(ranges.withColumnsRenamed(own), same).drop(*own.values())

    rows = with_earlier(dealt, _low=(F.min("loss"), F.min("_low")), _rows=(F.count("*"), F.sum("_rows")))
    before = F.least(F.min("loss").over(first), F.col("_low"))
    rows = rows.withColumn("_before", before).withColumn("_at", F.row_number().over(here) + F.coalesce("_rows", F.lit(0)))
    better = F.when(F.col("_before").isNull() | (F.col("loss") < F.col("_before")), F.col("_at"))
    rows = with_earlier(rows.withColumn("_better", better), _last=(F.max("_better"), F.max("_last")))
    last = F.greatest(F.max("_better").over(here), F.col("_last"))
    stale = rows.withColumn("_stale", F.col("_at") - last).where(F.col("_stale") == patience).withColumn("_best", F.least("_before", "loss"))
    return stale.groupBy(*keys).agg(F.min("step").alias("stop_step"), F.min_by("_best", "step").alias("best_loss"))


def throughput(steps: Column, elapsed: Column, per_device: Column, accumulate: Column, devices: Column, block: int = 2048) -> Column:
    """Tokens a second."""
    return steps / elapsed * per_device * accumulate * devices * block


def batch_rule(vocab: Column) -> Column:
    """(per device, accumulate): large vocabularies take half the batch, twice as often."""
    return F.when(vocab > 1000, F.struct(F.lit(16).alias("batch"), F.lit(8).alias("accumulate"))).otherwise(F.struct(F.lit(32).alias("batch"), F.lit(4).alias("accumulate")))


def parameter_count(shapes: Column) -> Column:
    """The number of parameters of arrays of dimensions: products, summed; a scalar has one, an empty list none."""
    return F.aggregate(F.transform(shapes, lambda s: F.aggregate(s, F.lit(1).cast("long"), lambda a, n: a * n)), F.lit(0).cast("long"), lambda a, n: a + n)


def megabytes(parameters: Column, half: Column) -> Column:
    """Memory of the parameters, with two bytes each in half precision, else four."""
    return parameters * F.when(half, 2).otherwise(4) / F.lit(1024.0 * 1024.0)
