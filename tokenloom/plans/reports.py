"""Queries of reports, grids, checkpoints and formats, with their SQL; importing this module adds them to the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.functions import names, sequences
from tokenloom.operators import blocks, checkpoints, grid, metrics, tables
from tokenloom.plans.catalog import _LOG, _RUNS, _SCORED, _SEQ, _STATS, _log_from_one, _pack_sql, _rounded, event_sequences, query, scored_events
from tokenloom.session import table


def normed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored events with a second score, as one divided by a length."""
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin("purchase", "signup", "error", "click"))
    return e.select(
        F.col("user_id").alias("word_id"), F.when(F.hour("ts") < 12, "AM").otherwise("PM").alias("voice"),
        F.col("event_type").isin("purchase", "signup").alias("positive"), F.col("value").alias("log_prob"),
        (F.col("value") / (F.col("event_id") % 7 + 1)).alias("log_prob_norm"),
    )


def _report_sql() -> str:
    base = _SCORED.replace("value AS v", "value AS r, value / (event_id % 7 + 1) AS n")
    parts = []
    for score, c in (("log_prob", "r"), ("log_prob_norm", "n")):
        won = f"avg(CASE WHEN p.{c} > q.{c} THEN 1.0 ELSE 0.0 END) AS a"
        parts.append(f"SELECT '{score}' AS score, NULL::VARCHAR AS voice, round(coalesce(avg(a), 0), 6) AS accuracy, count(*) AS n_groups FROM (SELECT p.g, {won} FROM s p JOIN s q ON p.g = q.g AND p.pos AND NOT q.pos GROUP BY p.g)")
        parts.append(f"SELECT '{score}', voice, round(avg(a), 6), count(*) FROM (SELECT p.voice, p.g, {won} FROM s p JOIN s q ON p.g = q.g AND p.voice = q.voice AND p.pos AND NOT q.pos GROUP BY p.voice, p.g) GROUP BY voice")
    return f"WITH {base} {' UNION ALL '.join(parts)}"


@query(_report_sql())
def accuracy_report(spark, sf_dir):
    return _rounded(metrics.accuracy_report(normed_events(spark, sf_dir)))


# --- grids ---------------------------------------------------------------------------------------------------------

_CONFIG = {"click": "optimal", "error": "opt-low_lr", "purchase": "paper_default", "signup": "opt-no_clip", "view": "large-opt_train"}
_CONFIG_SQL = "CASE r.config " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _CONFIG.items()) + " END"


def grid_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of runs with their time and size, under the grid's own configurations; ``run`` is the order they ended in."""
    log = _log_from_one(spark, sf_dir)
    times = log.groupBy("config", "seed").agg(F.count("*").cast("double").alias("elapsed"))
    renamed = F.coalesce(*(F.when(F.col("config") == k, v) for k, v in _CONFIG.items()))
    runs = grid.run_results(log).join(times, ["config", "seed"])
    run = F.col("seed") * 10 + F.length("config")
    return runs.withColumn("run", run).withColumn("n_params", F.lit(1000) + F.col("seed")).withColumn("config", renamed)


_GRID = f"""{_RUNS}, t AS (SELECT config, seed, count(*)::DOUBLE AS elapsed FROM l GROUP BY config, seed),
u AS (SELECT {_CONFIG_SQL} AS config, r.seed, loss_100, loss_500, final_train_loss, final_eval_loss, elapsed, r.seed * 10 + length(r.config) AS run, 1000 + r.seed AS n_params FROM r JOIN t ON r.config = t.config AND r.seed = t.seed),
a AS (SELECT config, {_STATS}, count(*) AS n_seeds, round(avg(elapsed), 6) AS elapsed_mean, arg_min(n_params, run)::INT AS n_params, avg(final_eval_loss) AS e, min(run) AS seen FROM u GROUP BY config),
k AS (SELECT * EXCLUDE (e, seen), (row_number() OVER (ORDER BY e NULLS LAST, seen, config))::INT AS rank FROM a)"""
_CONFIGS = "c AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{m}', {lr}::DOUBLE, {b}::DOUBLE, {wd}::DOUBLE, {g}::DOUBLE)" for n, m, lr, b, wd, g in grid.CONFIGS) + ") t(config, model, lr, beta2, wd, grad_norm))"


@query(f"WITH {_GRID}, {_CONFIGS} SELECT k.*, model, lr, beta2, wd, grad_norm FROM k JOIN c USING (config)")
def grid_report(spark, sf_dir):
    return _rounded(grid.with_configuration(grid.grid_summary(grid_runs(spark, sf_dir))))


@query(f"WITH {_GRID} SELECT u.config, u.seed, round(u.final_eval_loss, 6) AS final_eval_loss, k.rank, (row_number() OVER (ORDER BY k.rank, u.seed))::INT AS place FROM u JOIN k USING (config)")
def grid_seed_detail(spark, sf_dir):
    runs = grid_runs(spark, sf_dir)
    return _rounded(grid.seed_detail(runs, grid.grid_summary(runs)).select("config", "seed", "final_eval_loss", "rank", "place"))


@query(f"WITH {_LOG} SELECT config, seed, kind, step, round(CASE WHEN kind = 'train' THEN loss / 4 ELSE loss END, 6) AS loss FROM l WHERE seed <> 2")
def trainer_log(spark, sf_dir):
    from tokenloom.plans.catalog import loss_log

    own = F.when(F.col("kind") == "train", F.col("loss")).alias("loss"), F.when(F.col("kind") == "eval", F.col("loss")).alias("eval_loss")
    lines = loss_log(spark, sf_dir).select(F.to_json(F.struct("config", "seed", F.when(F.col("seed") == 2, 1).otherwise(0).alias("rank"), "step", *own)).alias("value"))
    return _rounded(grid.read_log(lines, accumulate=4))


@query(f"""WITH {_LOG} SELECT config, seed, count(*) FILTER (kind = 'train')::INT AS n_train, count(*) FILTER (kind = 'eval')::INT AS n_eval,
round(max(loss) FILTER (kind = 'train' AND step = 101), 6) AS at_101 FROM l GROUP BY config, seed""")
def grid_json(spark, sf_dir):
    from tokenloom.plans.catalog import loss_log

    parsed = grid.raw_results(loss_log(spark, sf_dir)).select(F.from_json("json", "config string, seed int, train_losses map<string,double>, eval_losses map<string,double>").alias("j")).select("j.*")
    return parsed.select("config", "seed", F.size("train_losses").alias("n_train"), F.size("eval_losses").alias("n_eval"), F.round(F.try_element_at("train_losses", F.lit("101")), 6).alias("at_101"))


@query("""SELECT l_orderkey, sum((l_linenumber::BIGINT) * l_quantity::BIGINT)::BIGINT AS n_params, round(sum((l_linenumber::BIGINT) * l_quantity::BIGINT) * CASE WHEN l_orderkey % 2 = 0 THEN 2 ELSE 4 END / 1048576.0, 9) AS megabytes
FROM lineitem GROUP BY l_orderkey""")
def parameter_count(spark, sf_dir):
    shapes = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.array(F.col("l_linenumber").cast("long"), F.col("l_quantity").cast("long"))).alias("s"))
    counted = shapes.select("l_orderkey", grid.parameter_count(F.col("s")).alias("n_params"))
    return counted.withColumn("megabytes", F.round(grid.megabytes(F.col("n_params"), F.col("l_orderkey") % 2 == 0), 9))


# --- checkpoints and names -----------------------------------------------------------------------------------------


@query("""SELECT run, path, step, (row_number() OVER (PARTITION BY run ORDER BY step DESC) <= 3) AS kept
FROM (SELECT o_custkey AS run, 'w/checkpoint-' || o_orderkey AS path, o_orderkey AS step FROM orders WHERE o_orderkey % 5 <> 0)""")
def retained_checkpoints(spark, sf_dir):
    name = F.when(F.col("o_orderkey") % 5 == 0, "w/final").otherwise(F.concat(F.lit("w/checkpoint-"), F.col("o_orderkey").cast("string")))
    return checkpoints.retained(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run"), name.alias("path")))


@query("SELECT o_custkey AS run, arg_max('w/checkpoint-' || o_orderkey, o_orderkey) FILTER (o_orderkey % 5 <> 0) AS path FROM orders GROUP BY o_custkey")
def latest_checkpoints(spark, sf_dir):
    name = F.when(F.col("o_orderkey") % 5 == 0, "w/final").otherwise(F.concat(F.lit("w/checkpoint-"), F.col("o_orderkey").cast("string")))
    return checkpoints.latest_checkpoint(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run"), name.alias("path")))


@query("SELECT arg_max(path, ts) AS path FROM (SELECT 'weights/' || event_type || '_' || event_id AS path, ts FROM events WHERE event_type = 'purchase')")
def latest_model(spark, sf_dir):
    folders = table(spark, sf_dir, "events").select(F.concat(F.lit("weights/"), "event_type", F.lit("_"), F.col("event_id").cast("string")).alias("path"), F.col("ts").alias("modificationTime"))
    return checkpoints.latest_model(folders, F.lit("purchase"))


#: Old names and new ones, a number of the row in the place of {}.
_KEYS = (
    ("final_proj.bias", None), ("label_embs_concat", None), ("label_embs_concat.{}", "label_embs_concat.{}"),
    ("post_extract_proj.weight.{}", "feature_projection.projection.weight.{}"), ("layer_norm.bias.{}", "feature_projection.layer_norm.bias.{}"),
    ("mask_emb", "masked_spec_embed"), ("feature_extractor.conv_layers.6.0.weight.{}", "feature_extractor.conv_layers.6.conv.weight.{}"),
    ("feature_extractor.conv_layers.0.2.bias.{}", "feature_extractor.conv_layers.0.layer_norm.bias.{}"), ("feature_extractor.conv_layers.7.0.weight", "feature_extractor.conv_layers.7.0.weight"),
    ("encoder.pos_conv.0.weight_g.{}", "encoder.pos_conv_embed.conv.parametrizations.weight.original0.{}"), ("encoder.pos_conv.0.weight_v", "encoder.pos_conv_embed.conv.parametrizations.weight.original1"),
    ("encoder.layers.{}.self_attn.k_proj.bias", "encoder.layers.{}.attention.k_proj.bias"), ("encoder.layers.{}.self_attn_layer_norm.weight", "encoder.layers.{}.layer_norm.weight"),
    ("encoder.layers.{}.fc1.weight", "encoder.layers.{}.feed_forward.intermediate_dense.weight"), ("encoder.layers.{}.fc2.bias", "encoder.layers.{}.feed_forward.output_dense.bias"),
    ("encoder.layer_norm.weight.{}", "encoder.layer_norm.weight.{}"),
)
_KEY_SQL = "(VALUES " + ", ".join(f"({k}, '{a}', {f"'{b}'" if b else 'NULL'})" for k, (a, b) in enumerate(_KEYS)) + ") t(k, a, b)"


@query(f"SELECT replace(a, '{{}}', doc_id::VARCHAR) AS key, replace(b, '{{}}', doc_id::VARCHAR) AS new_key FROM documents JOIN {_KEY_SQL} ON k = doc_id % {len(_KEYS)} WHERE b IS NOT NULL")
def converted_keys(spark, sf_dir):
    old = F.element_at(F.array(*(F.lit(a) for a, _ in _KEYS)), (F.col("doc_id") % len(_KEYS) + 1).cast("int"))
    return checkpoints.converted_keys(table(spark, sf_dir, "documents").select(F.replace(old, F.lit("{}"), F.col("doc_id").cast("string")).alias("key")))


@query("""SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS "full", strftime(ts, '%H:%M:%S') AS "time", strftime(ts, '%d-%m-%y') AS "date", strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS iso FROM events""")
def time_stamps(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", *(names.stamp(F.col("ts"), k).alias(k) for k in names.STAMPS))


@query("""SELECT o_orderkey, 'lstm_h' || o_custkey || '_l' || (o_orderkey % 4) || '_d0.1_' || lower(strftime(o_orderdate, '%b%d')) AS lstm,
'gpt2_e' || o_custkey || '_l' || (o_orderkey % 4) || '_h12_' || lower(strftime(o_orderdate, '%b%d')) AS gpt2 FROM orders""")
def model_names(spark, sf_dir):
    width, layers, at = F.col("o_custkey"), F.col("o_orderkey") % 4, F.col("o_orderdate")
    return table(spark, sf_dir, "orders").select("o_orderkey", names.lstm_name(width, layers, F.lit("0.1"), at).alias("lstm"), names.gpt2_name(width, layers, F.lit(12), at).alias("gpt2"))


@query("""SELECT l_orderkey, l_linenumber, (floor(l_extendedprice)::BIGINT // 3600) || 'h' || ((floor(l_extendedprice)::BIGINT % 3600) // 60) || 'm' AS eta,
CASE WHEN l_quantity > 40 THEN 'N/A' ELSE printf('%.4f', l_extendedprice) END AS value, CASE WHEN l_quantity > 40 THEN 'N/A' ELSE printf('%.4f', l_extendedprice) || chr(177) || printf('%.4f', l_tax) END AS spread FROM lineitem""")
def number_formats(spark, sf_dir):
    value = F.when(F.col("l_quantity") <= 40, F.col("l_extendedprice"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", names.eta(F.col("l_extendedprice")).alias("eta"), names.shown(value).alias("value"), names.spread(value, F.col("l_tax")).alias("spread"))


@query("""WITH s AS (SELECT CASE WHEN n_chars <= 0 THEN 'error_empty' WHEN n_chars / 1000.0 < 0.5 THEN 'skipped_short' WHEN lang = 'es' THEN 'error_encode' ELSE 'ok' END AS status FROM documents),
c AS (SELECT count(*) FILTER (status = 'ok') AS written, count(*) FILTER (status = 'skipped_short') AS skipped_short, count(*) FILTER (status LIKE 'error%') AS skipped_error, count(*) AS seen FROM s),
r AS (SELECT *, written / 50.0 AS rate FROM c), e AS (SELECT *, floor((1000000 - seen) / rate)::BIGINT AS left_ FROM r)
SELECT written, skipped_short, skipped_error, seen, round(rate, 6) AS rate, (left_ // 3600) || 'h' || (left_ % 3600 // 60) || 'm' AS eta FROM e""")
def encode_progress(spark, sf_dir):
    tokens = F.when(F.col("lang") == "es", F.lit(None)).otherwise(F.array(F.lit(1)))
    statuses = table(spark, sf_dir, "documents").select(tables.status(F.col("n_chars"), F.lit(1000.0), tokens, 0.5).alias("status"))
    return _rounded(tables.progress(statuses, 50.0, 1_000_000))


# --- sequences -----------------------------------------------------------------------------------------------------


@query(f"SELECT block_id, total AS inputs, total AS labels, 256 AS ones FROM ({_pack_sql(_SEQ, 'user_id', 5, 6, 256)})")
def collated_blocks(spark, sf_dir):
    packed = blocks.pack_blocks(event_sequences(spark, sf_dir), ["user_id"], "tokens", 5, 6, 256)
    batch = packed.select("block_id", *(c.alias(k) for k, c in sequences.collate(F.col("tokens")).items()))
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    return batch.select("block_id", total("input_ids").alias("inputs"), total("labels").alias("labels"), total("attention_mask").cast("int").alias("ones"))


@query("SELECT vec_id, 1 AS channels, round(list_sum(list_transform(embedding[1:32], lambda x: x::DOUBLE)), 5) AS total FROM embeddings")
def mono_channel(spark, sf_dir):
    two = F.array(F.slice("embedding", 1, 32), F.slice("embedding", 33, 32))
    mono = table(spark, sf_dir, "embeddings").select("vec_id", sequences.first_channel(two).alias("m"))
    return mono.select("vec_id", F.size("m").alias("channels"), F.round(F.aggregate(F.get("m", F.lit(0)), F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


@query("SELECT event_id, event_type FROM events")
def shuffled_rows(spark, sf_dir):
    return blocks.shuffled(table(spark, sf_dir, "events").select("event_id", "event_type"))


@query(f"WITH {_SCORED} SELECT count(*) AS n, count(DISTINCT g) AS n_groups FROM s")
def group_counts(spark, sf_dir):
    e = scored_events(spark, sf_dir).where("log_prob IS NOT NULL AND group_id IS NOT NULL")
    return e.agg(F.count("*").alias("n"), F.count_distinct("group_id").alias("n_groups"))
