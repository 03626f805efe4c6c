"""The engine's queries over the test tables, and the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tokenloom.functions import names, sequences
from tokenloom.operators import bigrams, blocks, encoders, grid, metrics, positions, quantize, report, tables
from tokenloom.session import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

TYPES = ("click", "error", "purchase", "signup", "view")
_CODE = "CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 WHEN 'view' THEN 4 ELSE 5 END"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return keep


# --- metrics -------------------------------------------------------------------------------------------------------


def scored_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.where(F.col("event_type").isin("purchase", "signup", "error", "click")).select(
        F.col("user_id").alias("group_id"),
        F.when(F.hour("ts") < 12, "AM").otherwise("PM").alias("voice"),
        F.col("event_type").isin("purchase", "signup").alias("positive"),
        F.col("value").alias("log_prob"),
    )


_SCORED = """s AS (SELECT user_id AS g, CASE WHEN hour(ts) < 12 THEN 'AM' ELSE 'PM' END AS voice, event_type IN ('purchase', 'signup') AS pos, value AS v
  FROM events WHERE event_type IN ('purchase', 'signup', 'error', 'click') AND value IS NOT NULL AND user_id IS NOT NULL)"""
_ACCURACY = f"""WITH {_SCORED},
a AS (SELECT p.g, avg(CASE WHEN p.v > n.v AND NOT isnan(p.v) AND NOT isnan(n.v) THEN 1.0 ELSE 0.0 END) AS a FROM s p JOIN s n ON p.g = n.g AND p.pos AND NOT n.pos GROUP BY p.g)
SELECT round(coalesce(avg(a), 0), 6) AS accuracy, count(*) AS n_groups FROM a"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


@query(_ACCURACY)
def discrimination_accuracy(spark, sf_dir):
    return _rounded(metrics.discrimination_accuracy(scored_events(spark, sf_dir), "log_prob"))


@query(f"""WITH {_SCORED},
a AS (SELECT p.voice, p.g, avg(CASE WHEN p.v > n.v AND NOT isnan(p.v) AND NOT isnan(n.v) THEN 1.0 ELSE 0.0 END) AS a
      FROM s p JOIN s n ON p.g = n.g AND p.voice = n.voice AND p.pos AND NOT n.pos GROUP BY p.voice, p.g),
v AS (SELECT DISTINCT voice FROM s)
SELECT v.voice, round(coalesce(avg(a), 0), 6) AS accuracy, count(a) AS n_groups FROM v LEFT JOIN a ON a.voice = v.voice GROUP BY v.voice""")
def per_voice_accuracy(spark, sf_dir):
    return _rounded(metrics.accuracy_by(scored_events(spark, sf_dir), "voice", "log_prob"))


@query(f"""WITH {_SCORED},
p AS (SELECT DISTINCT g, v FROM s WHERE pos),
a AS (SELECT p.g, p.v, avg((p.v > n.v)::INT::DOUBLE) AS a FROM p JOIN s n ON p.g = n.g AND NOT n.pos GROUP BY p.g, p.v),
b AS (SELECT g, avg(a) AS a FROM a GROUP BY g)
SELECT round(coalesce(avg(a), 0), 6) AS accuracy, count(*) AS n_groups FROM b""")
def collapsed_accuracy(spark, sf_dir):
    return _rounded(metrics.collapsed_accuracy(scored_events(spark, sf_dir), "log_prob"))


@query("""WITH s AS (SELECT lang AS g, quality = 1 AS pos, n_chars::DOUBLE AS v FROM documents JOIN labels USING (doc_id) WHERE lang IS NOT NULL AND quality IS NOT NULL AND n_chars IS NOT NULL)
SELECT p.g AS lang, any_value(np) AS n_pos, any_value(nn) AS n_neg, sum((p.v > n.v)::INT)::BIGINT AS won, round(avg((p.v > n.v)::INT::DOUBLE), 6) AS accuracy
FROM s p JOIN s n ON p.g = n.g AND p.pos AND NOT n.pos JOIN (SELECT g, count(*) FILTER (pos) AS np, count(*) FILTER (NOT pos) AS nn FROM s GROUP BY g) c ON c.g = p.g GROUP BY p.g""")
def accuracy_per_group(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    return _rounded(metrics.group_accuracy(d.withColumn("positive", F.col("quality") == 1), "n_chars", "positive", ["lang"]))


_SUMMARY = "count(*) AS total, count({c}) AS scored, count(*) - count({c}) AS missing, min({c})::DOUBLE AS min, round(median({c}), 6) AS median, max({c})::DOUBLE AS max, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std_samp, round(stddev_pop({c}), 6) AS std_pop"


@query(f"SELECT {_SUMMARY.format(c='n_chars')} FROM documents")
def score_summary(spark, sf_dir):
    return _rounded(metrics.score_summary(table(spark, sf_dir, "documents"), "n_chars"))


@query("SELECT (count(DISTINCT quality) + max((quality IS NULL)::INT))::BIGINT AS n_quality, (count(DISTINCT lang) + max((lang IS NULL)::INT))::BIGINT AS n_lang FROM documents LEFT JOIN labels USING (doc_id)")
def n_unique_with_null(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return d.agg(metrics.n_unique(F.col("quality")).alias("n_quality"), metrics.n_unique(F.col("lang")).alias("n_lang"))


@query("SELECT count(*) AS total, count(quality) AS scored, count(*) - count(quality) AS missing, count(DISTINCT lang) AS n_lang FROM documents LEFT JOIN labels USING (doc_id)")
def missing_tokens_report(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    found = tables.look_up(d, table(spark, sf_dir, "labels"), "doc_id", ["quality"], "quality")
    return found.agg(F.count("*").alias("total"), F.count("quality").alias("scored"), (F.count("*") - F.count("quality")).alias("missing"), F.count_distinct("lang").alias("n_lang"))


@query("""SELECT u.user_id, t.event_id AS last_event FROM (SELECT DISTINCT user_id FROM events) u
LEFT JOIN (SELECT user_id, arg_max(event_id, ts) AS event_id FROM events WHERE event_type = 'purchase' GROUP BY user_id) t USING (user_id)""")
def last_record_wins(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    stored = e.where("event_type = 'purchase'").select("user_id", "ts", F.col("event_id").alias("last_event"))
    return tables.look_up(e.select("user_id").distinct(), stored, "user_id", ["ts"], "last_event")


# --- tables --------------------------------------------------------------------------------------------------------


@query("""SELECT o_orderkey AS group_id, voice, positive, CASE WHEN positive THEN o_orderpriority ELSE o_orderstatus END AS word,
  o_orderkey || '_' || voice || '_' || CASE WHEN positive THEN 'pos' ELSE 'neg' END AS file_id
FROM (SELECT *, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'low' END AS voice FROM orders), (VALUES (TRUE), (FALSE)) AS t(positive)""")
def unpivot_pairs(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.expr("CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'low' END").alias("voice"),
        F.col("o_orderpriority").alias("positive_word"), F.col("o_orderstatus").alias("negative_word"),
    )
    return tables.unpivot_pairs(o, ["word"])


@query("SELECT doc_id, p AS position FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS p FROM documents) WHERE p % 7 = 3")
def shard_strided(spark, sf_dir):
    return positions.strided(table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"], 7, 3)


def _contiguous_sql(n: int) -> str:
    return f"""SELECT doc_id, p AS position, (CASE WHEN total // {n} = 0 THEN {n - 1} ELSE least(p // (total // {n}), {n - 1}) END)::BIGINT AS task
FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS p, count(*) OVER () AS total FROM documents)"""


@query(_contiguous_sql(7))
def shard_contiguous(spark, sf_dir):
    return positions.contiguous(table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"], 7)


@query(_contiguous_sql(1_000_000))
def shard_contiguous_few_rows(spark, sf_dir):
    return positions.contiguous(table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"], 1_000_000)


@query("""SELECT status, count(*) AS n FROM (SELECT CASE WHEN n_chars <= 0 THEN 'error_empty' WHEN n_chars / 100.0 < 3.0 THEN 'skipped_short'
  WHEN lang = 'es' THEN 'error_encode' WHEN lang = 'de' THEN 'error_no_tokens' ELSE 'ok' END AS status FROM documents) GROUP BY status""")
def status_counts(spark, sf_dir):
    tokens = F.when(F.col("lang") == "es", F.lit(None)).when(F.col("lang") == "de", F.array().cast("array<int>")).otherwise(F.array(F.lit(1)))
    return table(spark, sf_dir, "documents").select(tables.status(F.col("n_chars"), F.lit(100.0), tokens).alias("status")).groupBy("status").agg(F.count("*").alias("n"))


@query(r"""SELECT page_id, regexp_replace(url, '/[^/]*$', '') AS parent, regexp_extract(url, '[^/]*$') AS name, row_number() OVER (ORDER BY regexp_replace(url, '/[^/]*$', ''), regexp_extract(url, '[^/]*$'), page_id) - 1 AS position FROM pages""")
def two_key_path_sort(spark, sf_dir):
    url = F.col("url")
    p = table(spark, sf_dir, "pages").select("page_id", names.parent(url).alias("parent"), names.file_name(url).alias("name"))
    return positions.with_running(p, ["parent", "name", "page_id"])


@query("SELECT c.config, s.seed::INT AS seed FROM (SELECT DISTINCT event_type AS config FROM events) c, (VALUES (1), (2)) s(seed)")
def plan_runs(spark, sf_dir):
    return grid.with_seeds(table(spark, sf_dir, "events").select(F.col("event_type").alias("config")).distinct(), [1, 2])


#: Which encoder's tokens a document's language stands for; Spanish has one that isn't known.
_ENCODER_OF = {"en": "spidr_base", "de": "mhubert", "fr": "hubert-500", "es": "none"}
_ENCODER_SQL = "CASE lang " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _ENCODER_OF.items()) + " END"
_VOCABULARY_SQL = ", ".join(f"('{n}', {k})" for n, k in encoders.VOCABULARIES.items())


@query(f"""SELECT d.name, n_docs, n::INT AS n_tokens, n::INT AS bos, (n + 1)::INT AS eos, (n + 2)::INT AS vocab, CASE WHEN n + 2 > 1000 THEN 16 WHEN n IS NOT NULL THEN 32 END::INT AS batch, CASE WHEN n + 2 > 1000 THEN 8 WHEN n IS NOT NULL THEN 4 END::INT AS accumulate
FROM (SELECT {_ENCODER_SQL} AS name, count(*) AS n_docs FROM documents GROUP BY 1) d LEFT JOIN (VALUES {_VOCABULARY_SQL}) t(name, n) ON d.name = t.name""")
def vocabularies(spark, sf_dir):
    """The registry looked up for the encoder of each document, with the batch that its vocabulary allows."""
    name = F.coalesce(*(F.when(F.col("lang") == k, v) for k, v in _ENCODER_OF.items())).alias("name")
    counted = table(spark, sf_dir, "documents").groupBy(name).agg(F.count("*").alias("n_docs"))
    known = counted.join(encoders.dimension(spark), "name", "left").withColumn("r", F.when(F.col("vocab").isNotNull(), grid.batch_rule(F.col("vocab"))))
    return known.select("name", "n_docs", "n_tokens", "bos", "eos", "vocab", "r.batch", "r.accumulate")


# --- sequences -----------------------------------------------------------------------------------------------------


def event_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", F.struct("ts", F.expr(_CODE).alias("c")).alias("s"))
    return e.groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list("s")), lambda s: s["c"]).alias("tokens"))


def word_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.filter(F.split(F.coalesce("text", F.lit("")), " "), lambda w: w != "")
    return table(spark, sf_dir, "documents").select("doc_id", F.transform(words, lambda w: F.char_length(w) % 256).alias("tokens"))


_SEQ = f"q AS (SELECT user_id, list({_CODE} ORDER BY ts) AS t FROM events GROUP BY user_id)"
_SHOWN = "array_to_string(list_transform({t}, lambda x: x::VARCHAR), ',')"


def _shown(c: Column) -> Column:
    return F.array_join(c.cast("array<string>"), ",")


@query(f"WITH {_SEQ}, d AS (SELECT user_id, t, list_filter(t, lambda x, i: i = 1 OR x <> t[i - 1]) AS u FROM q) SELECT user_id, len(t)::INT AS n, len(u)::INT AS n_kept, {_SHOWN.format(t='u')} AS tokens FROM d")
def dedup_consecutive(spark, sf_dir):
    kept = sequences.collapse_repeats(F.col("tokens"))
    return event_sequences(spark, sf_dir).select("user_id", F.size("tokens").alias("n"), F.size(kept).alias("n_kept"), _shown(kept).alias("tokens"))


@query(f"""WITH e AS (SELECT user_id, ts, {_CODE} AS c FROM events), l AS (SELECT *, lag(c) OVER (PARTITION BY user_id ORDER BY ts) AS b FROM e)
SELECT user_id, count(*) FILTER (b IS NULL OR b <> c) AS n_kept FROM l GROUP BY user_id""")
def dedup_consecutive_rows(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "ts", F.expr(_CODE).alias("c"))
    b = F.lag("c").over(Window.partitionBy("user_id").orderBy("ts"))
    return e.withColumn("k", b.isNull() | (b != F.col("c"))).groupBy("user_id").agg(F.count_if("k").alias("n_kept"))


@query(f"WITH {_SEQ} SELECT user_id, (len(t) + 2)::INT AS n, {_SHOWN.format(t='list_concat([5], t, [6])')} AS tokens FROM q")
def wrap_and_length(spark, sf_dir):
    w = sequences.wrap(F.col("tokens"), 5, 6)
    return event_sequences(spark, sf_dir).select("user_id", F.size(w).alias("n"), _shown(w).alias("tokens"))


def _pack_sql(source: str, key: str, bos: int, eos: int, size: int) -> str:
    return f"""WITH {source}, w AS (SELECT {key} AS k, unnest(list_concat([{bos}], t, [{eos}])) AS x, unnest(range(len(t) + 2)) AS i FROM q),
p AS (SELECT x, row_number() OVER (ORDER BY k, i) - 1 AS pos FROM w)
SELECT pos // {size} AS block_id, md5(string_agg(x::VARCHAR, ',' ORDER BY pos)) AS digest, sum(x)::BIGINT AS total FROM p GROUP BY pos // {size} HAVING count(*) = {size}"""


_WORDS = "q AS (SELECT doc_id, list_transform(list_filter(string_split(coalesce(text, ''), ' '), lambda w: w <> ''), lambda w: length(w) % 256) AS t FROM documents)"


def _block_digest(df: DataFrame) -> DataFrame:
    return df.select("block_id", F.md5(_shown(F.col("tokens")).cast("binary")).alias("digest"), F.aggregate("tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query(_pack_sql(_SEQ, "user_id", 5, 6, 256))
def pack_blocks_events(spark, sf_dir):
    return _block_digest(blocks.pack_blocks(event_sequences(spark, sf_dir), ["user_id"], "tokens", 5, 6, 256))


@query(_pack_sql(_WORDS, "doc_id", 256, 257, 2048))
def pack_blocks_documents(spark, sf_dir):
    return _block_digest(blocks.pack_blocks(word_sequences(spark, sf_dir), ["doc_id"], "tokens", 256, 257))


@query(f"""WITH {_SEQ}, n AS (SELECT sum(len(t) + 2) AS n FROM q), r AS (SELECT unnest(range(1, (ceil(40 * 512 / n))::BIGINT + 1)) AS turn FROM n),
w AS (SELECT turn, user_id AS k, unnest(list_concat([5], t, [6])) AS x, unnest(range(len(t) + 2)) AS i FROM q, r),
p AS (SELECT x, row_number() OVER (ORDER BY turn, k, i) - 1 AS pos FROM w)
SELECT pos // 512 AS block_id, md5(string_agg(x::VARCHAR, ',' ORDER BY pos)) AS digest, sum(x)::BIGINT AS total FROM p WHERE pos < 40 * 512 GROUP BY pos // 512 HAVING count(*) = 512""")
def eval_blocks(spark, sf_dir):
    return _block_digest(blocks.eval_blocks(event_sequences(spark, sf_dir), ["user_id"], "tokens", 5, 6, 512, 40))


_BIGRAM = f"""{_SEQ}, w AS (SELECT user_id, list_concat([5], t, [6]) AS t FROM q),
s AS (SELECT user_id, unnest(t[:-2]) AS a, unnest(t[2:]) AS b FROM w),
c AS (SELECT a, b, count(*) AS n FROM s GROUP BY a, b), m AS (SELECT a, sum(n) AS n FROM c GROUP BY a),
r AS (SELECT user_id, sum(ln((c.n + 1) / (m.n + 7))) AS lp, count(*) AS k FROM s JOIN c USING (a, b) JOIN m USING (a) GROUP BY user_id)"""


@query(f"WITH {_BIGRAM} SELECT user_id, round(lp, 6) AS log_prob, round(lp / k, 6) AS log_prob_norm, k AS num_tokens FROM r")
def bigram_scores(spark, sf_dir):
    seqs = event_sequences(spark, sf_dir)
    return _rounded(bigrams.score(seqs, bigrams.train_bigrams(seqs, "tokens", 5, 6), "user_id", "tokens", 5, 6, 7))


@query(f"WITH {_BIGRAM} SELECT round(-sum(lp) / sum(k), 6) AS loss FROM r")
def bigram_loss(spark, sf_dir):
    seqs = event_sequences(spark, sf_dir)
    return _rounded(bigrams.loss(seqs, bigrams.train_bigrams(seqs, "tokens", 5, 6), "user_id", "tokens", 5, 6, 7))


@query("""WITH c AS (SELECT label, list(m ORDER BY i) AS c FROM (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM embeddings) GROUP BY label, i) GROUP BY label)
SELECT vec_id, arg_min(c.label, list_sum(list_transform(range(1, len(c) + 1), lambda k: (c[k] - embedding[k]::DOUBLE) ** 2))) AS cluster FROM embeddings, c GROUP BY vec_id""")
def nearest_centroid(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return quantize.nearest_centroid(e, quantize.group_means(e, "label", "embedding"), "vec_id", "embedding")


@query("SELECT vec_id, (list_position(embedding, list_max(embedding)) - 1)::INT AS token FROM embeddings")
def codebook_argmax(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", sequences.argmax(F.col("embedding")).alias("token"))


@query("""WITH s AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), m AS (SELECT *, list_avg(e) AS m FROM s), d AS (SELECT *, sqrt(list_avg(list_transform(e, lambda x: (x - m) ** 2)) + 1e-5) AS d FROM m)
SELECT vec_id, round((e[1] - m) / d, 4) AS first, round((list_min(e) - m) / d, 4) AS least, round((list_max(e) - m) / d, 4) AS most FROM d""")
def layer_norm(spark, sf_dir):
    n = table(spark, sf_dir, "embeddings").select("vec_id", sequences.layer_norm(F.col("embedding")).alias("n"))
    return n.select("vec_id", F.round(F.get("n", F.lit(0)), 4).alias("first"), F.round(F.array_min("n"), 4).alias("least"), F.round(F.array_max("n"), 4).alias("most"))


# --- grids and reports ---------------------------------------------------------------------------------------------


def loss_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("config"), (F.col("user_id") % 3).cast("int").alias("seed"), "ts", F.col("value").alias("loss"))
    return positions.within(e, ["config", "seed"], ["ts", "loss"], "step").select("config", "seed", F.when(F.col("step") % 10 == 0, "eval").otherwise("train").alias("kind"), "step", "loss")


_LOG = "g AS (SELECT event_type AS config, (user_id % 3)::INT AS seed, value AS loss, row_number() OVER (PARTITION BY event_type, user_id % 3 ORDER BY ts) AS step FROM events), l AS (SELECT *, CASE WHEN step % 10 = 0 THEN 'eval' ELSE 'train' END AS kind FROM g)"
_RUNS = f"""{_LOG}, r AS (SELECT config, seed, max(loss) FILTER (kind = 'train' AND step = 101) AS loss_100, max(loss) FILTER (kind = 'train' AND step = 501) AS loss_500,
  arg_max(loss, step) FILTER (kind = 'train') AS final_train_loss, arg_max(loss, step) FILTER (kind = 'eval') AS final_eval_loss FROM l GROUP BY config, seed)"""


def _log_from_one(spark, sf_dir):
    """Steps counted so that the milestones fall on train steps."""
    return loss_log(spark, sf_dir).withColumn("step", F.when(F.col("kind") == "train", F.col("step") - 1).otherwise(F.col("step")))


@query(f"WITH {_RUNS} SELECT config, seed, round(loss_100, 6) AS loss_100, round(loss_500, 6) AS loss_500, round(final_train_loss, 6) AS final_train_loss, round(final_eval_loss, 6) AS final_eval_loss FROM r")
def loss_milestones(spark, sf_dir):
    return _rounded(grid.run_results(_log_from_one(spark, sf_dir)))


_STATS = ", ".join(f"round(avg({c}), 6) AS {c}_mean, round(stddev_pop({c}), 6) AS {c}_std" for c in ("loss_100", "loss_500", "final_train_loss", "final_eval_loss"))


@query(f"WITH {_RUNS}, a AS (SELECT config, {_STATS}, count(*) AS n_seeds, avg(final_eval_loss) AS e FROM r GROUP BY config) SELECT * EXCLUDE (e), (row_number() OVER (ORDER BY e NULLS LAST, config))::INT AS rank FROM a")
def grid_summary(spark, sf_dir):
    return _rounded(grid.grid_summary(grid.run_results(_log_from_one(spark, sf_dir))))


@query(f"""WITH {_LOG}, e AS (SELECT config, seed, step, loss, min(loss) OVER (PARTITION BY config, seed ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM l WHERE kind = 'eval'),
f AS (SELECT *, sum((b IS NULL OR loss < b)::INT) OVER (PARTITION BY config, seed ORDER BY step) AS run FROM e),
h AS (SELECT *, row_number() OVER (PARTITION BY config, seed, run ORDER BY step) - 1 AS stale, least(b, loss) AS best FROM f)
SELECT config, seed, min(step) AS stop_step, round(arg_min(best, step), 6) AS best_loss FROM h WHERE stale = 3 GROUP BY config, seed""")
def early_stopping_step(spark, sf_dir):
    held = loss_log(spark, sf_dir).where("kind = 'eval'")
    return _rounded(grid.early_stop(held, ["config", "seed"]))


#: Forms of model names, with the numbers of an order in them; the last two tell no architecture or no size.
_FORMS = ("base_lstm_h{k}_l3_d0.1_feb12", "multi_gpt2_e{k}_l12_h12_mar01", "units-{k}_lstm_h256_l2_d0.0", "base_gpt2_lstm_h{k}", "notes-{k}", "a{k}_lstm")
_FORM_SQL = "CASE o_custkey % 6 " + " ".join(f"WHEN {i} THEN '" + f.replace("{k}", "' || o_orderkey || '") + "'" for i, f in enumerate(_FORMS)) + " END"
_INFO = f"""n AS (SELECT o_orderkey, {_FORM_SQL} AS n, o_totalprice AS a FROM orders),
m AS (SELECT o_orderkey, n AS filename, a::DOUBLE AS accuracy, CASE WHEN n LIKE '%lstm%' THEN 'lstm' WHEN n LIKE '%gpt2%' THEN 'gpt2' ELSE 'unknown' END AS arch,
  CASE WHEN n LIKE '%lstm%' THEN string_split(n, '_lstm')[1] WHEN n LIKE '%gpt2%' THEN string_split(n, '_gpt2')[1] END AS encoder,
  CASE WHEN n LIKE '%lstm%' THEN coalesce(try_cast(regexp_extract(n, '_h(\\d+)', 1) AS INT), 0) WHEN n LIKE '%gpt2%' THEN coalesce(try_cast(regexp_extract(n, '_e(\\d+)', 1) AS INT), 0) ELSE 0 END AS size FROM n)"""


def _models(spark: SparkSession, sf_dir: str) -> DataFrame:
    form = F.element_at(F.array(*(F.lit(f) for f in _FORMS)), (F.col("o_custkey") % 6 + 1).cast("int"))
    name = F.replace(form, F.lit("{k}"), F.col("o_orderkey").cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", name.alias("filename"), F.col("o_totalprice").cast("double").alias("accuracy"))


@query(f"WITH {_INFO} SELECT filename, arch, encoder, size FROM m")
def parse_model_names(spark, sf_dir):
    return _models(spark, sf_dir).select("filename", *(c.alias(k) for k, c in names.model_info(F.col("filename")).items()))


@query(f"""WITH {_INFO}, g AS (SELECT encoder, arch, size, round(avg(accuracy), 6) AS accuracy, min(filename) AS filename FROM m WHERE arch <> 'unknown' AND encoder NOT LIKE 'a%' AND encoder NOT LIKE 'units%' GROUP BY ALL),
k AS (SELECT *, row_number() OVER o AS place, lead(arch) OVER o AS nxt FROM g WINDOW o AS (ORDER BY (arch <> 'lstm')::INT, encoder, size, filename))
SELECT encoder, arch, size, accuracy, filename, coalesce(sum(CASE WHEN nxt <> arch THEN 1.25 ELSE 1.0 END) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS x, place::INT AS place FROM k""")
def bar_positions(spark, sf_dir):
    """A bar for each model that orders name; places come from a range of the order, a running count and one of the changes."""
    models = report.compare(_models(spark, sf_dir).select("filename", "accuracy")).where("encoder NOT LIKE 'a%' AND encoder NOT LIKE 'units%'")
    one = models.groupBy("encoder", "arch", "size").agg(F.round(F.avg("accuracy"), 6).alias("accuracy"), F.min("filename").alias("filename"))
    return report.bar_positions(one)


@query(r"""SELECT user_id AS run, arg_max(path, step) AS path FROM (SELECT user_id, CASE WHEN event_type = 'view' THEN 'w/final' ELSE 'w/checkpoint-' || event_id END AS path, CASE WHEN event_type <> 'view' THEN event_id END AS step FROM events) GROUP BY user_id""")
def latest_checkpoint(spark, sf_dir):
    path = F.when(F.col("event_type") == "view", "w/final").otherwise(F.concat(F.lit("w/checkpoint-"), F.col("event_id").cast("string")))
    p = table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), path.alias("path"))
    return p.groupBy("run").agg(F.max_by("path", names.trailing_number(F.col("path"))).alias("path"))


@query("SELECT o_orderkey, lower(strftime(o_orderdate, '%b%d')) AS tag, printf('%03d', o_custkey % 50) AS segment FROM orders")
def date_tags(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", names.day_tag(F.col("o_orderdate")).alias("tag"), F.format_string("%03d", F.col("o_custkey") % 50).alias("segment"))


@query(r"""SELECT page_id, regexp_extract(url, '[^/]*$') AS name, CASE WHEN regexp_matches(regexp_extract(url, '[^/]*$'), '.\.[^.]*$') THEN regexp_replace(regexp_extract(url, '[^/]*$'), '\.[^.]*$', '') ELSE regexp_extract(url, '[^/]*$') END AS stem FROM pages""")
def path_parts(spark, sf_dir):
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", names.file_name(url).alias("name"), names.stem(url).alias("stem"))


@query("""SELECT source, CASE WHEN source = 'src0' THEN NULL WHEN source LIKE 'src1%' THEN 'one.' || source[5:] ELSE source END AS key FROM (SELECT DISTINCT source FROM documents)""")
def rewrite_keys(spark, sf_dir):
    rules = [("^src0$", None), ("^src1", "one.")]
    return table(spark, sf_dir, "documents").select("source").distinct().select("source", names.rewrite(F.col("source"), rules).alias("key"))


@query("SELECT lang, count(*) AS n, round(sum(n_chars) * 32.0 * 4 * 2 * 2048 / 1000, 6) AS tokens_a_second FROM documents GROUP BY lang")
def throughput(spark, sf_dir):
    d = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("steps"))
    rate = grid.throughput(F.col("steps").cast("double"), F.lit(1000.0), F.lit(32), F.lit(4), F.lit(2))
    return d.select("lang", "n", F.round(rate, 6).alias("tokens_a_second"))
