"""Queries that write a table in one of the engine's formats and read it again, with SQL over the table itself.

What they write lies in the session's shared folder.
"""

from __future__ import annotations

import io
import math
import tarfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.functions import batches as batches_of
from tokenloom.functions import names, sequences
from tokenloom.operators import bigrams, checkpoints, evaluate, grid, metrics, quantize, tables
from tokenloom.plans import flows
from tokenloom.plans.catalog import _ACCURACY, _SEQ, _SHOWN, _rounded, _shown, event_sequences, query, scored_events
from tokenloom.session import checkpoint_dir, table
from tokenloom.sources import files, tar, tensors
from tokenloom.sources.store import Store
from tokenloom.streaming import pack


def _folder(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark)}/roundtrip-{uuid.uuid4().hex}"


@query(f"WITH {_SEQ} SELECT 'u' || user_id || '_s000' AS key, {_SHOWN.format(t='t')} AS tokens, 'u' || user_id || '.wav' AS file_id, len(t)::INT AS token_count FROM q")
def stored_tokens(spark, sf_dir):
    """Records with side-cars into shards, in two writes of which the second holds every key again."""
    home = _folder(spark).removeprefix("file:")
    seqs = event_sequences(spark, sf_dir).select(F.format_string("u%d.wav", "user_id").alias("file_id"), F.col("tokens"), F.lit("a/b.wav").alias("audio_filepath"))
    first = seqs.withColumn("tokens", F.array(F.lit(0)))
    tar.write_tokens(tar.token_records(first).coalesce(1), home)
    tar.write_tokens(tar.token_records(seqs).coalesce(1), home, mode="append", maxrecords=50)
    last = tar.load_last(spark, home)
    meta = tar.with_meta(tar.read_tokens(spark, home)).groupBy("key").agg(F.max_by("meta", F.struct("shard", "place")).alias("m"))
    return last.join(meta, "key").select("key", _shown(F.col("tokens")).alias("tokens"), "m.file_id", "m.token_count")


@query(_ACCURACY)
def cached_scores(spark, sf_dir):
    """Scores written as CSV once and read the second time, where making them again would fail."""
    path = f"{_folder(spark)}/scores.csv"
    evaluate.scored_once(spark, path, lambda: scored_events(spark, sf_dir))
    again = evaluate.scored_once(spark, path, lambda: (_ for _ in ()).throw(RuntimeError("not read from the cache")))
    return _rounded(metrics.discrimination_accuracy(again, "log_prob"))


_FILES = {"base_lstm_h64": "user_id % 3 = 0", "base_gpt2_e8": "user_id % 3 = 1", "multi_lstm_h32": "user_id % 3 = 2", "base_other_h1": "user_id % 3 = 2"}


def _results_sql() -> str:
    parts = []
    for name, where in list(_FILES.items())[:3]:
        scored = f"SELECT user_id AS g, event_type IN ('purchase', 'signup') AS pos, value AS v FROM events WHERE event_type IN ('purchase', 'signup', 'error', 'click') AND {where}"
        arch = "lstm" if "lstm" in name else "gpt2"
        size = name.rsplit("_", 1)[1][1:]
        parts.append(f"SELECT '{name.split('_' + arch)[0]}' AS encoder, '{arch}' AS arch, {size} AS size, round(avg(a), 6) AS accuracy, '{name}' AS filename FROM (SELECT p.g, avg((p.v > n.v)::INT::DOUBLE) AS a FROM ({scored}) p JOIN ({scored}) n ON p.g = n.g AND p.pos AND NOT n.pos GROUP BY p.g)")
    return " UNION ALL ".join(parts)


@query(_results_sql())
def result_folder(spark, sf_dir):
    """A folder of one result file for each model, with files to skip beside them."""
    home, e = _folder(spark), scored_events(spark, sf_dir)
    for name, where in _FILES.items():
        evaluate.write_scored(e.withColumnRenamed("group_id", "user_id").where(where).withColumnRenamed("user_id", "word_id"), f"{home}/{name}.csv")
    evaluate.write_scored(e.select("group_id", "log_prob"), f"{home}/short_lstm_h1.csv")
    return _rounded(evaluate.model_results(spark, home, "log_prob"))


@query(r"SELECT 'p' || page_id AS file_id, url AS audio_filepath, (row_number() OVER (ORDER BY regexp_replace(url, '/[^/]*$', ''), regexp_extract(url, '[^/]*$'), 'p' || page_id) - 1)::BIGINT AS line FROM pages")
def saved_manifest(spark, sf_dir):
    """A manifest as sorted CSV, and as text whose lines are in the same order."""
    home = _folder(spark)
    m = table(spark, sf_dir, "pages").select(F.format_string("p%d", "page_id").alias("file_id"), F.col("url").alias("path"), F.lit("other").alias("audio_filepath"))
    m.write.parquet(f"{home}/m.parquet")
    tables.save_manifest(tables.load_manifest(spark, f"{home}/m.parquet", prefer_path=True), f"{home}/m.csv")
    loaded = tables.load_manifest(spark, f"{home}/m.csv")
    tables.save_manifest(loaded, f"{home}/m.txt")
    lines = tables.numbered(spark.read.text(f"{home}/m.txt"))
    own = tables.numbered(loaded)
    return own.join(lines, "line").where("value = audio_filepath").select("file_id", "audio_filepath", "line")


@query("""SELECT o_orderkey AS group_id, o_orderkey || '_v_' || CASE WHEN positive THEN 'pos' ELSE 'neg' END AS file_id, CASE WHEN positive THEN o_orderpriority ELSE o_orderstatus END AS word, positive,
md5(CASE WHEN positive THEN 'p' ELSE 'n' END || o_orderkey) AS digest FROM orders, (VALUES (TRUE), (FALSE)) AS t(positive)""")
def nested_pairs(spark, sf_dir):
    """Pairs with audio in nested structs, from a glob of Parquet files."""
    home, key = _folder(spark), F.col("o_orderkey").cast("string")
    side = lambda mark: F.struct(F.concat(F.lit(mark), key).cast("binary").alias("bytes"), F.lit(16000).alias("rate"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.lit("v").alias("voice"), side("p").alias("positive"), side("n").alias("negative"), F.col("o_orderpriority").alias("positive_word"), F.col("o_orderstatus").alias("negative_word"))
    for k in (0, 1):
        o.where(F.col("id") % 2 == k).write.parquet(f"{home}/part{k}.parquet")
    long = tables.unpivot_pairs(spark.read.parquet(f"{home}/part*.parquet"), ["word"], nested={"audio": "bytes"})
    return long.select("group_id", "file_id", "word", "positive", F.md5("audio").alias("digest"))


@query("SELECT doc_id::VARCHAR AS doc_id, lang, quality::VARCHAR AS quality FROM documents LEFT JOIN labels USING (doc_id) WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id::VARCHAR, NULL, quality::VARCHAR FROM labels WHERE doc_id % 2 = 1")
def saved_rows(spark, sf_dir):
    """Tables of different columns into one CSV."""
    path, d, n = f"{_folder(spark)}/rows.csv", table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    tables.save_rows([d.join(n, "doc_id", "left").where("doc_id % 2 = 0"), n.where("doc_id % 2 = 1")], path)
    return tables.load_rows(spark, path).select("doc_id", "lang", "quality")


@query("SELECT doc_id, 'd' || doc_id AS stem FROM documents")
def stored_record_keys(spark, sf_dir):
    """Keys that shards take: without the dots that part a member's name from its kind."""
    home = _folder(spark).removeprefix("file:")
    d = table(spark, sf_dir, "documents").select(names.stem(F.format_string("d%d.x", "doc_id")).alias("key"), F.array((F.col("doc_id") % 1000).cast("smallint")).alias("tokens"))
    tar.write_tokens(d, home, naming="shard", maxrecords=300)
    return tar.read_tokens(spark, home).select(F.substring("key", 2, 20).cast("long").alias("doc_id"), F.col("key").alias("stem"))


@query("""SELECT md5(array_to_string(list_concat([32766], list_transform(range(1, 15), lambda i: (doc_id * i + coalesce(n_chars, 0)) % 32000), [32767]), ',')) AS digest, 16 AS n FROM documents""")
def streamed_blocks(spark, sf_dir):
    """The training stream over one epoch, from shards through lanes, buffers and packing into shards: sequences as long as a block, so each is one.

    Shards grow with the table, and lanes with it and the cluster, so that there are tens of micro-batches at any size.
    """
    home, n = _folder(spark), table(spark, sf_dir, "documents").count()
    each = max(40, min(1000, n // 64))
    lanes = max(2, min(spark.sparkContext.defaultParallelism, n // each // 20))
    tokens = F.transform(F.sequence(F.lit(1), F.lit(14)), lambda i: ((F.col("doc_id") * i + F.coalesce("n_chars", F.lit(0))) % 32000).cast("smallint"))
    docs = table(spark, sf_dir, "documents").select(F.format_string("d%d", "doc_id").alias("key"), tokens.alias("tokens"))
    tar.write_tokens(docs, f"{home}/in", maxrecords=each)
    blocks = pack.training_blocks(spark, f"{home}/in", 32766, 32767, 16, lanes=lanes, buffer=100, replacement="false", epochs=1, shardspertrigger=20)
    running = pack.write_blocks(blocks, f"{home}/out", f"{home}/progress", lanes)
    running.processAllAvailable()
    running.stop()
    return pack.read_blocks(spark, f"{home}/out").select(F.md5(_shown(F.col("tokens")).cast("binary")).alias("digest"), F.size("tokens").alias("n"))


def _sound(body):
    """A mono WAV file of 8 bits at 8 kHz whose samples are the given bytes."""
    n = F.octet_length(body)
    four = lambda x: F.unhex(F.concat(*(F.substring(F.lpad(F.hex(x), 8, "0"), k, 2) for k in (7, 5, 3, 1))))  # noqa: E731  the low byte first
    head = lambda text: F.lit(text.encode())
    return F.concat(head("RIFF"), four(n + 36), head("WAVEfmt "), F.unhex(F.lit("1000000001000100401F0000401F000001000800")), head("data"), four(n), body)


@query("""WITH s AS (SELECT CASE WHEN text IS NULL OR doc_id % 11 = 0 THEN 'error_read' WHEN strlen(text) = 0 THEN 'error_empty' WHEN strlen(text) / 8000.0 < 0.1 THEN 'skipped_short' WHEN doc_id % 13 = 0 THEN 'error_store' ELSE 'ok' END AS status, doc_id FROM documents)
SELECT status, count(*) AS n, count(*) AS n_found, CASE WHEN status = 'ok' THEN NULL ELSE sum(doc_id)::BIGINT END AS sources FROM s GROUP BY status""")
def encoded_counts(spark, sf_dir):
    """Texts as sounds, some broken, short or of ids that can't be keys, encoded in one pass: counts of the write itself beside those of what it left."""
    home, i, body = _folder(spark), F.col("doc_id").cast("string"), F.col("text").cast("binary")
    name = F.when(F.col("doc_id") % 13 == 0, F.concat(F.lit("a.b."), i)).otherwise(i)
    sounds = table(spark, sf_dir, "documents").select(F.concat(name, F.lit(".wav")).alias("file_id"), i.alias("audio_filepath"), F.when(F.col("doc_id") % 11 == 0, body).otherwise(_sound(body)).alias("content"))
    done = flows.encode_audio(sounds, "levels", 0.1)
    counts = flows.write_encoded(tar.token_records(done, also=("status", "error", F.col("audio_filepath").alias("source"))), home)
    told = spark.createDataFrame([(s, counts[s]) for s in tables.STATUSES if counts[s]], "status string, n bigint")
    good = tar.read_tokens(spark, home).select(F.lit("ok").alias("status"), F.lit(None).cast("bigint").alias("source"))
    left = good.union(tar.read_errors(spark, home).select("status", F.col("source").cast("bigint"))).groupBy("status").agg(F.count("*").alias("n_found"), F.sum("source").alias("sources"))
    return told.join(left, "status")


@query("""WITH c AS (SELECT label % 5 AS label, list(m ORDER BY i) AS c FROM (SELECT label % 5 AS label, i, avg(x) AS m FROM (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM embeddings) GROUP BY label % 5, i) GROUP BY label % 5)
SELECT vec_id, arg_min(c.label, list_sum(list_transform(range(1, len(c) + 1), lambda k: (c[k] - embedding[k]::DOUBLE) ** 2))) AS cluster FROM embeddings, c GROUP BY vec_id""")
def stored_centroids(spark, sf_dir):
    """Centroids of two models in one store, of which the look-up reads the folder of its key."""
    home, e = f"{_folder(spark)}/centroids", table(spark, sf_dir, "embeddings")
    for k, label in ((10, F.col("label")), (5, F.col("label") % 5)):
        means = quantize.group_means(e.withColumn("label", label), "label", "embedding")
        quantize.save_centroids(means.withColumn("model", F.lit("units")).withColumn("k", F.lit(k)), home, "append")
    return quantize.nearest_centroid(e, quantize.load_centroids(spark, home, "units", 5), "vec_id", "embedding")


@query("""WITH t AS (SELECT 'h.' || doc_id || '.weight' AS key, strlen(text)::BIGINT AS n_params, md5(text) AS digest, doc_id FROM documents WHERE text IS NOT NULL)
SELECT key, n_params, digest FROM t UNION ALL SELECT 'transformer.wte.weight', n_params, digest FROM t WHERE doc_id = (SELECT min(doc_id) FROM t) UNION ALL SELECT 'lm_head.weight', n_params, digest FROM t WHERE doc_id = (SELECT min(doc_id) FROM t)""")
def stored_tensors(spark, sf_dir):
    """Texts as tensors of bytes, in files of three tasks or more by their size, read by ranges; the missing head comes from the embedding."""
    home, docs = _folder(spark), table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.col("text").cast("binary").alias("data"))
    first = docs.agg(F.min("doc_id")).first()[0]
    named = docs.select(F.format_string("h.%d.weight", "doc_id").alias("name"), "data").union(docs.where(F.col("doc_id") == first).select(F.lit("transformer.wte.weight"), "data"))
    rows = named.select("name", F.lit("U8").alias("dtype"), F.array(F.octet_length("data").cast("bigint")).alias("shape"), "data")
    writers = max(3, docs.count() // 20_000)
    tensors.write_tensors(rows.repartition(writers), home, "overwrite")
    read = checkpoints.model_tensors(tensors.read_tensors(spark, home, maxbytes=100_000, taskbytes=32 << 20), tensors.read_tensors(spark, home, data=False, taskbytes=1 << 40))
    whole = read.groupBy("key").agg(F.max("shape").alias("shape"), F.array_sort(F.collect_list(F.struct("part", "data"))).alias("ps"))
    return whole.select("key", grid.parameter_count(F.array("shape")).alias("n_params"), F.md5(F.aggregate("ps", F.lit(b""), lambda a, p: F.concat(a, p["data"]))).alias("digest"))


def _files_of(df: DataFrame, home: str, content: Callable[..., bytes] = bytes) -> int:
    """Write rows (path, and what ``content`` makes its bytes of) as a file each below ``home``, in the tasks that have them; returns how many.

    A file's bytes are made where they are written, one at a time.
    """

    def put(batches):
        store, made = Store(home), set()
        for paths, *parts in batches_of.slices(batches):
            for path, *of in zip(paths, *parts, strict=True):
                folder = path.rpartition("/")[0]
                if folder not in made:
                    Store(f"{home}/{folder}").make()
                    made.add(folder)
                store.write(path, content(*of))
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string())], ["path"])

    return df.mapInArrow(put, "path string").count()


_SOUND_NAME = "CASE doc_id % 5 WHEN 1 THEN 'd' || doc_id || '.WAV' WHEN 2 THEN 'd' || doc_id || '.txt' WHEN 3 THEN '.d' || doc_id || '.wav' ELSE 'd.' || doc_id || '.wav' END"


@query(f"""WITH s AS (SELECT coalesce(lang, 'none') || CASE WHEN doc_id % 3 = 0 THEN '/more/' ELSE '/' END || {_SOUND_NAME} AS path, {_SOUND_NAME} AS name, coalesce(strlen(text), 0)::BIGINT AS n FROM documents WHERE doc_id % 5 <> 2)
SELECT path, name[:-5] AS file_id, n AS n_samples, 8000::BIGINT AS native_rate, CASE WHEN n = 0 THEN 'error_empty' WHEN n < 160 THEN 'error_no_tokens' ELSE 'ok' END AS status FROM s""")
def scanned_sounds(spark, sf_dir):
    """Texts as audio files in folders, found by a walk and encoded where they are read."""
    home, i = _folder(spark), F.col("doc_id").cast("string")
    ending = F.when(F.col("doc_id") % 5 == 1, F.concat(F.lit("d"), i, F.lit(".WAV"))).when(F.col("doc_id") % 5 == 2, F.concat(F.lit("d"), i, F.lit(".txt")))
    name = ending.when(F.col("doc_id") % 5 == 3, F.concat(F.lit(".d"), i, F.lit(".wav"))).otherwise(F.concat(F.lit("d."), i, F.lit(".wav")))
    path = F.concat(F.coalesce("lang", F.lit("none")), F.when(F.col("doc_id") % 3 == 0, "/more/").otherwise("/"), name)
    _files_of(table(spark, sf_dir, "documents").select(path.alias("path"), _sound(F.coalesce(F.col("text").cast("binary"), F.lit(b""))).alias("content")), home)
    found = files.scan_directory(spark, home).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))  # few bytes, much work
    done = flows.encode_paths(found, "audio_filepath", home, "levels", 0.0)
    return done.select(F.regexp_extract("audio_filepath", "/roundtrip-[0-9a-f]+/(.*)$", 1).alias("path"), "file_id", "n_samples", "native_rate", "status")


@query("SELECT doc_id FROM documents WHERE doc_id % 7 = 0")
def checked_shards(spark, sf_dir):
    """A tar file for each text, some cut short; those that can't be listed to their end.

    The files lie in folders by a hash, which tasks fill and list side by side, and end without what fills a tar's last record.
    """
    home = _folder(spark)

    def packed(text: str | None, short: bool) -> bytes:
        out, body = io.BytesIO(), f"{text or ''} and more".encode()
        with tarfile.open(fileobj=out, mode="w") as t:
            info = tarfile.TarInfo("a.json")
            info.size = len(body)
            t.addfile(info, io.BytesIO(body))
        return out.getvalue()[: 515 if short else t.offset]

    path = F.format_string("t/%d/%d.tar", F.pmod(F.hash("doc_id"), F.lit(256)), "doc_id").alias("path")
    docs = table(spark, sf_dir, "documents").select(path, "text", (F.col("doc_id") % 7 == 0).alias("short"))
    _files_of(docs, home, packed)
    return tar.broken_shards(spark, f"{home}/t/*/*.tar").select(F.regexp_extract("path", r"(\d+)\.tar$", 1).cast("bigint").alias("doc_id"))


@query("""WITH s AS (SELECT 2 * (o_custkey % 800) AS n FROM orders UNION ALL SELECT o_orderkey % 1200 FROM orders)
SELECT CASE WHEN n = 0 THEN 'error_empty' WHEN n < 800 THEN 'skipped_short' ELSE 'ok' END AS status, count(*) AS n FROM s GROUP BY 1 UNION ALL SELECT 'metadata', 2 * count(*) FROM orders UNION ALL SELECT 'stored', count(*) FROM s WHERE n >= 800""")
def prepared_pairs(spark, sf_dir):
    """Pairs with embedded audio to shards and metadata, which also has the samples that were skipped."""
    home, voice = _folder(spark), F.when(F.col("o_orderkey") % 2 == 0, "AM").otherwise("PM").alias("voice")
    side = lambda text, n: F.struct(_sound(F.repeat(F.lit(text), n.cast("int")).cast("binary")).alias("bytes"))
    o = table(spark, sf_dir, "orders")
    words = [F.col(c).alias(f"{p}_{f}") for p, c in (("positive", "o_orderpriority"), ("negative", "o_orderstatus")) for f in ("word", "phones")]
    o.select(F.col("o_orderkey").alias("id"), voice, side("ab", F.col("o_custkey") % 800).alias("positive"), side("b", F.col("o_orderkey") % 1200).alias("negative"), *words).write.parquet(f"{home}/pairs/p.parquet")
    told = flows.prepare_pairs(spark, f"{home}/pairs/*.parquet", "levels", f"{home}/shards", f"{home}/meta.csv", 0.1)
    meta = evaluate.read_scored(spark, f"{home}/meta.csv").agg(F.lit("metadata").alias("status"), F.count("positive").alias("n"))
    stored = tar.read_tokens(spark, f"{home}/shards").agg(F.lit("stored").alias("status"), F.count_distinct("key").alias("n"))
    return told.union(meta).union(stored)


@query(f"WITH {_SEQ} SELECT user_id, round(-(len(t) + 1) * ln(7), 6) AS log_prob, round(-ln(7), 6) AS log_prob_norm, (len(t) + 1)::BIGINT AS num_tokens FROM q")
def plugged_scores(spark, sf_dir):
    """A scorer that plugs in, here one to which all seven tokens are alike, over wrapped sequences."""
    seqs = event_sequences(spark, sf_dir).select("user_id", sequences.wrap(F.col("tokens"), 5, 6).alias("tokens"))
    return _rounded(bigrams.score_with(seqs, lambda: lambda ss: [(-(len(s) - 1) * math.log(7), len(s) - 1) for s in ss], "user_id", "tokens"))


@query("SELECT 'docs' AS name, 'csv' AS kind, count(*) AS n, count(DISTINCT doc_id) AS n_paths FROM documents UNION ALL SELECT 'pages', 'parquet', count(*), count(DISTINCT url) FROM pages")
def resolved_manifests(spark, sf_dir):
    """Manifests under their names in a folder, one of each format; a file that is there wins over its name with a suffix."""
    home = _folder(spark)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("file_id"), F.format_string("d/%d.wav", "doc_id").alias("audio_filepath"))
    tables.save_manifest(docs, f"{home}/docs.csv")
    table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("file_id"), F.col("url").alias("path")).write.parquet(f"{home}/pages.parquet")
    out = None
    for name in ("docs", "pages"):
        path = tables.resolve_manifest(spark, name, home)
        loaded = tables.load_manifest(spark, path)
        one = loaded.agg(F.lit(name).alias("name"), F.lit(path.rpartition(".")[2]).alias("kind"), F.count("*").alias("n"), F.count_distinct("audio_filepath").alias("n_paths"))
        out = one if out is None else out.union(one)
    return out
