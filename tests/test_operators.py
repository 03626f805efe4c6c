"""Operators against plain Python models and hand-made cases."""

import io
import math
import os
import tarfile
import wave

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tokenloom.functions import names, sequences
from tokenloom.operators import bigrams, blocks, encoders, metrics, positions, tables
from tokenloom.sources import files, tar
from tokenloom.streaming.pack import stream_pack

ROWS = "group_id string, positive boolean, s double, voice string"


def accuracy(rows):
    groups = {}
    for g, p, s, _ in rows:
        if g is not None and p is not None and s is not None:
            groups.setdefault(g, ([], []))[0 if p else 1].append(s)
    each = [np.mean([[a > b for b in n] for a in p]) for p, n in groups.values() if p and n]
    return float(np.mean(each)) if each else 0.0


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.sampled_from([True, False, None]), st.one_of(st.none(), st.sampled_from([0.0, 1.0, 2.0, -1.0, math.nan, math.inf])), st.sampled_from(["x", "y"])), max_size=30))
def test_accuracy_rules(spark, rows):
    df = spark.createDataFrame(rows, ROWS)
    for f in (metrics.discrimination_accuracy, metrics.discrimination_accuracy_pairs):
        assert f(df, "s").first().accuracy == pytest.approx(accuracy(rows))
    by = {r.voice: r.accuracy for r in metrics.accuracy_by(df, "voice", "s").collect()}
    assert by == pytest.approx({v: accuracy([r for r in rows if r[3] == v]) for v in {r[3] for r in rows}})


@pytest.mark.parametrize(
    ("pos", "neg", "want", "collapsed"),
    [([-1, -3], [-2, -2], 0.5, 0.5), ([-1], [-1], 0.0, 0.0), ([-1, -1, -3], [-2], 2 / 3, 0.5), ([math.nan], [-2], 0.0, 1.0), ([None], [-2], 0.0, 0.0)],
)
def test_accuracy_cases(spark, pos, neg, want, collapsed):
    num = lambda x: None if x is None else float(x)
    df = spark.createDataFrame([("g", True, num(x), "v") for x in pos] + [("g", False, num(x), "v") for x in neg], ROWS)
    assert metrics.discrimination_accuracy(df, "s").first().accuracy == pytest.approx(want)
    assert metrics.collapsed_accuracy(df, "s").first().accuracy == pytest.approx(collapsed)


def test_summary_and_unique(spark):
    df = spark.createDataFrame([(x,) for x in (1.0, 2.0, 3.0, 10.0, None)], "s double")
    r = metrics.score_summary(df, "s").first()
    assert (r.total, r.scored, r.missing, r.median) == (5, 4, 1, 2.5) and r.std_samp == pytest.approx(4.0825, abs=1e-4) and r.std_pop == pytest.approx(3.5355, abs=1e-4)
    assert df.agg(metrics.n_unique(F.col("s"))).first()[0] == 5


@pytest.mark.parametrize(("n", "tasks", "want"), [(2, 5, [0, 0, 0, 0, 2]), (10, 3, [3, 3, 4]), (0, 3, [0, 0, 0])])
def test_contiguous(spark, n, tasks, want):
    got = positions.contiguous(spark.range(n).toDF("i"), ["i"], tasks).groupBy("task").count().collect()
    assert [dict((r.task, r["count"]) for r in got).get(t, 0) for t in range(tasks)] == want


def test_strided(spark):
    assert [positions.strided(spark.range(10).toDF("i"), ["i"], 3, t).count() for t in range(3)] == [4, 3, 3]


@pytest.mark.parametrize(("length", "want"), [(2047, 0), (2048, 1), (2049, 1)])
def test_pack_boundary(spark, length, want):
    df = spark.createDataFrame([(1, [7] * (length - 6)), (2, [8, 9])], "i int, t array<int>")
    got = blocks.pack_blocks(df, ["i"], "t", 256, 257).collect()
    assert len(got) == want
    if want:
        assert got[0].tokens == ([256] + [7] * (length - 6) + [257, 256, 8, 9, 257])[:2048]


@settings(max_examples=6, deadline=None)
@given(st.lists(st.lists(st.integers(0, 5), max_size=20), max_size=12))
def test_pack_and_collapse(spark, seqs):
    df = spark.createDataFrame(list(enumerate(seqs)), "i int, t array<int>")
    flat = [x for s in seqs for x in [6, *s, 7]]
    got = {r.block_id: r.tokens for r in blocks.pack_blocks(df, ["i"], "t", 6, 7, 8).collect()}
    assert got == {k: flat[8 * k : 8 * k + 8] for k in range(len(flat) // 8)}
    for r in df.select("t", sequences.collapse_repeats(F.col("t")).alias("u")).collect():
        assert r.u == [x for k, x in enumerate(r.t) if k == 0 or x != r.t[k - 1]]


def test_eval_blocks_repeat(spark):
    df = spark.createDataFrame([(1, [1, 2])], "i int, t array<int>")
    assert blocks.eval_blocks(df, ["i"], "t", 8, 9, 3, 10).count() == 10
    with pytest.raises(ValueError):
        blocks.eval_blocks(df.limit(0), ["i"], "t", 8, 9)


def test_names(spark):
    paths = ["/d/a.b.wav", "/d/.hid", "/d/x.tar.gz", "/d/a..b", "/d/plain", "/D/UP.WAV"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    p = F.col("p")
    got = [tuple(r) for r in df.select(names.stem(p), names.suffix(p), names.is_audio(p), names.segment_key(names.stem(p))).collect()]
    assert got == [("a.b", ".wav", True, "a_s000"), (".hid", "", False, ".hid_s000"), ("x.tar", ".gz", False, "x_s000"), ("a.", ".b", False, got[3][3]), ("plain", "", False, "plain_s000"), ("UP", ".wav", True, "UP_s000")]
    (r,) = spark.createDataFrame([("g", None, True)], "g string, v string, p boolean").select(names.sample_key(F.col("g"), F.col("v"), F.col("p")).alias("k")).collect()
    assert r.k is None


def test_status_edges(spark):
    df = spark.createDataFrame([(0, [1]), (2999, [1]), (3000, [1]), (9000, None), (9000, [])], "n int, t array<int>")
    got = [r[0] for r in df.select(tables.status(F.col("n"), F.lit(1000), F.col("t"))).collect()]
    assert got == ["error_empty", "skipped_short", "ok", "error_encode", "error_no_tokens"]


def test_manifests(spark, tmp_path):
    spark.createDataFrame([("a", "/x/a.wav", "k")], "file_id string, path string, more string").write.parquet(f"{tmp_path}/m.parquet")
    found = tables.resolve_manifest(spark, "m", str(tmp_path))
    assert tables.load_manifest(spark, found).columns == ["file_id", "audio_filepath", "more"]
    both = spark.createDataFrame([("a", "p", "q")], "file_id string, path string, audio_filepath string")
    assert tables.adapt_manifest(both).first().audio_filepath == "q" and tables.adapt_manifest(both, prefer_path=True).first().audio_filepath == "p"
    with pytest.raises(ValueError):
        tables.adapt_manifest(both.select("path"))
    with pytest.raises(FileNotFoundError):
        tables.resolve_manifest(spark, "none", str(tmp_path))
    a, b = spark.createDataFrame([("1", "2")], "x string, y string"), spark.createDataFrame([("3", "4")], "y string, z string")
    for kind in ("csv", "jsonl"):
        tables.save_rows([a, b], f"{tmp_path}/r.{kind}")
        got = tables.load_rows(spark, f"{tmp_path}/r.{kind}")
        assert sorted(got.columns) == ["x", "y", "z"] and got.count() == 2


def test_token_shards(spark, tmp_path):
    rows = [(f"k{i:03d}", [i, i, 1], f'{{"file_id":"{i}"}}' if i % 2 else None) for i in range(25)]
    df = spark.createDataFrame(rows, "key string, tokens array<smallint>, meta string").repartition(2)
    tar.write_tokens(df, f"{tmp_path}/t", maxrecords=4)
    shards = sorted(os.listdir(f"{tmp_path}/t"))
    assert len(shards) >= 7 and all(s.endswith(".tar") for s in shards)
    assert sorted((r.key, r.tokens, r.meta) for r in tar.read_tokens(spark, f"{tmp_path}/t").collect()) == rows
    tar.write_tokens(spark.createDataFrame([("k000", [9], None)], df.schema).coalesce(1), f"{tmp_path}/u")
    os.rename(f"{tmp_path}/u/task000-shard000.tar", f"{tmp_path}/t/zz.tar")
    assert dict(map(tuple, tar.load_last(spark, f"{tmp_path}/t").collect()))["k000"] == [9]
    with open(f"{tmp_path}/t/{shards[0]}", "rb") as f:
        head = f.read()[:700]
    with open(f"{tmp_path}/t/broken.tar", "wb") as f:
        f.write(head)
    assert [os.path.basename(r.path) for r in tar.broken_shards(spark, f"{tmp_path}/t/*.tar").collect()] == ["broken.tar"]
    with pytest.raises(Exception, match="no .tar shards"):
        tar.read_tokens(spark, f"{tmp_path}").collect()
    with tarfile.open(f"{tmp_path}/t/aa.tar", "w") as t:  # a record without tokens is skipped
        info = tarfile.TarInfo("only.json")
        info.size = 2
        t.addfile(info, io.BytesIO(b"{}"))
    assert list(tar.records(f"{tmp_path}/t/aa.tar")) == []


def wav(x, rate, channels=1):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((np.asarray(x) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def test_scan_and_audio(spark, tmp_path):
    tone = np.sin(np.arange(8000) * 2 * np.pi * 440 / 8000) * 0.5
    for name in ("a/b.wav", "a-b/c.WAV", "a/_h.flac", "root.wav", "a/n.txt"):
        p = tmp_path / "s" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(wav(tone, 8000) if name.lower().endswith("wav") else b"x")
    got = [os.path.relpath(r.audio_filepath, tmp_path / "s") for r in files.scan_directory(spark, str(tmp_path / "s")).collect()]
    assert got == ["a/_h.flac", "a/b.wav", "a-b/c.WAV"]
    assert files.scan_directory(spark, str(tmp_path / "s"), with_root=True).count() == 4
    assert sorted(r.file_id for r in files.scan_store(spark, str(tmp_path / "s")).collect()) == ["b", "c", "root"]
    loaded = files.load_audio(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(str(tmp_path / "s")).where("path NOT LIKE '%.txt'"))
    ok = loaded.where("error IS NULL").select("rate", "n_samples", "native_rate", F.size("wave").alias("n"), "wave").collect()
    assert {(r.rate, r.n_samples, r.native_rate, r.n) for r in ok} == {(16000, 8000, 8000, 16000)}
    want = np.sin(np.arange(16000) * 2 * np.pi * 440 / 16000) * 0.5
    assert np.abs(np.array(ok[0].wave)[200:-200] - want[200:-200]).max() < 0.02
    assert files.decode_wav(wav([0.5, -0.5, 0.25, -0.25], 8000, 2))[0] == pytest.approx([0.5, 0.25], abs=1e-3)


def test_encoders(spark):
    assert [(v.bos, v.eos, v.size) for v in map(encoders.vocabulary, ("spidr_base", "mhubert", "hubert-500"))] == [(256, 257, 258), (2000, 2001, 2002), (500, 501, 502)]
    with pytest.raises(ValueError):
        encoders.vocabulary("none")
    rng = np.random.default_rng(0)
    df = spark.createDataFrame([(1, rng.random(16000).tolist(), 16000), (2, None, 16000)], "i int, w array<float>, r int")
    e = encoders.encoder_udf("levels")
    a, b = (sorted(map(tuple, df.select("i", e("w", "r").alias("x")).select("i", "x.*").collect())) for _ in range(2))
    assert a == b and a[0][1] and all(0 <= t < 256 for t in a[0][1]) and all(x != y for x, y in zip(a[0][1], a[0][1][1:]))
    assert a[1][1] is None and a[1][2]


def test_plugged_scorer(spark):
    df = spark.createDataFrame([("a", [5, 1, 6]), ("b", None)], "k string, t array<int>")
    got = {r.k: tuple(r)[1:] for r in bigrams.score_with(df, lambda: lambda seqs: [(-1.0 * len(s), len(s) - 1) for s in seqs], "k", "t").collect()}
    assert got == {"a": (-3.0, -1.5, 2), "b": (None, None, None)}


def test_stream_pack(spark, tmp_path):
    rng = np.random.default_rng(1)
    seqs = [(i, rng.integers(0, 5, 7).tolist()) for i in range(30)]
    for k in range(3):
        spark.createDataFrame(seqs[k * 10 : k * 10 + 10], "i bigint, t array<int>").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema("i bigint, t array<int>").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    q = stream_pack(stream, "t", 5, 6, 16, "i", lanes=1).writeStream.format("memory").queryName("packed").option("checkpointLocation", f"{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    got = {r.block_id: r.tokens for r in spark.table("packed").collect()}
    assert sorted(got) == list(range(30 * 9 // 16)) and all(len(t) == 16 for t in got.values())
    flat = [x for k in sorted(got) for x in got[k]]
    assert flat.count(5) >= 29 and flat[0] == 5
