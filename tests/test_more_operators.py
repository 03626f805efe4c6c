"""Operators against hand-made results: positions, shards of repeated writes, ties, models, checkpoints, flows and reports."""

import glob
import io
import os
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from tokenloom import session
from tokenloom.functions import names
from tokenloom.operators import bigrams, checkpoints, encoders, evaluate, grid, metrics, models, positions, quantize, tables
from tokenloom.plans import flows
from tokenloom.sources import files, tar
from tokenloom.streaming.pack import stream_pack


def wav(x, rate, width=2):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(width)
        w.setframerate(rate)
        whole = np.round(np.asarray(x) * (2 ** (8 * width - 1) - 1)).astype("<i4")
        w.writeframes(whole.view(np.uint8).reshape(-1, 4)[:, :width].tobytes())
    return out.getvalue()


def test_running_keeps_all_columns(spark):
    rows = [(3, 30, "a", None), (1, 10, "b", 1.5), (2, 20, "c", 2.5), (None, 5, "d", 0.0), (2, 20, "c", 2.5)]
    df = spark.createDataFrame(rows, "i int, _size int, _part string, _place double")
    got = positions.with_running(df, ["i"], F.col("_size"), "at")
    assert got.columns == ["i", "_size", "_part", "_place", "at"]
    assert sorted((tuple(r) for r in got.collect()), key=lambda r: r[4]) == [(None, 5, "d", 0.0, 0), (1, 10, "b", 1.5, 5), (2, 20, "c", 2.5, 15), (2, 20, "c", 2.5, 35), (3, 30, "a", None, 55)]
    with pytest.raises(ValueError, match="position"):
        positions.with_running(spark.range(3).withColumnRenamed("id", "position"), ["position"])
    placed = positions.within(df.select("_part", "i"), ["_part"], ["i"], "k").collect()
    assert sorted(r.k for r in placed if r._part == "c") == [1, 2] and positions.with_running(df.limit(0), ["i"]).count() == 0


def test_task_shard(spark):
    df = spark.range(10).select(F.format_string("p%02d", "id").alias("path"))
    got = [(n, k, list(x)) for n, k, x in (positions.task_shard(df, ["path"], "path", 3, t) for t in range(3))]
    assert got == [(10, 3, ["p00", "p01", "p02"]), (10, 3, ["p03", "p04", "p05"]), (10, 4, ["p06", "p07", "p08", "p09"])]
    assert [positions.task_shard(df.limit(2), ["path"], "path", 5, t)[1] for t in (0, 4)] == [0, 2]


def test_lanes_of_a_stream(spark, tmp_path):
    """As many lanes as shuffle partitions; null sequences give nothing, empty ones their marks."""
    rows = [(i, None if i % 10 == 0 else [1] * (i % 4)) for i in range(200)]
    spark.createDataFrame(rows, "i bigint, t array<int>").write.parquet(f"{tmp_path}/in")
    stream = stream_pack(spark.readStream.schema("i bigint, t array<int>").parquet(f"{tmp_path}/in"), "t", 5, 6, 4, "i")
    q = stream.writeStream.format("memory").queryName("lanes").option("checkpointLocation", f"{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("lanes").collect()
    lanes = int(spark.conf.get("spark.sql.shuffle.partitions"))
    total = sum(len(t) + 2 for _, t in rows if t is not None)
    assert len({r.lane for r in got}) == lanes and total - 4 * lanes < 4 * len(got) <= total
    for lane in {r.lane for r in got}:
        assert sorted(r.block_id for r in got if r.lane == lane) == list(range(sum(r.lane == lane for r in got)))


def test_wide_columns_are_not_checkpointed(spark, monkeypatch):
    seen = []
    real = positions.cut
    monkeypatch.setattr(positions, "cut", lambda d: seen.append(d.columns) or real(d))
    df = spark.range(20).select("id", F.array_repeat(F.lit(1), 50).alias("tokens"))
    assert positions.with_running(df, ["id"], F.size("tokens"), "at").agg(F.max("at")).first()[0] == 950
    assert len(seen) == 1 and "tokens" not in seen[0]


def test_appended_shards(spark, tmp_path):
    make = lambda *keys: spark.createDataFrame([(k, [1, 2]) for k in keys], "key string, tokens array<smallint>").coalesce(1)
    home = f"{tmp_path}/t"
    tar.write_tokens(make("a"), home)
    tar.write_tokens(make("b", "c"), home, mode="append", maxrecords=1)
    assert sorted(os.listdir(home)) == [f"task000-shard00{k}.tar" for k in range(3)]
    assert sorted(r.key for r in tar.read_tokens(spark, home).collect()) == ["a", "b", "c"]
    tar.write_tokens(make("d"), home)
    assert os.listdir(home) == ["task000-shard000.tar"] and [r.key for r in tar.read_tokens(spark, home).collect()] == ["d"]
    tar.write_tokens(make("e", "f"), f"{tmp_path}/s", naming="shard", maxrecords=1)
    assert sorted(os.listdir(f"{tmp_path}/s")) == ["shard-000.tar", "shard-001.tar"]
    for bad in ("1.5_AM_pos", "x/y", ""):
        with pytest.raises(Exception, match="can't be stored"):
            tar.write_tokens(make("ok", bad), home)
        assert os.listdir(home) == ["task000-shard000.tar"] and not glob.glob(f"{home}/.*.part")
    assert [r.key for r in tar.read_tokens(spark, home).collect()] == ["d"]


def test_resampled_stream(spark, tmp_path):
    df = spark.range(40).select(F.format_string("k%d", "id").alias("key"), F.array(F.lit(1).cast("smallint")).alias("tokens"))
    tar.write_tokens(df.coalesce(1), f"{tmp_path}/t", maxrecords=10)
    with open(f"{tmp_path}/t/zz.tar", "wb") as f:
        f.write(b"no tar at all" * 90)
    seen = []
    for turn in range(2):
        stream = tar.stream_tokens(spark, f"{tmp_path}/t", seed=7, shards=12).writeStream.format("memory").queryName(f"drawn{turn}").option("checkpointLocation", f"{tmp_path}/c{turn}").trigger(processingTime="100 milliseconds").start()
        for _ in range(600):
            if spark.table(f"drawn{turn}").count() >= 100:
                break
            stream.awaitTermination(0.1)
        stream.stop()
        seen.append([tuple(r) for r in spark.table(f"drawn{turn}").groupBy("shard").count().orderBy("shard").collect()])
        assert spark.table(f"drawn{turn}").count() >= 100  # more records than there are, without the bad shard's
        assert {s for s, _ in seen[-1]} == {f"task000-shard00{k}.tar" for k in range(4)}
    with pytest.raises(Exception, match="no .tar shards"):
        tar.stream_tokens(spark, f"{tmp_path}/none").writeStream.format("memory").queryName("none").start().processAllAvailable()


def test_centroid_ties(spark, monkeypatch):
    rng = np.random.default_rng(3)
    for _ in range(300):
        table = rng.integers(-2, 3, (rng.integers(2, 9), 4)).astype(float) * rng.choice([1e-3, 1, 1e6])
        x = np.array([(table[0] + table[1]) / 2, *rng.integers(-2, 3, (3, 4)).astype(float)])
        first, least = quantize._nearest(x, table, (table**2).sum(1))
        exact = ((x[:, None] - table[None]) ** 2).sum(2)
        assert (first == exact.argmin(1)).all() and (least == exact.min(1)).all()
    rows = [(k, [float(k % 7), 1.0]) for k in range(50)] + [(50, None), (51, [1.0]), (0, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "i int, v array<double>")
    cents = spark.createDataFrame([(9, [0.0, 0.0]), (4, [0.0, 2.0]), (5, [6.0, 1.0]), (7, [3.0, 1.0]), (8, [3.0, 1.0]), (1, None)], "cluster int, centroid array<double>")
    want = sorted((i, min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in ((9, (0, 0)), (4, (0, 2)), (5, (6, 1)), (7, (3, 1)), (8, (3, 1))))[1]) for i, v in rows if v and len(v) == 2)
    for held in (4, 4_000_000):  # in five parts and in one
        monkeypatch.setattr(quantize, "HELD", held)
        assert sorted(map(tuple, quantize.nearest_centroid(df, cents, "i", "v").collect())) == want
    assert quantize.nearest_centroid(df, cents.limit(0), "i", "v").count() == 0


def test_collapsed_ranks_against_pairs(spark):
    rng = np.random.default_rng(4)
    rows = [(int(rng.integers(6)) if rng.random() > 0.05 else None, bool(rng.random() < 0.5) if rng.random() > 0.05 else None, float(rng.choice([-1.0, 0.5, 0.5, 2.0, 7.0, float("nan")])) if rng.random() > 0.1 else None) for _ in range(400)]
    df = spark.createDataFrame(rows, "group_id int, positive boolean, s double")
    above = lambda p, n: (np.isnan(p) and not np.isnan(n)) or p > n
    each = []
    for g in range(6):
        pos, neg = ([s for k, p, s in rows if k == g and p is flag and s is not None] for flag in (True, False))
        once = {("nan" if np.isnan(p) else p): p for p in pos}.values()
        if pos and neg:
            each.append(np.mean([np.mean([above(p, n) for n in neg]) for p in once]))
    got = metrics.collapsed_accuracy(df, "s").first()
    assert got.accuracy == pytest.approx(np.mean(each)) and got.n_groups == len(each)
    assert metrics.discrimination_accuracy(df, "s").first().accuracy == pytest.approx(metrics.discrimination_accuracy_pairs(df, "s").first().accuracy)


def test_narrow_scores_of_a_large_group(spark):
    """A group whose scores all lie near one another is still dealt over many ranges."""
    df = spark.range(5000).select(F.lit(1).alias("group_id"), (F.col("id") % 2 == 0).alias("positive"), (1e6 + F.col("id") / 1e6).alias("s"))
    df = df.union(spark.range(10).select(F.lit(2), F.col("id") % 2 == 0, F.col("id").cast("double")))
    assert metrics.group_accuracy(df, "s", "positive", ["group_id"]).where("group_id = 1").first().won == sum(range(2500))


def test_report_columns(spark):
    df = spark.createDataFrame([(1, True, 2.0), (1, False, 1.0)], "word_id int, positive boolean, log_prob double")
    assert [tuple(r) for r in metrics.accuracy_report(df).collect()] == [("log_prob", None, 1.0, 1)]
    with pytest.raises(ValueError):
        metrics.accuracy_report(df.drop("log_prob"))


def test_encoders_need_their_weights(spark):
    with pytest.raises(ValueError, match="no encoder is registered for hubert-500"):
        encoders.encoder_udf("hubert-500")
    df = spark.createDataFrame([(1, ([1], None)), (2, (None, "boom")), (3, (None, "x: Cannot subsample F0 here"))], "i int, encoded struct<tokens:array<int>,error:string>")
    good, bad = encoders.split_errors(df)
    assert [r.i for r in good.collect()] == [1] and sorted((r.i, r.shown) for r in bad.collect()) == [(2, True), (3, False)]


def test_flows(spark, tmp_path):
    rng = np.random.default_rng(5)
    sound = lambda seconds, rate=8000, **k: wav(rng.random(int(seconds * rate)) * 0.9, rate, **k)
    for name, body in {"a/one.wav": sound(3.0), "a/two.b.wav": sound(3.5, width=3), "b/short.wav": sound(2.9), "b/bad.wav": b"RIFF", "b/none.wav": sound(0)}.items():
        os.makedirs(os.path.dirname(f"{tmp_path}/s/{name}"), exist_ok=True)
        with open(f"{tmp_path}/s/{name}", "wb") as f:
            f.write(body)
    manifest = files.scan_directory(spark, f"{tmp_path}/s").union(spark.createDataFrame([("gone", "/no/such.wav")], "a string, b string"))
    got = flows.encode_manifest(spark, manifest, f"{tmp_path}/s", "levels", f"{tmp_path}/t")
    assert {r.status: r.n for r in got.collect()} == {"ok": 2, "skipped_short": 1, "error_read": 2, "error_empty": 1}
    rows = {r.key: r for r in tar.with_meta(tar.read_tokens(spark, f"{tmp_path}/t")).collect()}
    assert sorted(rows) == ["one_s000", "two_s000"] and rows["two_s000"].meta.file_id == "two.b" and rows["one_s000"].meta.token_count == len(rows["one_s000"].tokens) > 0

    pair = lambda k, a, b: (k, "AM", (a, 1), (b, 1), f"w{k}", f"n{k}", "p", "q")
    schema = "id int, voice string, positive struct<bytes:binary,n:int>, negative struct<bytes:binary,n:int>, positive_word string, negative_word string, positive_phones string, negative_phones string"
    spark.createDataFrame([pair(1, sound(0.5), sound(0.49)), pair(2, sound(0.7), b"no")], schema).write.parquet(f"{tmp_path}/p/x.parquet")
    got = flows.prepare_pairs(spark, f"{tmp_path}/p/*.parquet", "levels", f"{tmp_path}/u", f"{tmp_path}/m.csv")
    assert {r.status: r.n for r in got.collect()} == {"ok": 2, "skipped_short": 1, "error_read": 1}
    assert sorted(r.key for r in tar.read_tokens(spark, f"{tmp_path}/u").collect()) == ["1_AM_pos", "2_AM_pos"] and "shard-000.tar" in os.listdir(f"{tmp_path}/u")
    meta = evaluate.read_scored(spark, f"{tmp_path}/m.csv")
    assert sorted(meta.columns) == ["file_id", "group_id", "phones", "positive", "voice", "word"] and meta.count() == 4


def test_cached_scores_and_folders(spark, tmp_path):
    made = []
    df = spark.createDataFrame([("a", True, 1.0), ("a", False, None)], "group_id string, positive boolean, log_prob double")
    for force, times in ((False, 1), (False, 1), (True, 2)):
        got = evaluate.scored_once(spark, f"{tmp_path}/x.csv", lambda: made.append(1) or df, force)
        assert len(made) == times and got.dtypes == df.dtypes and got.count() == 2
    os.makedirs(f"{tmp_path}/r")
    with open(f"{tmp_path}/r/base_lstm_h8.csv", "w") as f:
        f.write("group_id,positive,log_prob_norm\n1,true,2.0\n1,false,1.0\n2,true,x\n")
    with open(f"{tmp_path}/r/base_gpt2_e4.csv", "w") as f:
        f.write("group_id,positive\n1,true\n")
    with open(f"{tmp_path}/r/empty_lstm_h1.csv", "w") as f:
        f.write("")
    assert [tuple(r) for r in evaluate.model_results(spark, f"{tmp_path}/r").collect()] == [("base", "lstm", 8, 1.0, "base_lstm_h8")]


def test_checkpoints(spark, tmp_path):
    keys = lambda *k: spark.createDataFrame([(x,) for x in k], "key string")
    tied = checkpoints.with_tied_head(keys("transformer.wte.weight", "x")).collect()
    assert sorted(map(tuple, tied)) == [("lm_head.weight", "transformer.wte.weight"), ("transformer.wte.weight", "transformer.wte.weight"), ("x", "x")]
    assert checkpoints.with_tied_head(keys("lm_head.weight", "transformer.wte.weight")).count() == 2 and checkpoints.with_tied_head(keys("x")).count() == 1
    for name in ("lstm_a", "lstm_b", "gpt2_c"):
        os.makedirs(f"{tmp_path}/m/{name}")
    os.utime(f"{tmp_path}/m/lstm_a", (2e9, 2e9))
    found = checkpoints.model_folders(spark, f"{tmp_path}/m")
    assert checkpoints.latest_model(found, F.lit("lstm")).first().path.endswith("lstm_a") and checkpoints.latest_model(found, F.lit("no")).count() == 0
    assert checkpoints.model_folders(spark, f"{tmp_path}/none").count() == 0
    with open(f"{tmp_path}/m/lstm_a/config.json", "w") as f:
        f.write('{\n "model_type": "lstm", "hidden_size": 3\n}')
    with open(f"{tmp_path}/m/gpt2_c/config.json", "w") as f:
        f.write("{}")
    assert checkpoints.model_type(spark, f"{tmp_path}/m/lstm_a") == "lstm" and checkpoints.model_type(spark, f"{tmp_path}/m/gpt2_c") == "gpt2"


def test_lstm(spark, tmp_path):
    rng, v, e, n = np.random.default_rng(1), 7, 4, 3
    w = {"embedding.weight": rng.standard_normal((v, e)), "output.weight": rng.standard_normal((v, n)), "output.bias": rng.standard_normal(v)}
    for k, wide in ((0, e), (1, n)):
        w |= {f"lstm.weight_ih_l{k}": rng.standard_normal((4 * n, wide)), f"lstm.weight_hh_l{k}": rng.standard_normal((4 * n, n)), f"lstm.bias_ih_l{k}": rng.standard_normal(4 * n), f"lstm.bias_hh_l{k}": rng.standard_normal(4 * n)}
    sig = lambda x: 1 / (1 + np.exp(-x))

    def plain(seq):
        h, c, total = [[0.0] * n, [0.0] * n], [[0.0] * n, [0.0] * n], 0.0
        for now, nxt in zip(seq, seq[1:]):
            x = list(w["embedding.weight"][now])
            for k in (0, 1):
                g = [sum(a * b for a, b in zip(w[f"lstm.weight_ih_l{k}"][r], x)) + sum(a * b for a, b in zip(w[f"lstm.weight_hh_l{k}"][r], h[k])) + w[f"lstm.bias_ih_l{k}"][r] + w[f"lstm.bias_hh_l{k}"][r] for r in range(4 * n)]
                c[k] = [sig(g[n + u]) * c[k][u] + sig(g[u]) * np.tanh(g[2 * n + u]) for u in range(n)]
                h[k] = x = [sig(g[3 * n + u]) * np.tanh(c[k][u]) for u in range(n)]
            z = [sum(a * b for a, b in zip(row, x)) + b0 for row, b0 in zip(w["output.weight"], w["output.bias"])]
            total += z[nxt] - np.log(sum(np.exp(z)))
        return total

    os.makedirs(f"{tmp_path}/m")
    np.savez(f"{tmp_path}/m/model.npz", **w)
    with open(f"{tmp_path}/m/config.json", "w") as f:
        f.write('{"model_type": "lstm"}')
    rows = [("a", [5, 1, 2, 6]), ("b", [5, 6]), ("c", [5]), ("d", None)]
    got = {r.k: r for r in bigrams.score_with(spark.createDataFrame(rows, "k string, t array<int>"), checkpoints.loader(spark, f"{tmp_path}/m"), "k", "t").collect()}
    for k, seq in rows[:2]:
        assert got[k].log_prob == pytest.approx(plain(seq)) and got[k].num_tokens == len(seq) - 1 and got[k].log_prob_norm == pytest.approx(plain(seq) / (len(seq) - 1))
    assert tuple(got["c"])[1:] == (0.0, 0.0, 0) and got["d"].log_prob is None


def test_gpt2():
    rng, v, d, heads = np.random.default_rng(2), 6, 4, 2
    r = lambda *s: rng.standard_normal(s) * 0.5
    w = {"transformer.wte.weight": r(v, d), "transformer.wpe.weight": r(9, d), "transformer.ln_f.weight": r(d), "transformer.ln_f.bias": r(d)}
    for k in (0, 1):
        at = f"transformer.h.{k}"
        w |= {f"{at}.{p}.{x}": r(d) for p in ("ln_1", "ln_2") for x in ("weight", "bias")}
        for p, a, b in (("attn.c_attn", d, 3 * d), ("attn.c_proj", d, d), ("mlp.c_fc", d, 4 * d), ("mlp.c_proj", 4 * d, d)):
            w |= {f"{at}.{p}.weight": r(a, b), f"{at}.{p}.bias": r(b)}
    norm = lambda x, n: [(a - np.mean(x)) / np.sqrt(np.var(x) + 1e-5) * g + b for a, g, b in zip(x, w[f"{n}.weight"], w[f"{n}.bias"])]
    lin = lambda x, n: [sum(a * b for a, b in zip(x, col)) + b0 for col, b0 in zip(w[f"{n}.weight"].T, w[f"{n}.bias"])]

    def plain(seq):
        xs = [w["transformer.wte.weight"][t] + w["transformer.wpe.weight"][i] for i, t in enumerate(seq)]
        for k in (0, 1):
            at, size = f"transformer.h.{k}", d // heads
            qkv = [lin(norm(x, f"{at}.ln_1"), f"{at}.attn.c_attn") for x in xs]
            mixed = []
            for i in range(len(xs)):
                out = []
                for h in range(heads):
                    part = lambda j, which: qkv[j][which * d + h * size : which * d + (h + 1) * size]  # noqa: B023, E731
                    e = [np.exp(np.dot(part(i, 0), part(j, 1)) / np.sqrt(size)) for j in range(i + 1)]
                    out += list(sum(a / sum(e) * np.array(part(j, 2)) for j, a in enumerate(e)))
                mixed.append(out)
            xs = [x + np.array(lin(m, f"{at}.attn.c_proj")) for x, m in zip(xs, mixed)]
            gelu = lambda u: 0.5 * u * (1 + np.tanh(np.sqrt(2 / np.pi) * (u + 0.044715 * u**3)))
            xs = [x + np.array(lin([gelu(u) for u in lin(norm(x, f"{at}.ln_2"), f"{at}.mlp.c_fc")], f"{at}.mlp.c_proj")) for x in xs]
        total = 0.0
        for x, nxt in zip(xs, seq[1:]):
            z = w["transformer.wte.weight"] @ np.array(norm(x, "transformer.ln_f"))
            total += z[nxt] - np.log(np.exp(z).sum())
        return total

    score = models.scorer(lambda t: models.gpt2_logits(w, t, heads))
    for seq in ([1, 2, 3, 0, 5], [4, 4]):
        assert score([seq])[0] == (pytest.approx(plain(seq)), len(seq) - 1)


def test_grid_edges(spark):
    runs = [("b", 1, None, 1.0, 7, 0), ("a", 1, None, 2.0, 8, 1), ("a", 2, None, 4.0, 9, 2), ("c", 1, 3.0, 2.0, 7, 3)]
    df = spark.createDataFrame(runs, "config string, seed int, final_eval_loss double, elapsed double, n_params int, run int")
    df = df.withColumns({c: F.lit(None).cast("double") for c in ("loss_100", "loss_500", "final_train_loss")})
    got = {r.config: r for r in grid.grid_summary(df).collect()}
    assert [got[c]["rank"] for c in "cba"] == [1, 2, 3] and got["a"].elapsed_mean == 3.0 and got["a"].n_params == 8
    assert [(r.config, r.seed) for r in grid.seed_detail(df, grid.grid_summary(df)).orderBy("place").collect()] == [("c", 1), ("b", 1), ("a", 1), ("a", 2)]
    with pytest.raises(Exception, match="no configuration"):
        grid.with_configuration(grid.grid_summary(df)).collect()
    lines = spark.createDataFrame([('{"config":"a","seed":1,"step":5,"loss":8.0,"eval_loss":3.0}',), ('{"config":"a","rank":1,"step":5,"loss":8.0}',), ('{"config":"a","step":5}',), ("no json",), (None,)], "value string")
    assert sorted((r.kind, r.loss) for r in grid.read_log(lines, accumulate=4).collect()) == [("eval", 3.0), ("train", 2.0)]
    assert grid.plan_runs(spark).count() == 24
    s = spark.createDataFrame([([[2, 3], [4]], None), ([], 0.5), ([[]], 0.25)], "s array<array<bigint>>, m double")
    assert [tuple(r) for r in s.select(grid.parameter_count(F.col("s")), names.spread(F.col("m"), F.lit(0.125))).collect()] == [(10, "N/A"), (0, "0.5000±0.1250"), (1, "0.2500±0.1250")]
    assert spark.range(1).select(names.eta(F.lit(7384.9))).first()[0] == "2h3m"


def test_manifest_sinks(spark, tmp_path):
    df = spark.createDataFrame([("c", "/d/a-b/c.wav"), ("b", "/d/a/b.wav")], "file_id string, audio_filepath string")
    tables.save_manifest(df, f"{tmp_path}/m.csv")
    assert [r.file_id for r in tables.load_manifest(spark, f"{tmp_path}/m.csv").collect()] == ["b", "c"]
    tables.save_manifest(df, f"{tmp_path}/m.txt")
    assert [r.value for r in spark.read.text(f"{tmp_path}/m.txt").collect()] == ["/d/a/b.wav", "/d/a-b/c.wav"]
    with pytest.raises(ValueError):
        tables.save_manifest(df, f"{tmp_path}/m.xls")
    tables.save_rows([], f"{tmp_path}/none.csv")
    assert not os.path.exists(f"{tmp_path}/none.csv")


def test_clusters_need_a_shared_folder():
    class Conf:
        get = staticmethod(lambda *_: None)

    class Option:
        getOrElse = staticmethod(lambda x: x)

    class Spark:
        conf = Conf

        class sparkContext:
            master = "spark://somewhere:7077"

            class _jsc:
                sc = staticmethod(lambda: type("S", (), {"getCheckpointDir": staticmethod(lambda: Option)}))

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.checkpoint_dir(Spark)
