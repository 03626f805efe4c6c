"""One-pass encoding: each file once, rows dealt to shards and errors, counts of the write itself."""

import io
import os
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from tokenloom.operators import encoders, tables
from tokenloom.plans import flows
from tokenloom.sources import files, tar


def wav(x, rate=8000):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((np.asarray(x) * 32767).astype("<i2").tobytes())
    return out.getvalue()


@pytest.fixture(scope="module")
def counting():
    """An encoder that notes each call in a file, and fails for loud sounds."""

    def make(note=""):
        def encode(x, rate):
            with open(note, "a") as f:
                f.write("x")
            if np.abs(x).max() > 0.95:
                raise ValueError("x: Cannot subsample F0 here" if x[0] > 0 else "too loud")
            return np.array([1, 2, 3]) if np.abs(x).max() > 0.01 else np.array([], int)

        return encode

    encoders.register("counting", 8, make)
    yield "counting"
    encoders.VOCABULARIES.pop("counting")
    encoders._FACTORIES.pop("counting")


def test_each_file_once(spark, tmp_path, counting):
    rng, sound = np.random.default_rng(1), lambda s, loud=0.5: wav(np.clip(rng.standard_normal(int(8000 * s)) * 0.1, -0.2, 0.2) * loud)
    made = {f"f{k}.wav": sound(0.5) for k in range(30)} | {"a.b.wav": sound(0.5), "short.wav": sound(0.1), "none.wav": sound(0), "bad.wav": b"RIFF", "still.wav": wav(np.zeros(8000))}
    made |= {"loud.wav": wav(np.r_[-np.ones(4000), np.zeros(4000)]), "quiet.wav": wav(np.ones(4000))}
    os.makedirs(f"{tmp_path}/s")
    for name, body in made.items():
        with open(f"{tmp_path}/s/{name}", "wb") as f:
            f.write(body)
    rows = [(n, f"{tmp_path}/s/{n}") for n in made] + [("gone.wav", f"{tmp_path}/s/gone.wav"), ("out.wav", "/etc/hostname"), (None, f"{tmp_path}/s/f0.wav"), ("null.wav", None)]
    manifest = spark.createDataFrame(rows, "file_id string, audio_filepath string")
    got = {r.status: r.n for r in flows.encode_manifest(spark, manifest, f"{tmp_path}/s", counting, f"{tmp_path}/t", 0.25, note=f"{tmp_path}/calls").collect()}
    assert got == {"ok": 30, "error_store": 2, "skipped_short": 1, "error_empty": 1, "error_read": 4, "error_no_tokens": 1, "error_encode": 2}
    with open(f"{tmp_path}/calls") as f:
        assert len(f.read()) == 30 + 2 + 1 + 2  # every file long enough, once
    assert sorted(r.key for r in tar.read_tokens(spark, f"{tmp_path}/t").collect()) == sorted(f"f{k}_s000" for k in range(30))
    bad = tar.read_errors(spark, f"{tmp_path}/t").collect()
    assert len(bad) == 11 and {r.status: r.error for r in bad}["error_encode"] in ("too loud", "x: Cannot subsample F0 here")
    assert sorted(r.key for r in bad if r.status == "error_store" and r.key) == ["a.b_s000"] and {r.source for r in bad if r.status == "error_read"} == {f"{tmp_path}/s/bad.wav", f"{tmp_path}/s/gone.wav", "/etc/hostname", None}


def test_counts_of_a_write(spark, tmp_path):
    """What is counted is what is there; silenced messages are counted; an empty table counts nothing."""
    rows = [(f"k{i}", [i], "ok", None) for i in range(50)] + [("x.y", [1], "ok", None), ("", [1], "ok", None), ("e", None, "error_encode", "Cannot subsample F0"), ("f", None, "error_encode", "boom"), ("g", None, "skipped_short", None)]
    df = spark.createDataFrame(rows, "key string, tokens array<smallint>, status string, error string")
    counts = flows.write_encoded(df.repartition(4), f"{tmp_path}/t", maxrecords=7)
    assert {k: n for k, n in counts.items() if n} == {"ok": 50, "error_store": 2, "error_encode": 2, "skipped_short": 1, "silenced": 1, "seen": 55}
    assert tar.read_tokens(spark, f"{tmp_path}/t").count() == 50 and tar.read_errors(spark, f"{tmp_path}/t").count() == 5
    told = tables.progress_of(spark, counts, 10.0, 110).first()
    assert (told.written, told.skipped_short, told.skipped_error, told.rate, told.seen) == (50, 1, 4, 5.0, 55)
    assert tuple(told) == tuple(tables.progress(df.withColumn("status", F.when(F.col("key").isin("x.y", ""), "error_store").otherwise(F.col("status"))), 10.0, 110).first())
    assert set(flows.write_encoded(df.limit(0), f"{tmp_path}/u").values()) == {0}
    flows.write_encoded(df.where("status = 'ok' AND key LIKE 'k%'"), f"{tmp_path}/t")  # an overwrite replaces the errors too
    assert tar.read_errors(spark, f"{tmp_path}/t").count() == 0
    with pytest.raises(Exception, match="can't be stored"):
        tar.write_tokens(df.where("key = 'x.y'"), f"{tmp_path}/v")


def test_clashing_columns(spark):
    df = spark.createDataFrame([(wav(np.ones(800) * 0.3), 1, "r", "u")], "content binary, wave int, rate string, _encoded string")
    got = flows.encode_audio(df, "levels", 0.05).first()
    assert got.wave == 1 and got.rate == "r" and got._encoded == "u" and got.status == "ok" and got.tokens and got.n_samples == 800


def test_audio_is_not_shuffled(spark, tmp_path):
    """The only exchange deals paths."""
    manifest = spark.createDataFrame([("a", "/x/a.wav")], "file_id string, audio_filepath string")
    done = flows.encode_paths(manifest.repartition(4), "audio_filepath", "/x", "levels", 1.0)
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_short_sounds_are_only_counted(monkeypatch):
    """A sound that is skipped for its length is not resampled; what is as long as asked for is."""
    real, runs = files.Polyphase.run, []
    monkeypatch.setattr(files.Polyphase, "run", lambda self, parts: runs.append(1) or real(self, parts))
    body = wav(np.ones(800) * 0.5)
    x, n, rate = files.decode_at(body, least=0.2)
    assert (len(x), n, rate, runs) == (0, 800, 8000, [])
    x, n, rate = files.decode_at(body, least=0.1)
    assert (len(x), n, rate, runs) == (1600, 800, 8000, [1])


def test_arrays_of_shards_are_numpys():
    """The bytes that numpy writes, and all that it reads, also where an array isn't written as here."""
    for t in ([], [1], [-5, 32767, -32768], list(range(5000))):
        want = io.BytesIO()
        np.save(want, np.asarray(t, np.int16))
        [(_, body)], wrong = tar._body({"key": "k", "tokens": t})
        assert body == want.getvalue() and wrong is None and tar._loaded(body) == t
        other = io.BytesIO()
        np.save(other, np.asarray(t, ">i4").reshape(1, -1) % 100)
        assert tar._loaded(other.getvalue()) == [v % 100 for v in t]
    with pytest.raises(ValueError):
        tar._loaded(body[:-3])
