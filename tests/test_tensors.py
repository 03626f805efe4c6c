"""Files of tensors: round trips, ranges, broken files, tied heads and scoring."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tokenloom.operators import bigrams, checkpoints, models
from tokenloom.sources import tensors

SCHEMA = "name string, dtype string, shape array<bigint>, data binary"


def rows_of(w):
    names = {"float32": "F32", "float64": "F64", "int64": "I64", "uint8": "U8", "float16": "F16", "bool": "BOOL"}
    return [(k, names[str(v.dtype)], list(v.shape), v.tobytes()) for k, v in w.items()]


def test_round_trip(spark, tmp_path):
    rng = np.random.default_rng(1)
    w = {"a": rng.standard_normal((3, 5)).astype("f4"), "b.c": rng.standard_normal(700), "s": np.array(7, "i8"), "e": np.empty((0, 4), "f4"), "h": rng.standard_normal(9).astype("f2"), "t": np.array([True, False])}
    df = spark.createDataFrame(rows_of(w), SCHEMA)
    tensors.write_tensors(df.repartition(2), f"{tmp_path}/m")
    assert sorted(os.listdir(f"{tmp_path}/m")) == ["model-00001-of-00002.safetensors", "model-00002-of-00002.safetensors"]
    got = tensors.load(f"{tmp_path}/m")
    assert set(got) == set(w) and all(np.array_equal(got[k], w[k]) and got[k].shape == w[k].shape for k in w)
    for most in (64 << 20, 1000, 64):
        read = tensors.read_tensors(spark, f"{tmp_path}/m", maxbytes=most)
        found = {}
        for r in read.orderBy("name", "part").collect():
            assert r.n_bytes == len(r.data) <= most
            found[r.name] = found.get(r.name, b"") + bytes(r.data)
        assert found == {k: v.tobytes() for k, v in w.items()}
        n = read.groupBy(F.spark_partition_id().alias("p")).agg(F.sum("n_bytes").alias("n")).collect()
        assert max(r.n for r in n) <= most and (most > 5600 or len(n) >= 5600 // most)
    heads = tensors.read_tensors(spark, f"{tmp_path}/m", data=False)
    assert heads.where("data IS NOT NULL").count() == 0 and heads.agg(F.sum("n_bytes")).first()[0] == sum(v.nbytes for v in w.values())
    with pytest.raises(Exception, match="already"):
        tensors.write_tensors(df, f"{tmp_path}/m")
    tensors.write_tensors(df.where("name = 's'"), f"{tmp_path}/m", "overwrite")
    assert os.listdir(f"{tmp_path}/m") == ["model-00001-of-00001.safetensors"]


def test_half_floats():
    x = np.array([1.5, -2.0, 0.0], "f4")
    body = (x.view(np.uint32) >> 16).astype("<u2").tobytes()
    assert np.array_equal(tensors.array("BF16", [3], body), x)


@pytest.mark.parametrize(
    "row",
    [("a", "F32", [2], b"1234"), (None, "U8", [1], b"1"), ("a", "Q7", [1], b"1"), ("a", "U8", None, b"1"), ("a", "U8", [1], None)],
)
def test_unfit_tensors_fail(spark, tmp_path, row):
    with pytest.raises(Exception, match="can't be stored"):
        tensors.write_tensors(spark.createDataFrame([row], SCHEMA), f"{tmp_path}/m")
    assert not os.path.exists(f"{tmp_path}/m") or not [f for f in os.listdir(f"{tmp_path}/m") if f.endswith(".safetensors")]


def test_broken_files(spark, tmp_path):
    with pytest.raises(Exception, match="no .safetensors"):
        tensors.read_tensors(spark, f"{tmp_path}").collect()
    head = json.dumps({"a": {"dtype": "U8", "shape": [4], "data_offsets": [0, 4]}}).encode()
    cases = {"cut short": len(head).to_bytes(8, "little") + head + b"123", "no file of tensors": b"abc", "contradicts": None}
    wrong = json.dumps({"a": {"dtype": "U8", "shape": [5], "data_offsets": [0, 4]}}).encode()
    cases["contradicts"] = len(wrong).to_bytes(8, "little") + wrong + b"1234"
    for match, body in cases.items():
        with open(f"{tmp_path}/x.safetensors", "wb") as f:
            f.write(body)
        with pytest.raises(Exception, match=match):
            tensors.read_tensors(spark, f"{tmp_path}").collect()
    ok = json.dumps({"__metadata__": {"format": "pt"}, "a": {"dtype": "U8", "shape": [4], "data_offsets": [0, 4]}}).encode()
    with open(f"{tmp_path}/x.safetensors", "wb") as f:
        f.write(len(ok).to_bytes(8, "little") + ok + b"1234")
    assert [(r.name, bytes(r.data)) for r in tensors.read_tensors(spark, f"{tmp_path}").collect()] == [("a", b"1234")]


def test_tied_head_and_scores(spark, tmp_path):
    """The same scores from a .safetensors model as from arrays; a head that is missing is the embedding."""
    rng, v, e, n = np.random.default_rng(3), 7, 4, 3
    w = {"embedding.weight": rng.standard_normal((v, e)), "output.weight": rng.standard_normal((v, n)), "output.bias": rng.standard_normal(v)}
    w |= {"lstm.weight_ih_l0": rng.standard_normal((4 * n, e)), "lstm.weight_hh_l0": rng.standard_normal((4 * n, n)), "lstm.bias_ih_l0": rng.standard_normal(4 * n), "lstm.bias_hh_l0": rng.standard_normal(4 * n)}
    tensors.write_tensors(spark.createDataFrame(rows_of(w), SCHEMA), f"{tmp_path}/m")
    with open(f"{tmp_path}/m/config.json", "w") as f:
        f.write('{"model_type": "lstm"}')
    want = models.scorer(lambda t: models.lstm_logits(w, t))([[5, 1, 2, 6], [5, 6]])
    got = {r.k: r for r in bigrams.score_with(spark.createDataFrame([("a", [5, 1, 2, 6]), ("b", [5, 6])], "k string, t array<int>"), checkpoints.loader(spark, f"{tmp_path}/m"), "k", "t").collect()}
    assert [(got[k].log_prob, got[k].num_tokens) for k in "ab"] == [(pytest.approx(p), m) for p, m in want]
    for head in (False, True):
        tied = {"transformer.wte.weight": np.arange(4.0)} | ({"lm_head.weight": np.arange(2.0)} if head else {})
        tensors.write_tensors(spark.createDataFrame(rows_of(tied), SCHEMA), f"{tmp_path}/t{head}")
        found = {r.key: bytes(r.data) for r in checkpoints.model_tensors(tensors.read_tensors(spark, f"{tmp_path}/t{head}")).collect()}
        assert found == {"transformer.wte.weight": np.arange(4.0).tobytes(), "lm_head.weight": tied.get("lm_head.weight", np.arange(4.0)).tobytes()}


def test_many_small_tensors(spark, tmp_path):
    """Tasks follow the bytes, not the tensors; each part comes once at any size of tasks; very many tensors roll files."""
    w = {f"t{k}": np.full(k % 50, k % 256, "u1") for k in range(2000)} | {"big": np.arange(9000, dtype="u1")}
    tensors.write_tensors(spark.createDataFrame(rows_of(w), SCHEMA).coalesce(1), f"{tmp_path}/m", mosttensors=600)
    assert len(os.listdir(f"{tmp_path}/m")) == 4
    for task, parts in ((1 << 40, 4), (40_000, None), (700, None)):
        read = tensors.read_tensors(spark, f"{tmp_path}/m", maxbytes=1000, taskbytes=task)
        found = {}
        for r in read.orderBy("name", "part").collect():
            assert r.n_bytes == len(r.data) <= 1000
            found.setdefault(r.name, []).append((r.part, bytes(r.data)))
        assert {k: b"".join(d for _, d in v) for k, v in found.items()} == {k: v.tobytes() for k, v in w.items()}
        assert all([p for p, _ in v] == list(range(len(v))) for v in found.values())
        assert parts is None or read.rdd.getNumPartitions() == parts
    plan = checkpoints.model_tensors(tensors.read_tensors(spark, f"{tmp_path}/m"), tensors.read_tensors(spark, f"{tmp_path}/m", data=False))
    assert plan.count() == 2001 and plan._jdf.queryExecution().optimizedPlan().toString().count("RelationV2") == 2  # of the data, one scan
