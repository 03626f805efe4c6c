"""Every stage of the pipeline against a plain version, each on its own input."""

import random

import corpus_pipeline
from pyspark.sql import functions as F

from tokenloom.llm import pii, quality, toxicity
from tokenloom.session import table

from .conftest import SF
from .test_minhash import brute


def test_stages(spark, tmp_path):
    docs = table(spark, SF, "documents")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality_rules", "near_duplicates", "pii", "packing"]
    steps = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, steps[-1], SF).write.parquet(f"{tmp_path}/{name}")
        steps.append(spark.read.parquet(f"{tmp_path}/{name}"))
    for s in steps[:-1]:
        assert s.columns == corpus_pipeline.COLUMNS
    rows = [{r.doc_id: r for r in s.collect()} for s in steps]
    scores = {r.doc_id: r.predicted for r in toxicity.score_toxicity(docs, table(spark, SF, "labels")).collect()}
    assert set(rows[1]) == {i for i, p in scores.items() if p == 0}
    verdict = {r.doc_id: r.kept for r in quality.quality_rules(steps[1]).collect()}
    assert set(rows[2]) == {i for i, k in verdict.items() if k}
    assert set(rows[3]) == {i for i, x in brute([(i, r.text) for i, r in rows[2].items()], 5).items() if x[2]}
    assert {i: r.text for i, r in rows[4].items()} == {i: pii.redacted(r.text) for i, r in rows[3].items()}
    assert all(r.n_chars == len(r.text) for r in rows[4].values() if r.text is not None)
    assert {i: r.n_tokens for i, r in rows[5].items()} == {i: len(r.text.encode().split()) for i, r in rows[4].items()}


def test_clean_documents_stay(spark):
    docs, labels = (table(spark, "/root/testdata/sf0.01", n) for n in ("documents", "labels"))
    good = docs.join(labels.where("quality = 1"), "doc_id").where(F.regexp_count("text", F.lit(r"\S+")) >= 20)
    kept = quality.quality_rules(good).agg(F.avg(F.col("kept").cast("int")), F.avg(F.col("base_failed").cast("int"))).first()
    assert kept[0] >= 0.97 - kept[1]


def test_run_on_odd_rows(spark, tmp_path):
    """run() itself, on nulls, empty and very long texts, repeated rows, two texts under one id, and clashing columns."""
    rng = random.Random(6)
    prose = lambda n: " ".join(rng.choice(["the", "and", "of", "to", "in", "a", "that"]) if k % 3 == 0 else "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 9))) for k in range(n)) + "."
    a, b, c, long = prose(60), prose(70), prose(80), prose(30_000)
    rows = [(1, a), (1, a), (2, a), (3, a + " one more"), (4, None), (5, ""), (6, "too short"), (7, b + " write to bob@example.com now"), (8, long), (9, long), (None, c), (10, c), (11, prose(50)), (11, prose(50))]
    full = [(i, t, "en", "s", None if t is None else len(t), 1, 0) for i, t in rows]
    spark.createDataFrame(full, "doc_id bigint, text string, lang string, source string, n_chars bigint, kept int, n_tokens int").write.parquet(f"{tmp_path}/t/documents.parquet")
    spark.createDataFrame([(1, 0, 1), (2, None, None)], "doc_id bigint, toxic int, quality int").write.parquet(f"{tmp_path}/t/labels.parquet")
    got = corpus_pipeline.run(spark, f"{tmp_path}/t").collect()
    words = {i: len(t.split()) for i, t in rows if t}
    quality_ok = {(r.doc_id, r.n_words) for r in quality.quality_rules(spark.createDataFrame(full[:], "doc_id bigint, text string, lang string, source string, n_chars bigint, kept int, n_tokens int")).collect() if r.kept}
    assert {(1, words[1]), (7, words[7]), (8, words[8])} <= quality_ok
    assert sorted((r.doc_id or 0, r.n_tokens) for r in got) == sorted([(1, words[1])] * 2 + [(7, words[7]), (8, words[8]), (0, words[None]), (10, words[10])] + [(11, 50)] * 2)
    assert set(got[0].asDict()) == {"doc_id", "n_tokens", "bucket", "bucket_len", "batch", "slot", "padding"}


def test_run_on_empty_tables(spark, tmp_path):
    docs = table(spark, SF, "documents")
    docs.limit(0).write.parquet(f"{tmp_path}/e/documents.parquet")
    table(spark, SF, "labels").limit(0).write.parquet(f"{tmp_path}/e/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/e").count() == 0
