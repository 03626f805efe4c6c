"""Language identification: codes, decoding, held-out accuracy and edges."""

import math
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from tokenloom.llm import language
from tokenloom.llm.common import documents


def test_codewords_are_apart():
    for n in (2, 3, 4, 6, 9, 20):
        c = language.codewords(n)
        assert c.shape[0] == n and ((c[:, None] != c[None]).sum(2) + np.eye(n) * 99).min() >= (1 if n == 2 else 2)


def test_parts_do_not_matter():
    m = language.train(["the cat and the hat", "der hund und die katze"], ["en", "de"])
    text = "Über the hat und die katze " * 50
    assert np.allclose(m.margins(text), m.margins(text, part=64))
    assert m.predict("the hat and cat")[0] == "en" and m.predict("die katze und der hund")[0] == "de"
    assert m.predict("1 2 !")[0] == m.predict(None)[0] == m.predict("")[0] == "und"


def test_held_out_accuracy(spark):
    df = documents(spark, "/root/testdata/sf0.01")
    truth = {r.doc_id: r.lang for r in df.select("doc_id", "lang").collect()}
    got = language.identify(df).collect()
    assert len(got) == len(truth)
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) >= 0.97


def test_edges(docs_of):
    assert language.identify(docs_of([])).count() == 0
    rows = [(i, "only one tongue here") for i in range(6)] + [(None, "x"), (7, None), (8, "12")]
    got = language.identify(docs_of(rows)).collect()
    assert {r.lang_pred for r in got if r.doc_id in range(6)} == {"en"} and {r.lang_pred for r in got if r.doc_id in (7, 8)} == {"und"}
    assert not next(r for r in got if r.doc_id is None).held_out
    none = docs_of(rows, lang={i: None for i, _ in rows})
    assert {r.lang_pred for r in language.identify(none).collect()} == {"und"}


def plain_predict(model, text):
    """The language of a text by loops over its n-grams and over the codewords."""
    if text is None or not any(c.isalpha() for c in text):
        return "und", 0.0
    raw = [b if b >= 128 or 97 <= b <= 122 else 32 for b in f" {text.lower()} ".encode()]
    sums, n = [0.0] * model.table.shape[1], 0
    for size in language.GRAMS:
        for at in range(len(raw) - size + 1):
            h = size
            for b in raw[at : at + size]:
                h = (h ^ b) * 0x9E3779B1 & 0xFFFFFFFF
                h ^= h >> 15
            sums = [s + float(x) for s, x in zip(sums, model.table[h & 0xFFFF], strict=True)]
            n += 1
    f = [math.tanh(a * s / n + c) for s, a, c in zip(sums, model.scale, model.shift, strict=True)]
    loss = [sum(w * math.exp(-bit * x) for w, bit, x in zip(ws, code, f, strict=True)) for ws, code in zip(model.weights, model.code, strict=True)]
    best = min(range(len(loss)), key=lambda k: (loss[k], k))
    return model.languages[best], 1 / sum(math.exp(-8 * (x - loss[best])) for x in loss)


def test_against_plain_loops():
    rng = random.Random(4)
    tongues = {lang: ["".join(rng.choice(letters) for _ in range(rng.randrange(2, 8))) for _ in range(60)] for lang, letters in (("a", "abcde"), ("b", "defgh"), ("c", "ghiñé"))}
    texts = [(" ".join(rng.choices(words, k=20)), lang) for lang, words in tongues.items() for _ in range(8)]
    model = language.train(*map(list, zip(*texts, strict=True)))
    for t in [*(t for t, _ in texts), None, "", "12 !", "Ñé", " ".join(rng.choices(tongues["b"], k=5) + rng.choices(tongues["c"], k=5)), "abc " * 400]:
        lang, score, _ = model.predict(t)
        want = plain_predict(model, t)
        assert lang == want[0] and abs(score - want[1]) < 1e-6


def test_sample_is_bounded(spark, monkeypatch):
    """One id on very many rows gives one text; of very many labels, the most frequent are learned."""
    rows = spark.range(100_000).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("a thing "), "id").alias("text"), F.lit("en").alias("lang"))
    more = spark.range(2, 4000).select("id", F.concat(F.lit("some thing "), "id"), F.when(F.col("id") < 3000, F.concat(F.lit("l"), (F.col("id") % 5).cast("string"))).otherwise(F.concat(F.lit("z"), "id")))
    seen = []
    train = language.train
    monkeypatch.setattr(language, "train", lambda texts, labels: seen.append((len(texts), len(set(labels)))) or train(texts[:50], labels[:50]))
    language.identify(rows.union(more), sample=300, most=20)
    assert seen[0][0] <= 300 and 6 <= seen[0][1] <= 20
    language.identify(rows, sample=300)
    assert seen[1] == (1, 1)


def test_repeated_rows_and_a_long_text(docs_of):
    long = "the cat and the hat " * 20_000
    rows = [(i, "der hund und die katze") for i in range(20)] + [(i, "the cat and the hat") for i in range(20, 40)] + [(77, long), (77, long), (3, "der hund und die katze")]
    got = language.identify(docs_of(rows, lang={i: "de" for i in range(20)})).collect()
    assert len(got) == len(rows) and [r.lang_pred for r in got if r.doc_id == 77] == ["en", "en"] and {r.lang_pred for r in got if r.doc_id == 3} == {"de"}


def test_letters(docs_of):
    """Numbers that no script has as letters don't make a language; letters of any script do."""
    rows = [(i, f"only one tongue here {i}") for i in range(8)] + [(20, "½ ² Ⅷ ③ 12 _ !"), (21, "½ é"), (22, "日"), (23, "ª")]
    got = {r.doc_id: r.lang_pred for r in language.identify(docs_of(rows)).collect()}
    assert got[20] == "und" and got[21] == got[22] == got[23] == "en"


def test_very_many_languages(spark):
    """More values than 256 are learned, each from its own texts."""
    n = 300
    word = lambda k: "".join("bcdfghjklmnpqrstvwxz"[k // 20**p % 20] + "aeiou"[k // 5**p % 5] for p in range(3))
    rows = [(i, f"{word(i % n)} {word(i % n + 1000)} {word(i % n + 3000)} " * 5, f"l{i % n:03d}") for i in range(6 * n)]
    got = language.identify(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), sample=3000).collect()
    assert np.mean([r.lang_pred == f"l{r.doc_id % n:03d}" for r in got]) > 0.9
    codes = language.codewords(n)
    assert len({tuple(c) for c in codes}) == n
    few = language.identify(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), sample=20).collect()
    assert len(few) == len(rows) and len({r.lang_pred for r in few}) <= 20
