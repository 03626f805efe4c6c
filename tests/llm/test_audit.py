"""The filter audit against plain filtering, order by order."""

import random
from itertools import permutations

from tokenloom.llm import audit

BLANKS = " \t\n\x0b\f\r"


def words_of(text):
    for b in BLANKS:
        text = text.replace(b, " ")
    return [w for w in text.split(" ") if w]


def plain(docs, labels):
    """docs: (doc_id, text, source); labels: (doc_id, quality, toxic)."""
    full = []
    for i, text, source in docs:
        t = text or ""
        w = words_of(t)
        fails = {
            "A": len(w) < 50,
            "B": 100 * len(set(w)) < 65 * len(w),
            "C": 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t),
            "D": any(c in "#$%&*|" for c in t),
            "E": i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs),
        }
        mine = [x for x in labels if x[0] is not None and x[0] == i]
        full.append((source or "", {f for f in fails if fails[f]}, any(x[1] == 1 for x in mine), any(x[2] == 1 for x in mine)))
    out = {}
    for part in {p for p, *_ in full}:
        own = [x for x in full if x[0] == part]
        for order in permutations("ABCDE"):
            left = own
            for k, f in enumerate(order):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                out[part, "".join(order), k + 1] = [len(left), len(gone), sum(f in x[1] for x in own) - len(gone), sum(x[1] == {f} for x in own), sum(x[2] for x in gone), sum(x[3] for x in gone)]
    removed = {}
    for (part, order, k), v in out.items():
        removed[part, order[k - 1]] = removed.get((part, order[k - 1]), 0) + v[1]
    return sorted((*key, *v, removed[key[0], key[1][key[2] - 1]]) for key, v in out.items())


def check(spark, docs, labels):
    d = spark.createDataFrame([(*x, 1, 2) for x in docs], "doc_id bigint, text string, source string, n bigint, good int")
    n = spark.createDataFrame([(*x, "z") for x in labels], "doc_id bigint, quality int, toxic int, part string")
    assert sorted(map(tuple, audit.filter_audit(d, n).collect())) == plain(docs, labels)


def test_against_plain_filters(spark):
    rng = random.Random(11)
    known = [f"w{k}" for k in range(300)] + ["Élan", "🙂"]
    docs, labels = [], []
    for i in range(160):
        n = rng.choice([0, 1, 49, 50, 51, 80, 400])
        w = [rng.choice(known if rng.random() < 0.7 else known[:40]) for _ in range(n)]
        w = [x.upper() if rng.random() < rng.choice([0, 0, 0.3]) else x for x in w] + ["a#b"] * (rng.random() < 0.2)
        docs.append((i, rng.choice(["", " ", "\x0b"]) + rng.choice(BLANKS).join(w), rng.choice([None, "", "a", "a", "b"])))
    for i in range(160, 190):
        docs.append((rng.choice([i, -i]), docs[rng.randrange(30)][1], "hot"))
    for i in range(190):
        if rng.random() < 0.6:
            labels.append((i, rng.choice([0, 1, None]), rng.choice([0, 1, None])))
    check(spark, docs, labels)


def test_odd_rows(spark):
    """Nulls in any column, blank and very long texts, repeated rows, one id on several texts, several labels of one id."""
    long = " ".join(f"w{k % 40_000}" for k in range(60_000))
    docs = [(None, None, None), (None, "x", None), (None, "x", "s"), (1, None, "s"), (2, "", "s"), (2, "", "s"), (3, " \n ", ""), (4, long, "s"), (5, long, None), (5, long, None)]
    docs += [(6, "a " * 60, "s"), (6, "b c " * 30, "s"), (6, "a " * 60, "s"), (7, "ABCD efgh", "s"), (7, "ABCD efgh", "s"), (8, "$", "s"), (0, "$", "t")]
    check(spark, docs, [(5, 1, 0), (5, 0, 1), (5, None, None), (None, 1, 1), (2, 1, None), (8, None, 1), (99, 1, 1)])


def test_boundaries(spark):
    """At 50 words, 65 % distinct words and 5 % capitals nothing fails."""
    distinct = [f"x{k}" for k in range(65)] + ["x0"] * 35
    docs = [(1, " ".join(distinct), "s"), (2, " ".join([*distinct[:64], *["x0"] * 36]), "s"), (3, " ".join(f"w{k}" for k in range(50)), "s"), (4, "A" + "b" * 19, "s"), (5, "A" + "b" * 18, "s"), (6, "É" * 19 + "A", "s")]
    check(spark, docs, [])
    got = audit.failed_sets(spark.createDataFrame(docs, "doc_id bigint, text string, source string"), spark.createDataFrame([], "doc_id bigint, quality int, toxic int"))
    assert {r.doc_id: r.failed for r in got.collect()} == {1: 0, 2: 2, 3: 0, 4: 1, 5: 5, 6: 1}


def test_empty_table(spark):
    d, n = spark.createDataFrame([], "doc_id bigint, text string, source string"), spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert audit.filter_audit(d, n).count() == 0


def test_words_are_not_shuffled(spark):
    """Between the exploded words and the totals of a text there is no exchange."""
    d = spark.createDataFrame([(1, "a b", 5)], "doc_id bigint, text string, h bigint")
    plan = audit.word_counts(d)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.index("Exchange") > plan.index("Generate")
