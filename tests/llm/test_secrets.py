"""Secret scans against a plain search and directly computed entropies."""

import hashlib
import itertools
import math
import random
import re
import time
from collections import Counter

from pyspark.sql import functions as F

from tokenloom.llm import secrets

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def brute(text):
    text = text or ""
    base = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    base += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    base += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    every = list(base)
    for k, c in enumerate(secrets.CLASSES, 3):
        for m in re.finditer(c.pattern, text):
            found = False
            for piece in re.split("|".join(secrets.ALLOWED), m[0]):
                best = max((-sum(n / c.window * math.log2(n / c.window) for n in Counter(piece[i : i + c.window]).values()) for i in range(len(piece) - c.window + 1)), default=-1)
                found |= round(best, 9) >= c.bits and all(re.search(x, piece) for x in c.needs)
            if found and not any(s < m.end() and m.start() < e for s, _, e in base):
                every.append((m.start(), k, m.end()))
    names = ["assign", "access", "hex", *(c.name for c in secrets.CLASSES)]
    show = lambda a: ",".join(f"{names[k]}:{s}:{e}" for s, k, e in sorted(a))
    return tuple(sum(k == n for _, k, _ in base) for n in range(3)) + (hashlib.sha256(show(base).encode()).hexdigest(), show(every))


def test_against_plain_search(docs_of):
    rng = random.Random(3)
    alnum = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    key = lambda n, a=alnum: "".join(rng.choice(a) for _ in range(n))
    texts = [None, "", "password=abc", "Password: 'hunter22'", "password=token:abcdefgh", "é🙂 api_key = " + key(12), "AKIA" + key(16, "ABCXYZ019"), "AKIA" + key(10, "ABC12"), "x" * 50_000 + " " + key(40)]
    texts += [f"see {key(40)} and {key(32, '0123456789abcdef')}, {key(30, '0123456789ABCDEF')}", "aaaa1111AAAAaaaa1111AAAAaaaa1111", "EXAMPLE" + key(40), "0123456789" * 4 + "abcdef", "deadbeef" * 5 + key(30), "secret='" + key(40) + "'"]
    for _ in range(60):
        texts.append("".join(rng.choice([" ", "token=", "ſecret: ", "AKIA", key(5), key(30), key(25, "0123456789abcdef"), "é", '"', ":", "secret"]) for _ in range(12)))
    rows = list(enumerate(texts)) + [(None, "token=abcdef"), (3, texts[3])]
    got = secrets.find_secrets(docs_of(rows)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, tuple(r[1:])) for r in got) == sorted((i is None, i or 0, brute(t)) for i, t in rows)
    assert secrets.find_secrets(docs_of([])).count() == 0
    assert any("entropy_base64" in brute(t)[-1] for t in texts) and any("entropy_hex" in brute(t)[-1] for t in texts)


def test_windows_at_the_threshold(docs_of):
    """Exactly 3 bits, whatever came before the window."""
    texts = ["x " + "0A1B2C3D" * 3 + " y", "0000" + "0A1B2C3D" * 3, "0A1B2C3D" * 9, "3D2C1B0A" * 3, "A0" * 7 + "0A1B2C3D" * 4 + "A0" * 5, "0A1B2C3" * 4, "00A1B2C3D" * 3]
    got = {r.doc_id: tuple(r[1:]) for r in secrets.find_secrets(docs_of(list(enumerate(texts)))).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}
    assert got[0][-1] == "entropy_hex:2:26"


def test_many_matches_of_one_text(docs_of):
    """Twice the matches take about twice the time, and added spans are set against many base spans."""
    took = []
    for n in (1000, 20_000, 40_000):
        text = ("token=abcdef12 " * 7 + "0A1B2C3D" * 3 + " ") * (n // 8)
        df = docs_of([(1, text)])
        began = time.perf_counter()
        r = secrets.find_secrets(df).collect()[0]
        took.append(time.perf_counter() - began)
        assert r.n_assign == 7 * (n // 8) and r.spans.count("entropy_hex") == n // 8
        if n == 1000:
            assert tuple(r[1:]) == brute(text)
    assert took[2] < 3 * took[1] + 2


def test_running_sums(spark):
    rng = random.Random(2)
    for n in (0, 1, 2, 63, 64, 65, 4096, 4097, 10_000):
        xs = [rng.randrange(9) for _ in range(n)]
        got = spark.createDataFrame([(xs,)], "xs array<bigint>").select(secrets.running(F.col("xs")).alias("r")).first().r
        assert got == [0, *itertools.accumulate(xs)][:n]


def test_keys_of_one_case_and_beside_allowed_words(docs_of):
    """Random keys of every class are found, also next to a word of the allow list; words, names and allowed strings are not."""
    rng = random.Random(7)
    lower, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    key = lambda n, a: "".join(rng.choice(a) for _ in range(n))
    mixed, found = lower + upper + digits, []
    for k in range(200):
        found += [key(40, lower + digits), key(40, upper + digits), key(24, mixed), "/example/" + key(40, mixed), key(40, mixed) + "00000000", "EXAMPLE" + key(40, lower + digits)]
    plain = ["internationalization", "antidisestablishmentarianism2024", "see /usr/share/doc/python3/examples/here", "GET_ALL_USERS_BY_ID_2", "0123456789abcdefghij", "AAAA1111BBBB2222CCCC3333", "example" * 9 + "1", "a" * 60 + "1a1", "x1" * 40, "deadbeefdeadbeef00000000"]
    got = {r.doc_id: r.spans for r in secrets.find_secrets(docs_of(list(enumerate(found + plain)))).collect()}
    caught = [bool(got[i]) for i in range(len(found))]
    for kind in range(6):
        assert sum(caught[kind::6]) >= 194, kind
    assert [p for i, p in enumerate(plain, len(found)) if "entropy" in got[i]] == []
