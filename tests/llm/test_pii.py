"""Base spans against the written patterns, and deobfuscation against planted disguises."""

import random
import re
import time

import pytest

from tokenloom.llm import pii
from tokenloom.llm.common import documents

from .conftest import SF

PATTERNS = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)


def plain(text):
    ok = (
        lambda m: True,
        lambda m: all(int(x) <= 255 for x in m.split(".")),
        lambda m: 16 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and pii.luhn(d),
        lambda m: 8 <= len(re.sub("[^0-9]", "", m)) <= 15,
    )
    return [(k, m.start(), m.end()) for k, p in enumerate(PATTERNS) for m in re.finditer(p, text or "") if ok[k](m[0])]


def test_base_spans_are_the_patterns():
    rng = random.Random(2)
    pieces = ["a", "b.c", "@", "@@", "x-y", ".", "1", "22", "256", "10.0.0.1", "1.2.3", ".4", " ", "-", "+1", "+", "(", ")", "555", "4111 1111 1111 1111", "4111-1111-1111-1111", "é", "%", "\n", "user@ex.org", "+1 (555) 123-4567"]
    for _ in range(4000):
        t = "".join(rng.choice(pieces) for _ in range(rng.randrange(14)))
        assert pii.detect(t) == plain(t), t


@pytest.mark.parametrize(
    ("text", "kind", "source"),
    [
        ("é write to bob (at) example [dot] com now", "email", "bob (at) example [dot] com"),
        ("write to bob at mail dot example dot org now", "email", "bob at mail dot example dot org"),
        ("mail bоb@exаmple.com please", "email", "bоb@exаmple.com"),
        ("host 10[.]0[.]0[.]1 is", "ip", "10[.]0[.]0[.]1"),
        ("card ４111 1111 1111 1111 ok", "card", "４111 1111 1111 1111"),
        ("call plus four four two zero seven nine four six zero today", "phone", "plus four four two zero seven nine four six zero"),
    ],
)
def test_disguises(text, kind, source):
    base, more = pii.find(text)
    assert [(pii.KINDS[k], text[s:e].strip()) for k, s, e in more] == [(kind, source)]
    assert f"[{kind.upper()}]" in pii.redacted(text)


@pytest.mark.parametrize(
    ("text", "kind", "source"),
    [
        ("mail jоhn@example.com now", "email", "jоhn@example.com"),
        ("mail john@example.cоm now", "email", "john@example.cоm"),
        ("mail john dot doe@example.com now", "email", "john dot doe@example.com"),
        ("call +1 555 123 45６7 now", "phone", "+1 555 123 45６7"),
    ],
)
def test_disguise_around_a_base_span(text, kind, source):
    base, more = pii.find(text)
    assert base == plain(text) and len(base) == 1
    assert [(pii.KINDS[k], text[s:e]) for k, s, e in more] == [(kind, source)]
    assert pii.redacted(text) == text.replace(source, f"[{kind.upper()}]")


def test_spelled_at_by_itself():
    for before in ("", "the dot was red; ", "look (at) this; "):
        for t in ("write to john at example.com now", "write to john AT\tmail.Example.COM now", "john at my-host.example.org"):
            base, more = pii.find(before + t)
            want = t.removeprefix("write to ").removesuffix(" now")
            assert base == [] and [(k, (before + t)[s:e]) for k, s, e in more] == [(0, want)]
            assert pii.redacted(before + t) == before + t.replace(want, "[EMAIL]")


@pytest.mark.parametrize(
    ("text", "kind", "source"),
    [
        ("host one nine two dot one six eight dot zero dot one is up", "ip", "one nine two dot one six eight dot zero dot one"),
        ("host 192.168.zero.one is up", "ip", "192.168.zero.one"),
        ("call plus four nine 171 2345678 today", "phone", "plus four nine 171 2345678"),
        ("call +four nine 171 2345678 today", "phone", "+four nine 171 2345678"),
        ("call plus 1 5 5 5 zero 1 0 0 0 today", "phone", "plus 1 5 5 5 zero 1 0 0 0"),
        ("call +1 (five five five) oh one oh, two three four", "phone", "+1 (five five five) oh one oh, two three four"),
        ("card four one one one 1111 1111 1111 ok", "card", "four one one one 1111 1111 1111"),
        ("card ４111 1111 1111 1111 one day", "card", "４111 1111 1111 1111"),
        ("card ４111 1111 1111 1111 one two", "card", "４111 1111 1111 1111"),
    ],
)
def test_spelled_digits(text, kind, source):
    base, more = pii.find(text)
    assert base == plain(text)
    assert [(pii.KINDS[k], text[s:e]) for k, s, e in more] == [(kind, source)]
    assert pii.redacted(text) == text.replace(source, f"[{kind.upper()}]")


@pytest.mark.parametrize(
    ("text", "kind", "source"),
    [
        ("write to john.doe at gmail.com now", "email", "john.doe at gmail.com"),
        ("write to john      at \t    gmail   dot   com now", "email", "john      at \t    gmail   dot   com"),
        ("bob     [     at     ]     mail.org", "email", "bob     [     at     ]     mail.org"),
        ("mail j o h n @ e x . org please", "email", "j o h n @ e x . org"),
        ("mail j o h n @ e x a m p l e . c o m please", "email", "j o h n @ e x a m p l e . c o m"),
        ("mail john @ example.com please", "email", "john @ example.com"),
        ("mail john@ example.com", "email", "john@ example.com"),
        ("call +٤٤ ٢٠ ٧٩٤٦ ٠٩٥٨ now", "phone", "+٤٤ ٢٠ ٧٩٤٦ ٠٩٥٨"),
        ("card ४१११ ११११ ११११ ११११ now", "card", "४१११ ११११ ११११ ११११"),
        ("host ١٩٢.١٦٨.٠.١ up", "ip", "١٩٢.١٦٨.٠.١"),
        ("card four    one -- one  ,  one 1111 1111 1111 ok", "card", "four    one -- one  ,  one 1111 1111 1111"),
    ],
)
def test_wider_disguises(text, kind, source):
    base, more = pii.find(text)
    assert base == plain(text) == []
    assert [(pii.KINDS[k], text[s:e].strip()) for k, s, e in more] == [(kind, source)]
    assert source not in pii.redacted(text)


def test_clean_text_beside_blanks_stays():
    for t in ("we met @ noon. Then", "a @ b c d", "sold 3 @ 4.50 each", "at   noon . yes", "I @ e", "prices: 2 @ 1.5 and 3 @ 2", "see @ the . dot", "page ١٢ of ٣٠", "x @", "@ example", "to   dot   i's"):
        assert pii.find(t) == ([], []), t


def test_blanks_stay_linear():
    began = time.process_time()
    for t in (" " * 10**6, "a " * 4 * 10**5 + "@", "@ a " * 10**5, "a @ " * 10**5, "@" + " a" * 4 * 10**5, "[" + " " * 10**6, "[ " * 10**5, "one" + " " * 10**6 + "one", "a" + " " * 10**6 + "dot", "1 " + "- " * 10**5, "a at " * 10**5, "a at b." * 10**5, "a at b . " * 10**5, "at a" + " . a" * 10**5, "1 . " * 10**5, "joe at a dot " * 10**5, "plus" + " " * 10**6, "x @ e . " * 10**5, "٣" * 10**5):
        pii.find(t)
    assert time.process_time() - began < 40


def test_few_numbers_stay():
    for t in ("one. Two of 12 came", "chapter one, 2 pages", "plus one", "in 2019 two of three", "one hundred and 10.5 or two.three"):
        assert pii.find(t) == ([], [])


def test_numbers_stay_linear():
    began = time.process_time()
    for t in ("one." * 10**5, "1 one " * 10**5, "one 1" * 10**5, "plus " * 10**5, "one" * 10**5, "1 " * 10**5 + "one", "one " + "1" * 10**5 + "a", "+one" * 10**5):
        pii.find(t)
    assert time.process_time() - began < 30


def test_clean_text_stays():
    for t in ("we met at noon and the dot was red", "one two three", "la niña está aquí, déjà vu", "at one point five or six came", "look at this. the end"):
        assert pii.find(t) == ([], []) and pii.redacted(t) == t


PROSE = (
    "look at example.com for more", "see us at bbc.co.uk today", "go to the office at work.today or later", "released at github.com/foo", "arrived at 5.pm there", "meet me at noon.is that ok",
    "look at the dot on the screen", "contact us at example.com", "mail him at example.com", "write to our team at example.com.", "Look at example.com", "send the parcel to the shop at main.street tomorrow", "version 2.0 at example.org is out",
    "check-in at example.com opens", "write john at github.com/foo", "it was at home . Then we left", "e.g. at example.com one can", "scores were 1 . 2 . 3 in all",
)


@pytest.mark.parametrize("text", PROSE)
def test_places_on_the_web_stay(text):
    for t in (text, f"Well, {text}", f"{text}\nand so on"):
        assert pii.find(t) == ([], []) and pii.redacted(t) == t


@pytest.mark.parametrize(
    ("text", "kind", "source"),
    [
        ("ask joe_b at example.com for it", "email", "joe_b at example.com"),
        ("ask joe99 at example.com for it", "email", "joe99 at example.com"),
        ("ask joe at example dot com for it", "email", "joe at example dot com"),
        ("ask joe at example [.] com for it", "email", "joe at example [.] com"),
        ("send it to joe at example.com, please", "email", "joe at example.com"),
        ("staff: joe at example.com; ann", "email", "joe at example.com"),
        ("write to joe at example . com now", "email", "joe at example . com"),
        ("mail joe at mail . example . co . uk", "email", "joe at mail . example . co . uk"),
        ("mail joe@example。com now", "email", "joe@example。com"),
        ("host 10｡0｡0｡1 is", "ip", "10｡0｡0｡1"),
        ("host 1 9 2 . 1 6 8 . 0 . 1 is", "ip", "1 9 2 . 1 6 8 . 0 . 1"),
    ],
)
def test_evidence_for_an_address(text, kind, source):
    base, more = pii.find(text)
    assert base == plain(text) == []
    assert [(pii.KINDS[k], text[s:e]) for k, s, e in more] == [(kind, source)]
    assert pii.redacted(text) == text.replace(source, f"[{kind.upper()}]")


def test_false_rate_of_web_addresses(spark):
    """Plain mentions of web addresses in the table's prose: of 1,000 texts with ten each, at most one in a thousand is taken for mail."""
    rng, planted, taken = random.Random(9), 0, 0
    for text in [r.text for r in documents(spark, "/root/testdata/sf0.01").select("text").collect() if r.text]:
        words = text.split(" ")
        before = sum(k == 0 for k, _, _ in sum(pii.find(text), []))
        for at in sorted(rng.sample(range(len(words)), min(10, len(words))), reverse=True):
            words.insert(at + 1, f"at {rng.choice(['example', 'my-site', 'news', 'a.b'])}.{rng.choice(['com', 'co.uk', 'org', 'today'])}")
            planted += 1
        taken += max(0, sum(k == 0 for k, _, _ in sum(pii.find(" ".join(words)), [])) - before)
    print("planted", planted, "taken", taken)
    assert planted > 5000 and taken <= planted / 1000


def test_query_rows(spark, docs_of):
    df = documents(spark, SF).select("doc_id", "text")
    for r, text in ((r, dict(df.collect())[r.doc_id]) for r in pii.find_pii(df).collect()):
        want = plain(text)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == n for k, _, _ in want) for n in range(4))
    rows = [(1, None), (2, ""), (None, "a@b.cd"), (3, "x@y.zz and +1 555 123 4567"), (3, "x@y.zz and +1 555 123 4567")]
    got = pii.find_pii(docs_of(rows)).collect()
    assert sorted(r.spans for r in got) == ["", "", "email:0:6", "email:0:6,phone:11:26", "email:0:6,phone:11:26"]
    assert pii.find_pii(docs_of([])).count() == 0
    long = "the end. " * 100_000
    got = pii.find_pii(docs_of([(1, long + "bob (at) example [dot] com")])).first()
    assert got.n_email == 0 and got.spans == f"email:{len(long)}:{len(long) + 26}"
    out = pii.redact(docs_of(rows))
    assert {r.text for r in out.collect()} == {None, "", "[EMAIL]", "[EMAIL] and [PHONE]"} and "n_tokens" in out.columns


def test_long_runs_stay_linear():
    began = time.process_time()
    for t in ("a" * 10**6, "1" * 10**6, "1." * 10**6, "a@" * 10**5, "+1" + "(" * 10**5, " dot " * 10**5, "one " * 10**5, "(at" * 10**5, "@" * 10**6):
        pii.find(t)
    assert time.process_time() - began < 60
