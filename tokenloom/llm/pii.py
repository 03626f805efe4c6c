"""Personal data with offset-preserving deobfuscation.

Base detectors run on the source text. Where a text shows signs of disguise, a chain of transducers normalises it
(homoglyphs, digits of other scripts and invisible characters; bracketed or spelled at and dot; addresses with blanks
around the @ or between their letters; spelled digits), each keeping the source place of what it writes. Blanks in a
disguise may be of any number. The same detectors run on each result, and spans that needed a change are mapped back to the source and
added, unless a base span of their kind, or a wider added one, covers them. Everything is linear in the text, one long run of characters included.

A bare ``at`` before a dotted name is mostly a place on the web, so it becomes an address only with more evidence: a local
part with a dot, underscore or plus between letters or digits behind them, a spelled dot in the name, a word about mail
shortly before, or nothing around the address in its line or clause; the last three not behind an article or a possessive,
nor for words that often stand before ``at``; none for a name that goes on as a path.

Defined results: null and empty texts have no spans; a null id is passed through; repeated rows are judged each; further
columns are not read by ``find_pii``, and kept by ``redact``.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tokenloom.functions.batches import slices

KINDS = ("email", "ip", "card", "phone")
OUT = "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string"
_ARROW = pa.schema([(c.split()[0], pa.int64() if c.endswith("bigint") else pa.string()) for c in OUT.split(", ")])

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")

Span = tuple[int, int, int]  # kind, start, end


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost: the run of local characters before an @ begins the match, so only the @ signs are looked at."""
    done = at = 0
    while (at := text.find("@", at)) >= 0:
        start = at
        while start > done and _LOCAL.match(text[start - 1]):
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = at = m.end()
        else:
            done = at = at + 1


def ips(text: str) -> Iterator[tuple[int, int]]:
    for m in _CHAIN.finditer(text):
        parts, at = m[0].split("."), m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                yield at, end
            at = end + 1


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def detect(text: str) -> list[Span]:
    """Base spans, by kind, then start."""
    out: list[Span] = []
    if "@" in text:
        out += [(0, s, e) for s, e in emails(text)]
    if _DIGIT.search(text):
        out += [(1, s, e) for s, e in ips(text)]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 16 and 16 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
                out.append((2, m.start(), m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                    out.append((3, m.start(), m.end()))
    return out


#: Look-alikes of Latin letters, and characters that do not show.
_LOOKALIKES = dict(zip("аВеЕКМНоОрРсСТхХуУіІјЅѕԁɡһԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧοανικρεօսհıɑ", "aBeEKMHoOpPcCTxXyYiIjSsdghqwABEZHIKMNOPTYXoavikpeouhia", strict=True))
_INVISIBLE = "­​‌‍⁠﻿"
_WIDE = "".join(chr(c) for a, b in ((0x2070, 0x209C), (0x2460, 0x2473), (0xFF01, 0xFF5E), (0x1D400, 0x1D7FF)) for c in range(a, b + 1))
_GLYPHS = _LOOKALIKES | {c: "" for c in _INVISIBLE} | {c: n for c in _WIDE if len(n := unicodedata.normalize("NFKC", c)) == 1 and n.isascii()}
#: All of _GLYPHS are among them; a class of two bounds is searched much faster than one of all glyphs.
_NOT_ASCII = re.compile(r"[^\x00-\x7f]")
_NUMBERS = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine")
_DIGIT_OF = {w: str(i) for i, w in enumerate(_NUMBERS)} | {"oh": "0", "plus": "+"}
#: A run of blanks is tried from its first one only, so all of these are linear.
_OPEN_AT = re.compile(r"(?:(?<!\s)\s+)?[\[({<]\s*(?:at|@)\s*[\])}>]\s*", re.I | re.A)
_OPEN_DOT = re.compile(r"(?:(?<!\s)\s+)?[\[({<]\s*(?:dot|\.)\s*[\])}>]\s*", re.I | re.A)
_SPELLED_DOT = re.compile(r"(?<=[A-Za-z0-9])\s+dot\s+(?=[A-Za-z0-9])", re.I | re.A)
_SPELLED_AT = re.compile(r"(?<=[A-Za-z0-9])\s+at\s+(?=([A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}))", re.I | re.A)
#: A dot of other scripts between letters or digits; a name whose dots are spelled or stand in brackets; one whose dot has blanks around it.
_WIDE_DOT = re.compile(r"(?<=[A-Za-z0-9])[\u3002\uff61](?=[A-Za-z0-9])")
_AT_DOTS = re.compile(r"(?<=[A-Za-z0-9])\s+at\s+(?=((?:[A-Za-z0-9-]+\.)*[A-Za-z0-9-]+(?:\s+dot\s+|\s*[\[({<]\s*(?:dot|\.)\s*[\])}>]\s*)[A-Za-z0-9]))", re.I | re.A)
_AT_BLANKS = re.compile(r"(?<=[A-Za-z0-9])\s+at\s+((?:[A-Za-z0-9-]+\s*\.\s*)+)(com|org|net|edu|gov|int|info|io|co|uk|eu|de|fr|es|it|nl|ch|at|us|ca|au|jp|in|dev|app)(?![A-Za-z0-9-])", re.I | re.A)
#: An address of single digits with blanks and dots between them.
_SPACED_IP = re.compile(r"(?<![\w.])[0-9](?:\s[0-9]){0,2}(?:\s\.\s[0-9](?:\s[0-9]){0,2}){3}(?!\w|\s?[0-9.])", re.A)
_ADDRESS_LIKE = re.compile(r"[A-Za-z]{2,}[._+][A-Za-z]|[A-Za-z][._+][A-Za-z]{2,}|[A-Za-z]{2,}[0-9]+$", re.A)
_CUE = re.compile(r"\b(?:e-?mail(?:s|ed)?|mail(?:s|ed|to)?|write|wrote|contact|reach|address|send|cc|inbox)\b", re.I | re.A)
#: Words that often stand before ``at``, and those before a noun.
_COMMON = frozenset(
    "i me you he him she her it we us they them who what this that all more most least best good here there now then home work office noon night today tomorrow yesterday online "
    "look looks looked looking see sees saw seen meet meets met meeting arrive arrives arrived be is are was were been am stay stays stayed live lives lived visit visits visited "
    "read start starts started end ends ended find found available hosted released posted published listed located shown page pages site team support people everyone anyone not only also even back".split()
)
_DETERMINERS = frozenset("the a an my your his her its our their this that these those some any every each no".split())
#: In lower case, and looser: a literal start makes it cheap.
_MAYBE_AT = re.compile(r"at\s+[a-z0-9-][a-z0-9.-]*\.[a-z]{2}", re.A)
_BRACKET = re.compile(r"[\[({<]\s*(?:at|dot|@|\.)\s*[\])}>]", re.I | re.A)
_BLANK_AT = re.compile(r"\s@|@\s", re.A)
_BLANKS = " \t\n\x0b\f\r"
_WHOLE_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")
_SPACED_DOT, _BLANK_RUN = re.compile(r"\s\.|\.\s", re.A), re.compile(r"\s+", re.A)
#: In lower case, and looser.
_MAYBE_SPACED = re.compile(r"at\s+[a-z0-9-]+(?:\s+\.|\.\s)", re.A)
_LONE_DOT = re.compile(r"\bdot\b", re.I | re.A)
_WORD = "|".join([*_NUMBERS, "oh"])
_GAP = r"(?:[\s,-]+|\.)"
#: Runs of spelled digits and groups of digits; a plus may open one.
_SPELLED = re.compile(rf"(?<![A-Za-z0-9])(?:plus[\s-]+)?(?:{_WORD}|[0-9]+)(?:{_GAP}(?:{_WORD}|[0-9]+))*(?![A-Za-z0-9])", re.I | re.A)
_UNIT = re.compile(rf"plus|{_WORD}|[0-9]+", re.I | re.A)
#: In lower case: a spelled digit or plus next to another unit. The first character alone rejects most places.
_MAYBE_SPELLED = re.compile(rf"(?:{_WORD}){_GAP}(?:{_WORD}|[0-9])|[0-9]{_GAP}(?:{_WORD})|[+](?:{_WORD})|plus[\s-]+(?:{_WORD}|[0-9])", re.A)

Edit = tuple[int, int, str]


class Mapped:
    """A text after edits, and the way back to the text before."""

    def __init__(self, text: str, edits: list[Edit]):
        parts, self.outs, self.srcs, at, out = [], [], [], 0, 0
        for s, e, new in edits:
            for a, b, piece, copied in ((at, s, text[at:s], True), (s, e, new, False)):
                if piece:
                    self.outs.append(out)
                    self.srcs.append((a, b, copied))
                    parts.append(piece)
                    out += len(piece)
            at = e
        if at < len(text):
            self.outs.append(out)
            self.srcs.append((at, len(text), True))
            parts.append(text[at:])
        self.text = "".join(parts)

    def back(self, start: int, end: int) -> tuple[int, int]:
        i, j = bisect_right(self.outs, start) - 1, bisect_right(self.outs, end - 1) - 1
        (a, _, copied), (c, d, copied_) = self.srcs[i], self.srcs[j]
        return (a + start - self.outs[i] if copied else a), (c + end - self.outs[j] if copied_ else d)


def _plain(c: str) -> str | None:
    """What stands for a character: of the fixed values, or a digit for one of any script."""
    return _GLYPHS.get(c) if c in _GLYPHS else str(unicodedata.decimal(c)) if c.isdecimal() else None


def _glyph_edits(t: str) -> list[Edit]:
    known = {c: n for c in set(t) if not c.isascii() and (n := _plain(c)) is not None}
    return [(m.start(), m.end(), known[m[0]]) for m in _NOT_ASCII.finditer(t) if m[0] in known] if known else []


def _blank_edits(t: str) -> list[Edit]:
    """Closes up addresses with blanks around the @, or between single letters on either side of it.

    Each @ looks back to the one before it at most, and on to the next, so this is linear.
    """
    out: list[Edit] = []
    done = at = 0
    while (at := t.find("@", at)) >= 0:
        begin, size = at, 1
        while size == 1:  # a word before the @, or single characters with blanks between them
            end = begin
            while end > done and t[end - 1] in _BLANKS:
                end -= 1
            start = end
            while start > done and _LOCAL.match(t[start - 1]):
                start -= 1
            size = end - start
            if size != 1 and begin != at or not size or (start > done and t[start - 1] not in _BLANKS):
                break
            begin = start
        parts: list[str] = []
        ends: list[int] = []  # in the source, of each character of the parts
        stop, size = at + 1, 1
        while size == 1:  # single characters, the last part perhaps whole behind a dot, or one whole domain
            start = stop
            while start < len(t) and t[start] in _BLANKS:
                start += 1
            stop = start
            while stop < len(t) and (t[stop].isalnum() and t[stop].isascii() or t[stop] in ".-"):
                stop += 1
            size = stop - start
            if size > 1 and parts and parts[-1] != ".":
                break
            parts += t[start:stop]
            ends += range(start + 1, stop + 1)
        m = _WHOLE_DOMAIN.match("".join(parts))
        whole = ends[m.end() - 1] if m else 0
        if begin < at and whole:
            out += [(m.start(), m.end(), "") for m in re.compile(r"\s+", re.A).finditer(t, begin, whole)]
            done = whole
        else:
            done = at + 1
        at = max(done, at + 1)
    return out


def _dot_edits(t: str) -> list[Edit]:
    found = [(m.start(), m.end(), n) for p, n in ((_OPEN_AT, "@"), (_OPEN_DOT, "."), (_SPELLED_DOT, "."), (_WIDE_DOT, ".")) for m in p.finditer(t)]
    found += [(m.start(), m.end(), "@") for m in _AT_DOTS.finditer(t) if _is_address(t, m.start(), m.end(1), spelled=True)]
    out: list[Edit] = []
    for e in sorted(found):
        if not out or e[0] >= out[-1][1]:
            out.append(e)
    return out


def _is_address(t: str, at: int, end: int, spelled: bool = False) -> bool:
    """Whether the word before the place ``at`` and the name up to ``end`` are an address, by what stands around them."""
    if t[end : end + 1] == "/":
        return False
    start = at
    while start > 0 and at - start < 64 and _LOCAL.match(t[start - 1]):
        start -= 1
    local, before = t[start:at], t[max(0, start - 60) : start]
    if _ADDRESS_LIKE.search(local):
        return True
    words = before.lower().split()
    if local.lower() in _COMMON or (words and words[-1] in _DETERMINERS):
        return False
    if spelled or _CUE.search(" ".join(before.split()[-4:])):
        return True
    inside = before.rstrip(" \t")
    return (not inside or inside[-1] in "\n\r:;(<\"'") and re.match(r"[ \t]*(?:$|[\n\r;)>!?\"']|\.(?:\s|$))", t[end : end + 60]) is not None


def _at_edits(t: str) -> list[Edit]:
    out = [(m.start(), m.end(), "@") for m in _SPELLED_AT.finditer(t) if _is_address(t, m.start(), m.end(1))]
    for m in _AT_BLANKS.finditer(t):
        if _SPACED_DOT.search(m[1]) and _is_address(t, m.start(), m.end(), spelled=True):
            out += [(m.start(), m.start(1), "@")] + [(m.start(1) + x.start(), m.start(1) + x.end(), "") for x in _BLANK_RUN.finditer(m[1])]
    return sorted(set(out))


def _spaced_edits(t: str) -> list[Edit]:
    return [(m.start() + x.start(), m.start() + x.end(), "") for m in _SPACED_IP.finditer(t) for x in _BLANK_RUN.finditer(m[0])]


def _number_edits(t: str) -> list[Edit]:
    """Digits for words. Single digits close up; a blank parts them from groups of digits, and dots stay."""
    out: list[Edit] = []
    for m in _SPELLED.finditer(t):
        units = [(u.start(), u.end(), _DIGIT_OF.get(u[0].lower(), u[0])) for u in _UNIT.finditer(t, m.start(), m.end())]
        if all(u[0].isdigit() for u in (t[s:e] for s, e, _ in units)) or (len(units) == 1 and t[m.start() - 1 : m.start()] != "+"):
            continue
        for k, (s, e, new) in enumerate(units):
            if t[s:e] != new:
                out.append((s, e, new))
            if k + 1 < len(units) and t[e] != ".":
                after, _, then = units[k + 1]
                gap = "" if new == "+" or len(new) == len(then) == 1 else " "
                if t[e:after] != gap:
                    out.append((e, after, gap))
    return out


def _dots(text: str, low: str) -> bool:
    return bool(_BRACKET.search(text) or ("dot" in low and _LONE_DOT.search(text)) or _WIDE_DOT.search(text))


def normalised(text: str) -> Iterator[Mapped]:
    """The results of the transducers that a text calls for, one after the other; cheap tests come first."""
    low = text.lower()
    for edits, called in (
        (_glyph_edits, lambda: not text.isascii()),
        (_dot_edits, lambda: _dots(text, low)),
        (_at_edits, lambda: _MAYBE_AT.search(low) or _MAYBE_SPACED.search(low)),
        (_blank_edits, lambda: "@" in text and _BLANK_AT.search(text)),
        (_spaced_edits, lambda: " . " in text and _SPACED_IP.search(text)),
        (_number_edits, lambda: _MAYBE_SPELLED.search(low)),
    ):
        if called() and (found := edits(text)):
            yield (m := Mapped(text, found))
            text = m.text
            low = text.lower()


def _widest(spans: set[Span]) -> list[Span]:
    """Those that no other of their kind covers."""
    out: list[Span] = []
    for kind, s, e in sorted(spans, key=lambda x: (x[0], x[1], -x[2])):
        if not (out and out[-1][0] == kind and out[-1][2] >= e):
            out.append((kind, s, e))
    return out


def find(text: str | None) -> tuple[list[Span], list[Span]]:
    """Base spans, and those that deobfuscation adds."""
    text = text or ""
    base = detect(text)
    taken = [([s for k, s, _ in base if k == n], [e for k, _, e in base if k == n]) for n in range(len(KINDS))]
    steps: list[Mapped] = []
    more: set[Span] = set()
    for step in normalised(text):
        steps.append(step)
        for kind, s, e in detect(step.text):
            seen = step.text[s:e]
            for m in reversed(steps):
                s, e = m.back(s, e)
            starts, ends = taken[kind]  # spans of a kind do not overlap
            i = bisect_right(starts, s) - 1
            if text[s:e] != seen and not (i >= 0 and ends[i] >= e):
                more.add((kind, s, e))
    return base, _widest(more)


def show(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))


def find_pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, counts and digest of the base spans, and all spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in slices(batches):
            rows = []
            for i, text in zip(ids, texts, strict=True):
                base, more = find(text)
                rows.append((i, *(sum(k == n for k, _, _ in base) for n in range(4)), hashlib.sha256(show(base).encode()).hexdigest(), show(base + more)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _ARROW.types, strict=True)], schema=_ARROW)

    return df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].alias("text")).mapInArrow(run, OUT)


def redacted(text: str | None) -> str | None:
    """The text with each stretch of touching spans replaced by the name of its first kind in brackets."""
    if text is None:
        return None
    base, more = find(text)
    out, at = [], 0
    for s, e, k in sorted((s, e, k) for k, s, e in base + more):
        if s >= at:
            out += [text[at:s], f"[{KINDS[k].upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


@F.pandas_udf(StringType())
def _redact(texts: pd.Series) -> pd.Series:
    return texts.map(redacted, na_action="ignore")


def redact(df: DataFrame, text_col: str = "text") -> DataFrame:
    """All columns, with personal data in the text replaced."""
    return df.withColumn(text_col, _redact(df[text_col]))
