"""Secret scans in native expressions: base patterns, and sliding-window entropy over candidate strings.

A candidate is a maximal run of a character class. What the allow list matches is cut out of it, so that a window never
touches an allowed word, and an allowed word beside a key suppresses nothing but itself. A window slides over each piece that
is left; the entropy of the window follows from the counts of its characters, of which each step changes two. A candidate of
which a piece has the kinds of characters asked for and a window that reaches its class's threshold adds a span, the whole
run, unless it overlaps a base span. Base spans always stay.

Entropies are sums of k * log2(k) in whole numbers, so that a window at the threshold is at it in any order of steps. An
array can't change in place, so a step of the window writes one count for each character of the class: a constant.

Defined results: null and empty texts have no spans; a null id is passed through; repeated rows are scanned each; an empty
table gives no rows; further columns are not read. Work grows with the text and its matches, not with their square: places
are running sums, taken in chunks, and each match is judged once. Texts without a match stop at the patterns.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.llm.common import let

#: Base patterns. The length of access and hex matches is in the pattern: their runs are maximal either way.
ASSIGN = "([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"


@dataclass(frozen=True)
class CharacterClass:
    """Runs of ``pattern`` are candidates; their windows of ``window`` characters need ``bits`` of entropy.

    ``needs`` are patterns that a piece of a candidate must have all of: natural words do not mix cases and digits.
    """

    name: str
    alphabet: str
    pattern: str
    window: int
    bits: float
    needs: tuple[str, ...]


_UPPER, _LOWER, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
CLASSES = (
    CharacterClass("entropy_hex", _DIGITS + "ABCDEFabcdef", "[0-9A-Fa-f]{24,}", 24, 3.0, ("[0-9]", "[A-Fa-f]")),
    CharacterClass("entropy_base64", _UPPER + _LOWER + _DIGITS + "+/_-", "[A-Za-z0-9+/_-]{20,}", 20, 3.75, ("[0-9]", "[A-Z]", "[a-z]")),
    CharacterClass("entropy_lower", _LOWER + _DIGITS, "[a-z0-9]{24,}", 24, 3.7, ("[0-9][a-z]+[0-9]", "[a-z]")),
    CharacterClass("entropy_upper", _UPPER + _DIGITS, "[A-Z0-9]{24,}", 24, 3.7, ("[0-9][A-Z]+[0-9]", "[A-Z]")),
)
#: What holds one of these is no secret.
ALLOWED = (
    "(?:EXAMPLE|example|placeholder|PLACEHOLDER)",
    "(?:0123456789|123456789|abcdefghij|ABCDEFGHIJ)",
    "(?:0{8}|1{8}|[xX]{8}|f{8}|F{8})",
    "(?:deadbeef|DEADBEEF|cafebabe|CAFEBABE)",
)


_NO_SPANS = "array<struct<start:int,end:int,m:string>>"
#: Entropy sums are counted in parts of 2^-40; windows this near to the threshold, in bits, are at it.
_UNIT, _NEAR = 1 << 40, 5e-10


def running(xs: Column, levels: int = 2, chunk: int = 256) -> Column:
    """For each element of an array of whole numbers, the sum of those before it.

    An array that grows in a fold is copied at every step, so folds run inside chunks, and over sums of chunks of chunks.
    """

    def fold(part: Column, begin: Column) -> Column:
        start = F.struct(begin.alias("at"), F.array().cast("array<bigint>").alias("out"))
        return F.aggregate(part, start, lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])

    zero = F.lit(0).cast("bigint")
    if levels == 1:
        return fold(xs, zero)

    def parts(v: Column) -> Column:
        last = F.size(v) - 1
        return F.transform(F.sequence(F.lit(0), last.cast("int"), F.lit(chunk)), lambda k: F.transform(F.sequence(k, F.least(k + chunk - 1, last)), lambda i: F.get(v, i)))

    def joined(cs: Column) -> Column:
        totals = F.transform(cs, lambda c: F.aggregate(c, zero, lambda a, x: a + x))
        return F.flatten(F.zip_with(cs, running(totals, levels - 1, chunk), fold))

    return let(xs, lambda v: F.when(F.size(v) > 0, let(parts(v), joined)).otherwise(F.array().cast("array<bigint>")))


def _spans(text: Column, pattern: str, keep_if: Callable[[Column], Column]) -> Column:
    """(start, end, match) of the leftmost non-overlapping matches that are kept, in code points."""

    def placed(found: Column, verdicts: Column) -> Column:
        gaps = F.transform(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), lambda p: F.char_length(p))
        sizes = F.zip_with(gaps, found, lambda g, m: F.struct(g.cast("bigint").alias("gap"), F.char_length(m).cast("bigint").alias("n")))
        starts = let(sizes, lambda z: F.zip_with(running(F.transform(z, lambda x: x["gap"] + x["n"])), z, lambda at, x: at + x["gap"]))
        spans = F.zip_with(starts, found, lambda at, m: F.struct(at.cast("int").alias("start"), (at.cast("int") + F.char_length(m)).alias("end"), m.alias("m")))
        kept = F.filter(F.zip_with(spans, verdicts, lambda s, v: F.struct(s.alias("s"), v.alias("v"))), lambda x: x["v"])
        return F.transform(kept, lambda x: x["s"])

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    none = F.array().cast(_NO_SPANS)
    judged = lambda m: let(F.transform(m, keep_if), lambda v: F.when(F.array_contains(v, True), placed(m, v)).otherwise(none))
    return let(found, lambda m: F.when(F.size(m) > 0, judged(m)).otherwise(none))


def _free(spans: Column, base: Column) -> Column:
    """The spans, in order and apart, that overlap none of the base.

    As many base spans must have begun before a span's end as have ended by its start. Both counts come from one sorted
    list of places and its running sum.
    """

    def counts(of_base: Callable[[Column], Column], of_span: Callable[[Column], Column], first: int) -> Column:
        events = F.concat(
            F.transform(base, lambda b: F.struct(of_base(b).alias("at"), F.lit(1 - first).alias("order"), F.lit(1).cast("bigint").alias("one"))),
            F.transform(spans, lambda s: F.struct(of_span(s).alias("at"), F.lit(first).alias("order"), F.lit(0).cast("bigint").alias("one"))),
        )
        summed = lambda e: F.zip_with(e, running(F.transform(e, lambda x: x["one"])), lambda x, n: F.struct(x["one"].alias("one"), n.alias("n")))
        return F.transform(F.filter(let(F.sort_array(events), summed), lambda x: x["one"] == 0), lambda x: x["n"])

    begun, ended = counts(lambda b: b["start"], lambda s: s["end"], 0), counts(lambda b: b["end"], lambda s: s["start"], 1)
    open_ = F.zip_with(begun, ended, lambda x, y: x - y)
    clear = F.filter(F.zip_with(spans, open_, lambda s, n: F.struct(s.alias("s"), n.alias("n"))), lambda x: x["n"] == 0)
    return F.when((F.size(spans) > 0) & (F.size(base) > 0), F.transform(clear, lambda x: x["s"])).otherwise(spans)


def reaches(candidate: Column, c: CharacterClass) -> Column:
    """Whether the largest entropy of a window over the candidate is at least the class's bits."""
    xlogx = F.array(*(F.lit(0 if k < 2 else round(k * math.log2(k) * _UNIT)).cast("bigint") for k in range(c.window + 1)))
    limit = math.floor(c.window * (math.log2(c.window) - c.bits + _NEAR) * _UNIT)
    n = len(c.alphabet)

    def slide(chars: Column, table: Column) -> Column:
        def step(a: Column, i: Column) -> Column:
            come, go = F.get(chars, i), F.when(i >= c.window, F.get(chars, i - c.window))
            counted = F.transform(a["counts"], lambda k, j: k + F.when(j == come, 1).otherwise(0) - F.when(j == go, 1).otherwise(0))
            before_in, before_out = F.get(a["counts"], come), F.get(a["counts"], go)
            added = F.get(table, before_in + 1) - F.get(table, before_in)
            moved = F.when(go.isNull(), added).when(go == come, F.lit(0).cast("bigint")).otherwise(added + F.get(table, before_out - 1) - F.get(table, before_out))
            total = a["sum"] + moved
            return F.struct(counted.alias("counts"), total.alias("sum"), F.when(i >= c.window - 1, F.least(a["least"], total)).otherwise(a["least"]).alias("least"))

        start = F.struct(F.array_repeat(F.lit(0), n).alias("counts"), F.lit(0).cast("bigint").alias("sum"), F.lit((1 << 63) - 1).cast("bigint").alias("least"))
        return F.aggregate(F.sequence(F.lit(0), F.size(chars) - 1), start, step, lambda a: a["least"] <= limit)

    places = F.transform(F.split(candidate, "", -1), lambda ch: F.instr(F.lit(c.alphabet), ch) - 1)
    return let(F.filter(places, lambda p: p >= 0), lambda chars: let(xlogx, lambda table: slide(chars, table)))


def _candidate(m: Column, c: CharacterClass, allowed: tuple[str, ...]) -> Column:
    def piece(x: Column) -> Column:
        ok = F.char_length(x) >= c.window
        for need in c.needs:
            ok = ok & x.rlike(need)
        return F.when(ok, reaches(x, c)).otherwise(False)

    pieces = F.split(m, "|".join(allowed), -1) if allowed else F.array(m)
    return F.exists(pieces, piece)


def _accepts(c: CharacterClass, allowed: tuple[str, ...]) -> Callable[[Column], Column]:
    return lambda m: _candidate(m, c, allowed)


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", classes: tuple[CharacterClass, ...] = CLASSES, allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    text = F.coalesce(df[text_col], F.lit(""))
    value = F.regexp_extract
    kinds = [
        ("assign", ASSIGN, lambda m: F.char_length(value(m, ASSIGN, 2)) >= 6),
        ("access", ACCESS, lambda m: F.lit(True)),
        ("hex", HEX, lambda m: F.lit(True)),
    ]
    columns = {name: _spans(F.col("text"), pattern, keep_if=ok) for name, pattern, ok in kinds}
    columns |= {c.name: _spans(F.col("text"), c.pattern, keep_if=_accepts(c, allowed)) for c in classes}
    names = list(columns)
    tagged = lambda k: F.transform(F.col(k), lambda s: F.struct(s["start"].alias("start"), F.lit(names.index(k)).alias("kind"), s["end"].alias("end")))
    base_of = F.sort_array(F.concat(*(tagged(k) for k, _, _ in kinds)))
    scanned = df.select(df[id_col].alias("doc_id"), text.alias("text")).select("doc_id", *(e.alias(k) for k, e in columns.items()))
    based = scanned.withColumn("base", base_of)
    every = F.concat(F.col("base"), *(_free(tagged(c.name), F.col("base")) for c in classes))
    label = F.array(*(F.lit(n) for n in names))
    show = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", F.get(label, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    return based.withColumn("all", F.sort_array(every)).select(
        "doc_id",
        *(F.size(k).cast("long").alias(f"n_{k}") for k, _, _ in kinds),
        F.sha2(show(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        show(F.col("all")).alias("spans"),
    )
