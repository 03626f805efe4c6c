"""Quality rules: a table of thresholds compiled into one projection of native expressions.

Every measure and verdict is a Catalyst expression: no user functions, no shuffle, no join. A row's cost is
O(n log n) in its words, so one very long text costs no more than its share.

Defined results: a null or blank text has no words, so every count is 0, ``base_failed`` is true and ``kept`` false.
A null id is passed through. Repeated rows are judged each by itself. Further input columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.llm.common import BLANKS, let, split_words

SYMBOLS = "#*$%&|<>"
WINDOW = 8

#: Frequent function words of the languages served.
STOP_WORDS = (
    "a an and are as at be by for from has he in is it of on or she that the this to was were will with "
    "als auf das dem den der des die ein eine für ich im ist mit nicht sich und von zu "
    "au avec ce dans de des du elle en est et il la le les ne nous par pas pour que qui sur un une "
    "al como con del el es las lo los más no para por se su una y"
).split()


@dataclass(frozen=True)
class Rule:
    """Keep a text only while ``low <= measure <= high``."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None


#: The production table. Ratios are per word, but for duplicate lines, which are per line that has a word.
RULES = (
    Rule("length", "n_words", low=20),
    Rule("word_length", "mean_word_length", low=2.0, high=20.0),
    Rule("symbols", "symbol_ratio", high=0.3),
    Rule("stop_words", "stop_ratio", low=0.01),
    Rule("duplicate_lines", "dup_line_ratio", high=0.5),
)


def _covered(hashes: Column) -> Column:
    """Words under windows whose hash stands twice or more: sort (hash, place), keep equal neighbours, join the intervals."""
    keyed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))

    def twice(s: Column) -> Column:
        same = lambda e, at: F.coalesce(F.get(s, at)["h"] == e["h"], F.lit(False))
        places = F.transform(F.filter(s, lambda e, i: same(e, i - 1) | same(e, i + 1)), lambda e: e["p"])
        return F.aggregate(
            F.sort_array(places),
            F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
            lambda a, p: F.struct((a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n"), p.alias("last")),
            lambda a: a["n"],
        )

    return let(keyed, twice)


def repeat_words(words: Column) -> Column:
    """Words in 8-word windows found twice or more in the text, the first ones included."""
    windows = F.transform(F.sequence(F.lit(1), F.size(words) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))
    return F.when(F.size(words) <= WINDOW, F.lit(0)).otherwise(
        let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_covered(h)))
    )


def measures(text: Column) -> Column:
    """A struct of all measures of a text."""
    whole = F.coalesce(text, F.lit(""))
    filled = F.filter(F.split(whole, "\n", -1), lambda line: F.btrim(line, F.lit(BLANKS)) != "")
    of_words = let(
        split_words(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            repeat_words(w).cast("long").alias("n_repeat_words"),
            F.size(F.filter(w, lambda x: F.lower(x).isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
        ),
    )
    of_lines = let(filled, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    return let(
        F.struct(of_words.alias("w"), of_lines.alias("l")),
        lambda m: F.struct(
            m["w"]["n_words"].alias("n_words"),
            F.char_length(F.translate(whole, BLANKS, "")).cast("long").alias("word_chars"),
            (F.char_length(whole) - F.char_length(F.translate(whole, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            m["l"]["n_dup_lines"].alias("n_dup_lines"),
            m["w"]["n_repeat_words"].alias("n_repeat_words"),
            m["w"]["n_stop_words"].alias("n_stop_words"),
            m["l"]["n_lines"].alias("n_lines"),
        ),
    )


def ratios(m: Column) -> dict[str, Column]:
    per_word = lambda c: m[c] / F.greatest(m["n_words"], F.lit(1))
    return {
        "n_words": m["n_words"].cast("double"),
        "mean_word_length": per_word("word_chars"),
        "symbol_ratio": per_word("n_symbols"),
        "stop_ratio": per_word("n_stop_words"),
        "dup_line_ratio": m["n_dup_lines"] / F.greatest(m["n_lines"], F.lit(1)),
    }


def compile_rules(m: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The names of the rules that a text breaks, as an array."""
    known = ratios(m)
    broken = []
    for r in rules:
        ok = F.lit(True)
        if r.low is not None:
            ok = ok & (known[r.measure] >= F.lit(float(r.low)))
        if r.high is not None:
            ok = ok & (known[r.measure] <= F.lit(float(r.high)))
        broken.append(F.when(~ok, F.lit(r.name)))
    return F.array_compact(F.array(*broken)) if broken else F.array().cast("array<string>")


def judge(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Measures, base verdict, broken rules and ``kept`` of a text, as one struct."""
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_lines")
    return let(
        measures(text),
        lambda m: let(
            F.struct(((m["n_words"] < 20) | (100 * m["n_repeat_words"] > 30 * m["n_words"])).alias("base_failed"), compile_rules(m, rules).alias("broken_rules")),
            lambda v: F.struct(
                *(m[c].alias(c) for c in names),
                v["base_failed"].alias("base_failed"),
                v["broken_rules"].alias("broken_rules"),
                (~v["base_failed"] & (F.size(v["broken_rules"]) == 0)).alias("kept"),
            ),
        ),
    )


def quality_rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per input row: the id, every measure, ``base_failed``, ``broken_rules`` and ``kept``."""
    return df.select(df[id_col].alias("doc_id"), judge(df[text_col], rules).alias("v")).select("doc_id", "v.*")


def keep_good(df: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows whose text passes, with their own columns."""
    return df.where(judge(df[text_col], rules)["kept"])
