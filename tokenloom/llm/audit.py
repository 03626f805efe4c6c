"""Filter interaction audit: what each of five filters removes, in every order, from one pass of relational word counts.

Texts are dealt out once by their key, words are exploded and aggregated by (key, word), then by key: totals and distinct
words. Both aggregations follow the partitioning of the texts, so no word is shuffled. The other filters' flags come from a
narrow scan, copies by an aggregation to the smallest id of each text's digest; an outer join brings all flags together.
They are counted in 32 conditional columns, one for each set of filters that a document fails, for all, good and toxic
documents of each part. Every figure of every order is a sum of those, so nothing is computed order by order over documents.

The key of a text is its id with a 64-bit hash of the text, so an id on several texts has each counted by itself; equal rows
of one key double all its words, which an end mark in each row counts and takes back. Hot sources, texts and words are only
ever summed behind a partial aggregation; a hot digest meets one row, in a join that adaptive execution splits.

Defined results: a null text is an empty one; empty texts fail A, and are copies of one another; a null id is no copy and
has none, nor labels; equal rows are counted each, and are no copies of one another; an id with several labels is good if
one of them says so, toxic likewise; a null source is the part of the empty string; an empty table has no parts and so no
rows. Further columns are not read.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.llm.common import Steps, split_words

FILTERS = "ABCDE"
SETS = 1 << len(FILTERS)
UPPER, SYMBOLS = "[A-Z]", "[#$%&*|]"
LEAST_WORDS, LEAST_DISTINCT, MOST_UPPER = 50, 65, 5
ORDERS = tuple("".join(p) for p in permutations(FILTERS))


def word_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, h, words, distinct) for each key of rows (doc_id, h, text), by exploded words.

    Words are grouped as bytes: for text, Spark first tries a small map, which is full after a few documents and only costs.
    """
    dealt = docs.repartition("doc_id", "h")
    words = dealt.select("doc_id", "h", F.explode(F.concat(split_words(F.col("text")), F.array(F.lit(None).cast("string")))).alias("word"))
    each = words.groupBy("doc_id", "h", F.col("word").cast("binary").alias("word")).agg(F.count("*").alias("n"))
    rows, total = F.sum(F.when(F.col("word").isNull(), F.col("n"))), F.sum(F.when(F.col("word").isNotNull(), F.col("n")))
    return each.groupBy("doc_id", "h").agg((F.coalesce(total, F.lit(0)) / rows).cast("long").alias("words"), F.count("word").alias("distinct"))


def other_flags(docs: DataFrame) -> DataFrame:
    """(doc_id, h, part, c, d, e) for each row (doc_id, h, part, text)."""
    text, upper = F.col("text"), F.regexp_count("text", F.lit(UPPER))
    flags = docs.select(
        "doc_id", "h", "part",
        (100 * upper > MOST_UPPER * F.char_length(text)).alias("c"), text.rlike(SYMBOLS).alias("d"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"),
    )
    copied = flags.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("digest", "first")
    copied = Steps(docs.sparkSession, "audit").keep("copied", copied)  # a table of its own, so that the join's two exchanges can be split
    return flags.join(copied, "digest", "left").select("doc_id", "h", "part", "c", "d", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).alias("e"))


def failed_sets(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """Per row: doc_id, part, failed (bit i is set if filter i of FILTERS fails), good, toxic."""
    text = F.coalesce(df[text_col], F.lit(""))
    docs = df.select(df[id_col].cast("long").alias("doc_id"), F.coalesce(df[part_col].cast("string"), F.lit("")).alias("part"), text.alias("text"), F.xxhash64(text).alias("h"))
    words, flags = word_counts(docs.select("doc_id", "h", "text")), other_flags(docs)
    words = words.select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"), "words", "distinct")
    joined = flags.join(words, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")), "left")
    is_one = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)))
    known = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(is_one("quality").alias("good"), is_one("toxic").alias("toxic"))
    fails = [F.col("words") < LEAST_WORDS, 100 * F.col("distinct") < LEAST_DISTINCT * F.col("words"), F.col("c"), F.col("d"), F.col("e")]
    failed = sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))
    flag = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    return joined.join(known, "doc_id", "left").select("doc_id", "part", failed.alias("failed"), flag("good"), flag("toxic"))


def count_sets(failed: DataFrame) -> DataFrame:
    """Per part: n, good and toxic, each an array of conditional counts by the set of filters failed."""
    kinds = {"n": F.lit(True), "good": F.col("good"), "toxic": F.col("toxic")}
    columns = [F.count_if((F.col("failed") == m) & which).alias(f"{k}{m}") for k, which in kinds.items() for m in range(SETS)]
    counted = failed.groupBy("part").agg(*columns)
    return counted.select("part", *(F.array(*(f"{k}{m}" for m in range(SETS))).alias(k) for k in kinds))


def filter_audit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """Per part, order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    counts = count_sets(failed_sets(df, labels, id_col, text_col, part_col))
    steps = [(o, k + 1, 1 << FILTERS.index(f), sum(1 << FILTERS.index(b) for b in o[:k])) for o in ORDERS for k, f in enumerate(o)]
    table = F.array(*(F.struct(F.lit(o).alias("filter_order"), F.lit(k).alias("step"), F.lit(own).alias("own"), F.lit(before).alias("before")) for o, k, own, before in steps))
    rows = counts.withColumn("s", F.explode(table)).select("*", "s.*")
    own, before = F.col("own"), F.col("before")

    def total(of: str, wanted, times=lambda m: F.lit(1)) -> Column:
        picked = F.transform(F.col(of), lambda n, m: F.when(wanted(m), n * times(m)).otherwise(0))
        return F.aggregate(picked, F.lit(0).cast("long"), lambda a, x: a + x)

    fails = lambda m: m.bitwiseAND(own) != 0
    here = lambda m: fails(m) & (m.bitwiseAND(before) == 0)
    orders = lambda m: (F.lit(len(ORDERS)) / F.bit_count(m)).cast("long")  # noqa: E731  in which the filter comes first of those that m fails
    return rows.select(
        "part", "filter_order", "step",
        total("n", lambda m: m.bitwiseAND(own + before) == 0).alias("kept"),
        total("n", here).alias("removed"),
        total("n", lambda m: fails(m) & (m.bitwiseAND(before) != 0)).alias("redundant"),
        total("n", lambda m: m == own).alias("unique_fails"),
        total("good", here).alias("good_lost"),
        total("toxic", here).alias("toxic_lost"),
        total("n", fails, orders).alias("shapley"),
    )
