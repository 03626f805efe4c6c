"""Exact order statistics by counts of ranges: no sort, and no buffer that grows with the distinct values.

Each pass counts the rows of a few ranges between approximate quantiles and goes on in the range that holds the wanted place, so a
pass leaves about one part in RANGES of the rows. It ends where a range holds one value, where the place is a range's first or
last row, or where HELD distinct values are left, which the driver gets with their counts.

Nulls take no part; NaN is above all numbers, as in a sort; an empty column has no order statistics. Ties and repeated rows
count each.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RANGES, HELD = 64, 4096


def _between(values: DataFrame, low: float | None, high: float | None) -> DataFrame:
    """Above ``low``, up to ``high``."""
    if low is not None:
        values = values.where(F.col("v") > F.lit(low))
    return values if high is None else values.where(F.col("v") <= F.lit(high))


def nth(df: DataFrame, column: str, places: list[int]) -> list[float]:
    """The values at the places, from 0, of the column's sorted numbers (no nulls, no NaN), each place a valid one."""
    values = df.select(F.col(column).cast("double").alias("v")).where("v IS NOT NULL AND NOT isnan(v)")
    return [_one(values, p) for p in places]


def _one(values: DataFrame, place: int) -> float:
    low = high = None
    before = 0
    while True:
        part = _between(values, low, high)
        quantiles = F.percentile_approx("v", [k / RANGES for k in range(1, RANGES)], 1000)
        sized = part.agg(F.approx_count_distinct("v").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"), quantiles.alias("edges")).first()
        if sized["least"] == sized["most"]:
            return sized["least"]
        if sized["n"] <= HELD // 2:  # the estimate may be a few hundredths off
            for r in part.groupBy("v").count().orderBy("v").collect():
                before += r["count"]
                if before > place:
                    return r["v"]
        edges = sorted(set(sized["edges"]) - {sized["most"]}) or [sized["least"]]
        bounds = F.array(*(F.lit(e) for e in edges))
        ranges = part.groupBy(F.size(F.filter(bounds, lambda e: F.col("v") > e)).alias("range")).agg(F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"))
        for r in ranges.orderBy("range").collect():  # RANGES rows at most
            if before + r["n"] > place:
                break
            before += r["n"]
        if place == before or r["least"] == r["most"]:
            return r["least"]
        if place == before + r["n"] - 1:
            return r["most"]
        low = edges[r["range"] - 1] if r["range"] else low
        high = edges[r["range"]] if r["range"] < len(edges) else high


def median(df: DataFrame, column: str) -> float | None:
    """The middle value, or the middle between both; None without values, NaN where a middle one is."""
    c = F.col(column).cast("double")
    n, numbers = df.agg(F.count(c), F.count_if(c.isNotNull() & ~F.isnan(c))).first()
    if not n:
        return None
    low, high = (n - 1) // 2, n // 2
    if high >= numbers:
        return math.nan
    found = nth(df, column, sorted({low, high}))
    a, b = found[0], found[-1]
    return a if a == b else a / 2 + b / 2 if math.isinf(b - a) else a + (b - a) / 2
