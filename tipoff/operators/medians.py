"""Exact medians of many columns by counting.

Every pass counts the values of each column's interval in bins, with the least and the largest of
each bin; the bin that holds the middle ranks is the next interval. Ranks in two bins are the
largest of one and the least of the other. What is left to sort in the end is a few thousand
values a column, whatever the number of rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tipoff.operators.lineage import written

#: Bins of an interval; values of a column that are sorted in one place; largest double.
BINS, FEW, LARGEST = 256, 4096, 1.7976931348623157e308


@dataclass
class Interval:
    """Values of a column between low and high, `count` of them, above `below` others; the
    middle ranks are `first` and `last`, from 0."""

    low: float
    high: float
    count: int
    below: int
    first: int
    last: int


def _bin(v, low, high) -> F.Column:
    """0 to BINS - 1, never falling as v rises; halves keep the width finite."""
    held = lambda x: F.greatest(F.least(x, F.lit(LARGEST)), F.lit(-LARGEST)) / 2
    share = F.try_divide(held(v) - held(low), held(high) - held(low))
    return F.greatest(F.least(F.floor(F.coalesce(share, F.lit(0.0)) * BINS), F.lit(BINS - 1)), F.lit(0)).cast("int")


def medians(df: DataFrame, columns: list[str], few: int = FEW) -> dict[str, float | None]:
    """The exact median of each column (the mean of the two middle values of an even number);
    None for a column without values. Null and NaN are no values (A12)."""
    if not columns:
        return {}
    spark = df.sparkSession
    cells = F.inline(F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"`{c}`").cast("double").alias("v")) for k, c in enumerate(columns))))
    values = written(df.select(cells).where("v is not null and not isnan(v)"), "values")
    figures = lambda g: g.agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    found: dict[int, float] = {}
    open_: dict[int, Interval] = {}
    for r in figures(values.groupBy("k")).collect():  # a row per column
        open_[r["k"]] = Interval(r["low"], r["high"], r["n"], 0, (r["n"] - 1) // 2, r["n"] // 2)

    def within(which: dict[int, Interval]) -> DataFrame:
        bounds = spark.range(1).select(F.inline(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(i.low).alias("low"), F.lit(i.high).alias("high")) for k, i in which.items()))))
        return values.join(F.broadcast(bounds), "k").where("v >= low and v <= high")  # a row per column

    while True:
        for k, i in [x for x in open_.items() if x[1].low == x[1].high]:
            found[k] = i.low
            del open_[k]
        wide = {k: i for k, i in open_.items() if i.count > few}
        if not wide:
            break
        bins: dict[int, list] = {}
        for r in figures(within(wide).groupBy("k", _bin(F.col("v"), F.col("low"), F.col("high")).alias("bin"))).orderBy("k", "bin").collect():  # BINS a column
            bins.setdefault(r["k"], []).append(r)
        for k, i in wide.items():
            below, middle = i.below, []
            for r in bins[k]:
                if below <= i.last and below + r["n"] > i.first:
                    middle.append((below, r))
                below += r["n"]
            if len(middle) == 2:
                found[k] = middle[0][1]["high"] / 2 + middle[1][1]["low"] / 2
                del open_[k]
            else:
                start, r = middle[0]
                if r["n"] == i.count:  # bins no longer part them
                    found[k] = _sorted_middle(within({k: i}), i)
                    del open_[k]
                else:
                    open_[k] = Interval(r["low"], r["high"], r["n"], start, i.first, i.last)
    if open_:
        rows = within(open_).groupBy("k").agg(F.sort_array(F.collect_list("v")).alias("v")).collect()  # `few` a column
        for r in rows:
            i = open_[r["k"]]
            found[r["k"]] = (r["v"][i.first - i.below] + r["v"][i.last - i.below]) / 2
    return {c: found.get(k) for k, c in enumerate(columns)}


def _sorted_middle(values: DataFrame, i: Interval) -> float:
    """By counts of the values themselves: for neighbours that no width parts."""
    at, picked = i.below, []
    for r in values.groupBy("v").count().orderBy("v").toLocalIterator():
        picked += [r["v"]] * sum(at <= rank < at + r["count"] for rank in {i.first, i.last})
        at += r["count"]
        if at > i.last:
            break
    return (picked[0] + picked[-1]) / 2
