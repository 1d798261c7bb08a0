"""Exact values at given ranks, found by counting: nothing is sorted and no value is shuffled.

A double is read as a whole number that is ordered as it is. Rows are counted by its leading bits. What lies between the least
and the greatest number counted where a wanted rank falls is counted again, by the bits in which these two may differ, for all
groups and ranks at once, until one value is left. Each pass sends at most 2 ** LOOK counts a range and task, whatever the
number of rows, and fetches a row for each open range; six passes are the most, three are usual.
"""

from __future__ import annotations

import math
import struct
from collections import defaultdict
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bits that one pass looks at.
LOOK = 12
_FRACTION = 52  # bits of a double's fraction
_BIAS = 1023  # its least exponent is 1 - _BIAS


def order_key(df: DataFrame, value: str, to: str) -> DataFrame:
    """Adds a whole number for each double: ordered as the doubles, 0 and -0 alike, NaN above all; null for null.

    The number is that of the double's own exponent and fraction bits, found by exact arithmetic: the logarithm only guesses
    the exponent, dividing by a power of two is exact.
    """
    power = lambda e: F.pow(F.lit(2.0), e)
    size = F.when(F.abs(F.col(value)) < float("inf"), F.abs(F.col(value))).otherwise(0.0)
    guess = F.greatest(F.lit(1 - _BIAS), F.floor(F.log2(F.nullif(size, F.lit(0.0)))).cast("int"))
    out = df.withColumn(f"{to}_e", guess)
    e = F.col(f"{to}_e")
    out = out.withColumn(f"{to}_e", F.when((size < power(e)) & (e > 1 - _BIAS), e - 1).when(size >= power(e + 1), e + 1).otherwise(e))
    out = out.withColumn(f"{to}_r", size / power(e))
    ratio = F.col(f"{to}_r")
    small = (ratio < 1).cast("int")  # only the numbers of least exponent
    whole = (e + _BIAS - small).cast("long") * (1 << _FRACTION) + ((ratio - 1 + small) * float(1 << _FRACTION)).cast("long")
    top = F.lit((2 * _BIAS + 1) << _FRACTION)
    key = F.when(F.isnan(value), top + 1).when(F.abs(F.col(value)) == float("inf"), top).otherwise(whole)
    return out.withColumn(to, F.when(F.col(value) < 0, -key).when(F.col(value).isNotNull(), key)).drop(f"{to}_e", f"{to}_r")


def value_of(key: int) -> float:
    """The double of a key."""
    if abs(key) > (2 * _BIAS + 1) << _FRACTION:
        return math.nan
    return math.copysign(struct.unpack("<d", struct.pack("<q", abs(key)))[0], key)


def at_ranks(rows: DataFrame, group: str, value: str, ranks: Callable[[int], list[int]], n: str | None = None) -> dict[object, tuple[int, dict[int, float]]]:
    """For each group its number of rows and the values at ranks (from 1) in ascending order; ranks: those wanted of so many rows.

    Rows may stand for several (n). Null values and rows of no group take no part. Groups and their ranks are few, and are what the driver holds;
    rows are read once a pass, so keep what is costly.
    """
    spark = rows.sparkSession
    weight = F.col(n) if n else F.lit(1)
    keyed = order_key(rows.where(F.col(value).isNotNull() & F.col(group).isNotNull()).select(F.col(group).alias("g"), F.col(value).cast("double").alias("v"), weight.cast("long").alias("n")), "v", "k").drop("v")
    figures = [F.sum("n").alias("n"), F.min("k").alias("lo"), F.max("k").alias("hi")]
    kind = dict(keyed.dtypes)["g"]

    def hits(counts: DataFrame, open_: list[tuple]) -> list:
        """Of the counts (g, r, p) those in which a wanted rank lies, with the rows before them. open_: g, r, rows before, ranks."""
        ranges = F.broadcast(spark.createDataFrame(open_, f"g {kind}, r int, b long, w array<long>"))  # a row for each rank at most
        ahead = Window.partitionBy("g", "r").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
        sums = counts.join(ranges, ["g", "r"]).withColumn("b", F.col("b") + F.coalesce(F.sum("n").over(ahead), F.lit(0)))
        return sums.withColumn("w", F.filter("w", lambda t: (t > F.col("b")) & (t <= F.col("b") + F.col("n")))).where(F.size("w") > 0).collect()

    first = keyed.groupBy("g", F.lit(0).alias("r"), F.shiftright("k", _FRACTION).alias("p")).agg(*figures).persist()
    try:
        totals = {r["g"]: r["n"] for r in first.groupBy("g").agg(F.sum("n").alias("n")).collect()}
        wanted = [(g, 0, 0, w) for g, total in totals.items() if (w := sorted(set(ranks(total))))]
        met = hits(first, wanted) if wanted else []
    finally:
        first.unpersist()
    found: dict[object, dict[int, float]] = defaultdict(dict)
    while met:
        open_, spans = [], defaultdict(list)
        for r in met:
            if r["lo"] == r["hi"]:
                found[r["g"]].update(dict.fromkeys(r["w"], value_of(r["hi"])))
            else:
                id_ = len(spans[r["g"]])
                spans[r["g"]].append((id_, r["lo"], r["hi"], max(0, (r["hi"] - r["lo"]).bit_length() - LOOK)))
                open_.append((r["g"], id_, r["b"], r["w"]))
        if not open_:
            break
        table = F.broadcast(spark.createDataFrame(list(spans.items()), f"g {kind}, s array<struct<r int, lo long, hi long, shift int>>"))
        mine = F.get(F.filter("s", lambda x: F.col("k").between(x["lo"], x["hi"])), F.lit(0))
        inside = keyed.join(table, "g").select("g", "k", "n", mine.alias("s")).where(F.col("s").isNotNull())
        counts = inside.groupBy("g", F.col("s.r").alias("r"), F.expr("shiftright(k - s.lo, s.shift)").alias("p")).agg(*figures)
        met = hits(counts, open_)
    return {g: (total, found[g]) for g, total in totals.items()}


def cut_ranks(total: int, k: int) -> list[int]:
    """The ranks of the k - 1 discrete quantiles of so many rows: ceil(b * total / k), of fewer rows than k as many quantiles."""
    k = max(1, min(k, total))
    return [-(-b * total // k) for b in range(1, k)]


def cuts(rows: DataFrame, group: str, value: str, ks: list[int], n: str | None = None) -> dict[object, dict[int, list[float]]]:
    """For each group and k the distinct values at its quantiles' ranks, ascending."""
    at = at_ranks(rows, group, value, lambda total: [t for k in ks for t in cut_ranks(total, k)], n)
    return {g: {k: sorted({found[t] for t in cut_ranks(total, k)}) for k in ks} for g, (total, found) in at.items()}
