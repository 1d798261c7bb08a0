"""Connected components by alternating large and small stars; every step is a join and an aggregation.

Each step writes its links, notes which they are as they are written, and deletes those of the step before. Defined
results: no links, no rows; loops and links with a null end don't count; repeated links count once; a node in no link has no row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .shared import discard, table


def _hang(neighbours: DataFrame, larger_only: bool) -> DataFrame:
    """Hangs the neighbours of each node u on the least of u and its neighbours."""
    least = neighbours.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    met = neighbours.join(least, "u")
    if larger_only:
        return met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return met.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))


def _noted(links: DataFrame) -> tuple[DataFrame, tuple[int, int]]:
    """The links as a table, and their number and a mark of which they are, taken while they are written."""
    seen, what = Observation(), (F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)).alias("mark"))
    out = table(links.observe(seen, *what))
    got = seen.get or out.agg(*what).first().asDict()  # nothing is observed where Spark finds a plan to be empty
    return out, (got["n"], got["mark"])


def components(edges: DataFrame) -> DataFrame:
    """edges: u, v (long). Returns node, root: the smallest node of its component, for every node of an edge."""
    flip = lambda e: e.select(F.col("v").alias("u"), F.col("u").alias("v"))
    now, seen = _noted(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while seen[0]:
        large = _hang(now.union(flip(now)), larger_only=True)
        before, last = now, seen
        now, seen = _noted(_hang(large, larger_only=False).where("u <> v").distinct())
        discard(before)
        if last == seen:
            break
    pairs = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return pairs.union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
