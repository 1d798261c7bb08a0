"""Global ranks and running totals without one task that sorts everything.

Rows are cut into buckets at key points: rows of (group, value, tie-break columns), so a value that many rows
share is cut as well. The points are fetched once, from a hashed share of the keys, and the number of buckets follows
from the number of rows. What comes out doesn't depend on the points: windows run inside buckets, bucket totals carry over.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from .radix import cuts

#: Rows of a bucket, about; buckets at most; keys looked at per bucket.
PER_BUCKET, MOST, SEEN = 200_000, 4096, 16


def fetched(rows: DataFrame) -> DataFrame:
    """The same rows, which must be few, fetched now."""
    return rows.sparkSession.createDataFrame(rows.collect(), rows.schema)


def settled(rows: DataFrame, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """build(rows), which must have few rows: they are fetched, while `rows`, which it reads several times, is kept."""
    kept = rows.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return fetched(build(kept))
    finally:
        kept.unpersist()


def _points(df: DataFrame, key: list[str], n: int, buckets: int) -> list:
    """Keys that part df evenly: all rows of equal keys stay together, so only rows that no key tells apart can be many."""
    share = max(1, n // (SEEN * buckets))
    some = df.select(*key).where(F.pmod(F.xxhash64(*key), F.lit(share)) == 0).distinct().orderBy(*key).collect()
    step = max(1, -(-len(some) // buckets))
    return some[step::step]


def bucketed(df: DataFrame, key: list[str], per_bucket: int = PER_BUCKET) -> DataFrame:
    """Adds _bucket, rising with key. Looks twice at df, so keep it if it is costly."""
    n = df.count()
    buckets = min(MOST, -(-n // per_bucket))
    points = _points(df, key, n, buckets) if buckets > 1 else []
    if not points:
        return df.withColumn("_bucket", F.lit(0))
    width = math.isqrt(len(points) - 1) + 1  # two short looks in place of one long one
    blocks = [points[i : i + width] for i in range(0, len(points), width)]
    kind = StructType([df.schema[k] for k in key])
    shape = StructType([StructField("_one", IntegerType()), StructField("_heads", ArrayType(kind)), StructField("_blocks", ArrayType(ArrayType(kind)))])
    edges = df.sparkSession.createDataFrame([(0, [b[0] for b in blocks], blocks)], shape)
    here = F.struct(*key)
    below = lambda points: F.size(F.filter(points, lambda p: p < here))
    met = df.withColumn("_one", F.lit(0)).join(F.broadcast(edges), "_one").withColumn("_block", below("_heads"))
    inside = F.when(F.col("_block") == 0, 0).otherwise((F.col("_block") - 1) * width + below(F.get("_blocks", F.col("_block") - 1)))
    return met.withColumn("_bucket", inside).drop("_one", "_heads", "_blocks", "_block")


def running_before(df: DataFrame, value: str, counts: list[str], group: list[str] | None = None, order: list[str] | None = None, per_bucket: int = PER_BUCKET) -> DataFrame:
    """Adds <count>_before for each count: its sum over rows of the group with a lower value (equal values by `order`).

    Totals of buckets, at most MOST and one more per group, are broadcast; groups must be few.
    """
    group, order = group or [], order or []
    rows = bucketed(df, [*group, value, *order], per_bucket)
    keys = [*group, "_bucket"]
    ahead = (Window.partitionBy(*group) if group else Window).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*keys).agg(*[F.sum(c).alias(f"_{c}") for c in counts])
    totals = totals.select(*keys, *[F.coalesce(F.sum(f"_{c}").over(ahead), F.lit(0)).alias(f"_{c}") for c in counts])
    inside = Window.partitionBy(*keys).orderBy(value, *order).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.join(F.broadcast(totals), keys)
    for c in counts:
        out = out.withColumn(f"{c}_before", F.coalesce(F.sum(c).over(inside), F.lit(0)) + F.col(f"_{c}"))
    return out.drop("_bucket", *[f"_{c}" for c in counts])


def global_rank(df: DataFrame, value: str, order: list[str], per_bucket: int = PER_BUCKET) -> DataFrame:
    """Adds rank, from 0, by value and then `order`."""
    return running_before(df.withColumn("_n", F.lit(1)), value, ["_n"], order=order, per_bucket=per_bucket).withColumnRenamed("_n_before", "rank").drop("_n")


def slice_of(rank: Column, n: Column, k: int) -> Column:
    """Number, from 0, of the slice of a rank when n rows are cut into k slices, the first n mod k a row longer (as ntile)."""
    k_ = F.least(F.lit(k), n)
    base, extra = F.floor(n / k_), n % k_
    long = extra * (base + 1)
    return F.when(rank < long, F.floor(rank / (base + 1))).otherwise(extra + F.floor((rank - long) / base)).cast("int")


def quantile_cuts(df: DataFrame, value: str, k: int = 10) -> DataFrame:
    """cut: the distinct values at ranks ceil(b n / k), b from 1 to k - 1."""
    kept = df.select(F.lit(0).alias("g"), F.col(value).cast("double").alias("value")).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        found = cuts(kept, "g", "value", [k])
    finally:
        kept.unpersist()
    return df.sparkSession.createDataFrame([(x,) for each in found.values() for x in each[k]], "cut double")
