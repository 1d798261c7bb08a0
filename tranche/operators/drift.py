"""Population stability: how a population falls into quantile bins of another, for many features at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .radix import cuts
from .ranks import settled

FLOOR = 1e-4  # least share of a bin
BINS = 10


def long_rows(rows: DataFrame, features: list[str], by: list[str]) -> DataFrame:
    """by..., feature, value, n (1): a row for each feature of each row."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"`{f}`").cast("double").alias("value")) for f in features]))
    return rows.select(*by, pairs.alias("_p")).select(*by, "_p.*", F.lit(1).alias("n"))


def long_counts(rows: DataFrame, features: list[str], by: list[str]) -> DataFrame:
    """feature, by..., value, n: the same with equal values counted, where these are few."""
    return long_rows(rows, features, by).groupBy("feature", *by, "value").agg(F.sum("n").alias("n"))


def bin_of(value: Column, cuts: Column, most: int) -> Column:
    """Number of edges below the value, of `most` at most; 0 for null. Written out, so that it compiles with its stage."""
    return sum((F.coalesce((F.get(cuts, F.lit(i)) < value).cast("int"), F.lit(0)) for i in range(most)), F.lit(0))


def term(e: Column, a: Column) -> Column:
    e, a = F.greatest(e, F.lit(FLOOR)), F.greatest(a, F.lit(FLOOR))
    return (a - e) * F.ln(a / e)


def _cut_table(rows: DataFrame, ks: list[int]) -> DataFrame:
    """feature, k, cuts: k - 1 values at most, so few rows of bounded size."""
    found = cuts(rows, "feature", "value", ks, "n")
    return rows.sparkSession.createDataFrame([(f, k, c) for f, by_k in found.items() for k, c in by_k.items()], "feature string, k int, cuts array<double>")


def _psi(rows: DataFrame, k: int) -> DataFrame:
    """rows: feature, is_test, value, n, kept by the caller. They are read once for the bins, and before that once for each look
    at the bits of the edges; what is shuffled are counts by leading bits and by bin."""
    edges = _cut_table(rows.where("not is_test"), [k])
    binned = rows.join(F.broadcast(edges), "feature", "left").withColumn("bin", F.coalesce(bin_of(F.col("value"), F.col("cuts"), k - 1), F.lit(0)))
    n = lambda test: F.sum(F.when(F.col("is_test") == test, F.col("n")).otherwise(0))
    bins = binned.groupBy("feature", "bin").agg(n(False).alias("e"), n(True).alias("a"))
    totals = bins.groupBy("feature").agg(F.sum("e").alias("_e"), F.sum("a").alias("_a"))
    return bins.join(F.broadcast(totals), "feature").groupBy("feature").agg(F.sum(term(F.col("e") / F.col("_e"), F.col("a") / F.col("_a"))).alias("psi"))


def psi(counts: DataFrame, k: int = BINS) -> DataFrame:
    """counts: feature, is_test, value, n. feature, psi of the test side in bins of the other.

    A bin empty on both sides adds nothing, so bins that have rows suffice.
    """
    return settled(counts, lambda kept: _psi(kept, k))


def feature_psi(split: DataFrame, features: list[str], k: int = BINS) -> DataFrame:
    """split: matrix columns and is_test. position keeps the order of the features."""
    order = F.create_map(*[x for i, f in enumerate(features) for x in (F.lit(f), F.lit(i))])
    wide = split.select("is_test", *[F.col(f"`{f}`") for f in features])
    return settled(wide, lambda kept: _psi(long_rows(kept, features, ["is_test"]), k)).withColumn("position", order[F.col("feature")])


def top_drifted(drift: DataFrame, n: int = 5) -> DataFrame:
    return drift.orderBy(F.desc("psi"), "position").limit(n)


def cells(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """rows: feature, grp, value, n; edges: feature, k, cuts. feature, grp, cell, edge, n: one pass sorts each value among
    the edges of all k at once; edge: the greatest below it. Cells are as many as there are edges, and one.

    The cell is searched for by halves, a small step a column: compared with every edge in one expression, a stage's method grew
    past what the JVM compiles.
    """
    every = edges.groupBy("feature").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("cuts")))).alias("_edges"))
    placed = rows.join(F.broadcast(every), "feature").withColumn("cell", F.lit(0))
    for width in (1 << i for i in reversed(range((BINS * (BINS - 1) // 2).bit_length()))):
        below = F.get("_edges", F.col("cell") + (width - 1)) < F.col("value")
        placed = placed.withColumn("cell", F.col("cell") + F.when(below, width).otherwise(0))
    counted = placed.groupBy("feature", "grp", "cell").agg(F.sum("n").alias("n"))
    return counted.join(F.broadcast(every), "feature").withColumn("edge", F.get("_edges", F.col("cell") - 1)).drop("_edges")


def group_edges(rows: DataFrame) -> DataFrame:
    """feature, k, cuts for every k from 2 to BINS. rows: feature, value, n, kept by the caller."""
    return _cut_table(rows, list(range(2, BINS + 1)))


def group_psi(celled: DataFrame, edges: DataFrame, ks: DataFrame) -> DataFrame:
    """celled: what cells() returns, kept by the caller, since it is read four times. edges: of group_edges(). ks: grp, k (2 to
    BINS). feature, grp, psi of each group against all rows. Cells are at most 46 for each feature and group."""
    binned = lambda df, *by: df.withColumn("bin", F.size(F.filter("cuts", lambda e: e <= F.col("edge")))).groupBy("feature", *by, "bin").agg(F.sum("n").alias("n"))
    everyone = celled.groupBy("feature", "cell").agg(F.first("edge").alias("edge"), F.sum("n").alias("n"))
    expected = binned(everyone.join(F.broadcast(edges), "feature"), "k")
    actual = binned(celled.join(ks, "grp").join(F.broadcast(edges), ["feature", "k"]), "grp")
    e_all = expected.groupBy("feature", "k").agg(F.sum("n").alias("_e"))
    a_all = actual.groupBy("feature", "grp").agg(F.sum("n").alias("_a"))
    both = ks.join(expected, "k").join(e_all, ["feature", "k"]).join(a_all, ["feature", "grp"]).withColumnRenamed("n", "e")
    both = both.join(actual.withColumnRenamed("n", "a"), ["feature", "grp", "bin"], "left")
    return both.groupBy("feature", "grp").agg(F.sum(term(F.col("e") / F.col("_e"), F.coalesce("a", F.lit(0)) / F.col("_a"))).alias("psi"))
