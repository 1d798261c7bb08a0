"""Auditing scored loans across an attribute that is not a feature (column grp)."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .drift import BINS, cells, group_edges, group_psi, long_rows
from .ranks import fetched, settled

POOL, LEAST, FLAG, LOOKED_AT = "OTHER", 30, 0.25, 5


def pooled(rows: DataFrame, least: int = LEAST) -> DataFrame:
    """Groups of fewer than `least` rows become OTHER. One row per group is counted and joined back."""
    sizes = rows.groupBy("grp").agg(F.count(F.lit(1)).alias("_n"))
    return rows.join(sizes, "grp").withColumn("grp", F.when(F.col("_n") >= least, F.col("grp")).otherwise(POOL)).drop("_n")


def parity(scored: DataFrame) -> DataFrame:
    """grp, n, mean_predicted, realised, gap (above 0: priced riskier than it turned out), largest gap first."""
    rows = scored.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.avg("pd").alias("mean_predicted"), F.avg("y").alias("realised"))
    return rows.withColumn("gap", F.col("mean_predicted") - F.col("realised")).orderBy(F.desc("gap"), "grp")


def worst(parity_rows: DataFrame) -> DataFrame:
    return parity_rows.agg(F.max_by("grp", "gap").alias("grp"), F.max("gap").alias("gap"))


def proxy_power(rows: DataFrame, features: list[str], least: int = LEAST) -> DataFrame:
    """feature, position, power: the most that the feature is distributed otherwise in a group than in all rows (PSI).

    Small groups get fewer bins, so that noise doesn't read as drift.
    """
    return settled(rows.select("grp", *[F.col(f"`{f}`") for f in features]), lambda wide: _power(wide, features, least))


def _power(wide: DataFrame, features: list[str], least: int) -> DataFrame:
    """What proxy_power() returns; wide: grp and the features, kept by the caller."""
    sizes = wide.where(F.col("grp") != POOL).groupBy("grp").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least)
    ks = sizes.select("grp", F.least(F.lit(BINS), F.greatest(F.lit(2), F.floor(F.col("_n") / 20))).cast("int").alias("k"))
    values = long_rows(wide, features, ["grp"])
    edges = group_edges(values)
    power = settled(cells(values, edges), lambda celled: group_psi(celled, edges, ks).groupBy("feature").agg(F.max("psi").alias("_power")))
    names = wide.sparkSession.createDataFrame(list(enumerate(features)), "position int, feature string")
    return names.join(power, "feature", "left").select("feature", "position", F.greatest(F.lit(0.0), F.coalesce("_power", F.lit(0.0))).alias("power"))


def proxy_flags(power: DataFrame, looked_at: int = LOOKED_AT, flag: float = FLAG) -> DataFrame:
    """Of the strongest features those that reach the flag."""
    return power.orderBy(F.desc("power"), "position").limit(looked_at).where(F.col("power") >= flag)


def audit(scored: DataFrame, features: list[str], least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(parity by group, proxy power) of any scored rows that have grp, y, pd and the features, which are read once for both and
    kept meanwhile."""
    rows = pooled(scored.select("grp", "y", "pd", *[F.col(f"`{f}`") for f in features]), least).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return fetched(parity(rows)), fetched(_power(rows, features, least))
    finally:
        rows.unpersist()
