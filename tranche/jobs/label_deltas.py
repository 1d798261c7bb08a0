"""Labels kept up to date from monthly files, without reading history again.

The state of each loan (minima and maxima, one row) is kept in files bucketed by loan_id. A delta's rows become states of their
own, which are shuffled once to the same buckets and merged with a full outer join; the kept states are read where they lie
and written as the next version. Merging is idempotent, and in any order gives what all months at once give.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tranche.operators.labels import HORIZON, STATE, labels_of, loan_states, merged
from tranche.sources.versions import Version, current, publish

#: Buckets of a new state; a few hundred MB each at the size expected.
BUCKETS = 64
COLUMNS = [c.split()[0] for c in ("first", "last_age", "d90", "d180", "event", "prepay", "broken")]


def _table(spark: SparkSession, folder: str) -> str:
    return "label_state_" + hashlib.md5(folder.encode()).hexdigest()


def states(spark: SparkSession, version: Version) -> DataFrame:
    """The kept states, known to Spark as bucketed by loan_id."""
    name = _table(spark, version.folder)
    if not spark.catalog.tableExists(name):
        spark.sql(f"create table {name} (loan_id string, {STATE}) using parquet clustered by (loan_id) sorted by (loan_id) into {version.about['buckets']} buckets location '{version.folder}'")
    return spark.table(name)


def apply_delta(spark: SparkSession, path: str, months: DataFrame, name: str, buckets: int = BUCKETS) -> Version:
    """Merges monthly rows into the state at path; buckets counts when there is none yet. name: of the delta, kept in the
    version's list. A delta of that name that is in it already isn't merged again."""
    before = current(spark, path)
    about = before.about if before else {"buckets": buckets, "deltas": []}
    if before and name in about["deltas"]:
        return before
    dealt = months.select("loan_id", "period", "loan_age", "dlq_status", "zb_code").repartition(about["buckets"], "loan_id")
    new = loan_states(dealt)
    if before:
        packed = lambda df, c: df.select("loan_id", F.struct(*COLUMNS).alias(c))
        # rows without a loan_id meet nothing; they are faulty, and asking for labels fails on them
        new = packed(states(spark, before), "old").join(packed(new, "new"), "loan_id", "full_outer").select("loan_id", *merged("old", "new"))

    def write(folder: str) -> None:
        new.write.bucketBy(about["buckets"], "loan_id").sortBy("loan_id").option("path", folder).saveAsTable(_table(spark, folder))

    return publish(spark, path, write, {"buckets": about["buckets"], "deltas": [*about["deltas"], name]}, before)


def current_labels(spark: SparkSession, path: str, horizon: int = HORIZON) -> DataFrame:
    """Labels of all loans met so far, as label_loans() gives them over all deltas at once."""
    version = current(spark, path)
    if version is None:
        raise FileNotFoundError(path)
    return labels_of(states(spark, version), horizon)
