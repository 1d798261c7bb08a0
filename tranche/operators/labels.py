"""Monthly histories to default-within-horizon labels, and labels to cohorts by origination year.

A label has three states: true, false, and null where the loan left observation before the horizon with
nothing known (censored). Every aggregate is a minimum or maximum, so a loan's months shrink before they are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tranche.functions.scalars import bad_delinquency, delinquency_months, months_back
from tranche.sources.schemas import D90, D180, DEFAULT_CODES, PREPAY_CODES

HORIZON = 36


def faults(performance: DataFrame) -> DataFrame:
    """Rows that can't be labelled, with the reason."""
    reason = F.coalesce(F.when(F.col("loan_id").isNull(), "no loan_id"), F.when(F.col("loan_age").isNull(), "no loan_age"), F.when(bad_delinquency(F.col("dlq_status")), "unknown dlq_status"))
    return performance.withColumn("reason", reason).where("reason is not null")


#: The columns of a loan's state beside loan_id: minima and maxima, so states of parts of a history merge into that of all.
STATE = "first struct<loan_age int, period date>, last_age int, d90 int, d180 int, event int, prepay int, broken boolean"


def loan_states(performance: DataFrame, *keys: str | Column) -> DataFrame:
    """loan_id (and other keys) and STATE of monthly rows: first, the earliest month seen; last_age; the first ages at which
    the loan was D90, D180, ended badly and was prepaid; broken, whether there are rows that faults() names."""
    dlq, age = delinquency_months(F.col("dlq_status")), F.col("loan_age")
    return performance.groupBy("loan_id", *keys).agg(
        F.min(F.struct("loan_age", "period")).alias("first"), F.max("loan_age").alias("last_age"),
        F.min(F.when(dlq >= D90, age)).alias("d90"), F.min(F.when(dlq >= D180, age)).alias("d180"),
        F.min(F.when(F.col("zb_code").isin(*DEFAULT_CODES), age)).alias("event"), F.min(F.when(F.col("zb_code").isin(*PREPAY_CODES), age)).alias("prepay"),
        F.max(F.col("loan_id").isNull() | age.isNull() | bad_delinquency(F.col("dlq_status"))).alias("broken"),
    )


def merged(one: str, other: str) -> list[Column]:
    """STATE of two rows' states (structs, either may be null), as columns."""
    a, b = (lambda c: F.col(f"{one}.{c}")), (lambda c: F.col(f"{other}.{c}"))
    return [f(a(c), b(c)).alias(c) for c, f in (("first", F.least), ("last_age", F.greatest), ("d90", F.least), ("d180", F.least), ("event", F.least), ("prepay", F.least), ("broken", F.greatest))]


def labels_of(states: DataFrame, horizon: int = HORIZON) -> DataFrame:
    """The labels that label_loans() describes, of loans' states."""
    why = F.concat(F.lit("can't label loan "), F.coalesce("loan_id", F.lit("(none)")))
    checked = F.when(F.col("broken") | F.col("first.period").isNull(), F.raise_error(why)).otherwise(F.col("loan_id"))
    seen = F.greatest(F.lit(0), F.col("last_age"))

    def within(month: Column) -> Column:
        known = (seen >= horizon) | (F.col("prepay") <= horizon)
        return F.when(month <= horizon, True).when(known, False)

    orig = months_back(F.col("first.period"), F.col("first.loan_age"))
    bad = F.least("d90", "event")
    return states.select(
        checked.alias("loan_id"), F.year(orig).alias("vintage"), orig.alias("orig_date"), seen.alias("observed_months"),
        within(bad).alias("d90"), within(F.least("d180", "event")).alias("d180"),
        F.col("event").isNotNull().alias("defaulted"), bad.alias("default_month"), F.col("prepay").isNotNull().alias("prepaid"), F.col("prepay").alias("prepay_month"),
    )


def label_loans(performance: DataFrame, horizon: int = HORIZON) -> DataFrame:
    """loan_id, vintage, orig_date, observed_months, d90, d180, defaulted, default_month, prepaid, prepay_month.

    performance: loan_id, period, loan_age, dlq_status, zb_code; any order, repeats don't matter. The job fails on rows
    that faults() names and on a loan whose earliest month has no period.
    """
    return labels_of(loan_states(performance), horizon)


def cohorts(labels: DataFrame) -> DataFrame:
    """One row per vintage: loans, events, censored loans, and the D90 rate of loans whose outcome is known."""
    n, known = F.count(F.lit(1)), F.count("d90")
    return labels.groupBy("vintage").agg(
        n.alias("n_loans"), F.count_if("d90").alias("n_d90"), F.count_if("d180").alias("n_d180"), F.count_if("prepaid").alias("n_prepaid"),
        (n - known).alias("n_censored"), known.alias("n_determinable"), (F.count_if("d90") / F.nullif(known, F.lit(0))).alias("d90_rate"),
    ).orderBy("vintage")
