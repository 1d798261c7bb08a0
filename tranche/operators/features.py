"""Origination features, their audit, the design matrix and the accounting of loans that don't get into it."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tranche.functions.scalars import flag
from tranche.sources.schemas import ACQUISITION

# Yearly averages of the 30-year fixed mortgage rate, in percent.
BENCHMARK = {
    1999: 7.44, 2000: 8.05, 2001: 6.97, 2002: 6.54, 2003: 5.83, 2004: 5.84, 2005: 5.87, 2006: 6.41, 2007: 6.34,
    2008: 6.03, 2009: 5.04, 2010: 4.69, 2011: 4.45, 2012: 3.66, 2013: 3.98, 2014: 4.17, 2015: 3.85, 2016: 3.65,
    2017: 3.99, 2018: 4.54, 2019: 3.94, 2020: 3.10, 2021: 2.96, 2022: 5.34, 2023: 6.81, 2024: 6.70,
}
UNKNOWN = "UNK"


class Leak(ValueError):
    """A feature reads what wasn't known at origination."""


def benchmark_rate(year: Column, table: Mapping[int, float] = BENCHMARK) -> Column:
    """Rate of the nearest year in the table, of two equally near ones the first in it; one look into an array a row."""
    first, last = min(table), max(table)
    rates = [table[min(table, key=lambda t: abs(t - y))] for y in range(first, last + 1)]
    at = F.least(F.greatest(year, F.lit(first)), F.lit(last)) - first + 1
    return F.element_at(F.array(*[F.lit(float(r)) for r in rates]), at.cast("int"))


@dataclass(frozen=True)
class Feature:
    name: str
    sources: tuple[str, ...]
    make: Callable[[], Column]
    required: bool = False
    vocab: tuple[str, ...] = ()


def spec(benchmark: Mapping[int, float] = BENCHMARK) -> list[Feature]:
    c = F.col
    plain = lambda n: Feature(n, (n,), lambda: c(n).cast("double"), required=True)
    return [
        plain("fico"), plain("oltv"), plain("dti"), plain("orig_rate"),
        Feature("log_upb", ("orig_upb",), lambda: F.when(c("orig_upb") > 0, F.log("orig_upb")), required=True),
        Feature("ocltv", ("ocltv", "oltv"), lambda: F.coalesce("ocltv", "oltv")),
        Feature("rate_spread", ("orig_rate", "orig_date"), lambda: c("orig_rate") - benchmark_rate(F.year("orig_date"), benchmark)),
        Feature("mi_pct", ("mi_pct",), lambda: c("mi_pct")),
        Feature("num_borrowers", ("num_borrowers",), lambda: F.coalesce(F.nullif(c("num_borrowers"), F.lit(0)), F.lit(1)).cast("double")),
        Feature("has_coborrower", ("co_fico",), lambda: F.when(c("co_fico") != 0, 1.0).otherwise(0.0)),
        Feature("first_time_buyer", ("first_time_buyer",), lambda: flag(c("first_time_buyer"))),
        Feature("purpose", ("purpose",), lambda: c("purpose"), vocab=("P", "C", "R", "U")),
        Feature("occupancy", ("occupancy",), lambda: c("occupancy"), vocab=("P", "S", "I")),
        Feature("property_type", ("property_type",), lambda: c("property_type"), vocab=("SF", "CO", "PU", "MH", "CP")),
        Feature("channel", ("channel",), lambda: c("channel"), vocab=("R", "C", "B")),
    ]


def audit(features: list[Feature], known: set[str] | None = None) -> None:
    """Raises Leak unless every feature names sources and all are origination fields."""
    known = known or {name for name, _ in ACQUISITION}
    for f in features:
        if not f.sources or not set(f.sources) <= known:
            raise Leak(f"{f.name}: {sorted(set(f.sources) - known) or 'no sources'}")


def columns(features: list[Feature] | None = None) -> list[str]:
    """The design matrix's columns: numbers in order, then a column per category and one for all others."""
    features = features or spec()
    return [f.name for f in features if not f.vocab] + [f"{f.name}={v}" for f in features if f.vocab for v in (*f.vocab, UNKNOWN)]


def joined(acquisitions: DataFrame, labels: DataFrame, features: list[Feature] | None = None, target: str = "d90", keep: tuple[str, ...] = ("state",)) -> DataFrame:
    """Full outer join of acquisitions and labels on loan_id, with features and `fate`:
    no_label, no_acquisition, censored, missing (see missing_field: the first required one) or row.

    Extra columns named in `keep` ride along, so no second join is needed for grouping.
    """
    if target not in ("d90", "d180"):
        raise ValueError(f"unknown target {target!r}")
    features = features or spec()
    audit(features)
    made = []
    for f in features:
        v = f.make()
        made.append((F.when(v.isin(*f.vocab), v).otherwise(UNKNOWN) if f.vocab else v if f.required else F.coalesce(v, F.lit(0.0))).alias(f.name))
    left = acquisitions.select("loan_id", *made, *[k for k in keep if k in acquisitions.columns], F.lit(True).alias("_acq"))
    right = labels.select("loan_id", "vintage", F.col(target).alias("y"), F.lit(True).alias("_lab"))
    missing = F.coalesce(*[F.when(F.col(f.name).isNull(), F.lit(f.name)) for f in features if f.required])
    fate = (
        F.when(F.col("_lab").isNull(), "no_label").when(F.col("_acq").isNull(), "no_acquisition").when(F.col("y").isNull(), "censored")
        .when(missing.isNotNull(), "missing").otherwise("row")
    )
    out = left.join(right, "loan_id", "full_outer").withColumn("fate", fate)
    return out.withColumn("missing_field", F.when(F.col("fate") == "missing", missing)).drop("_acq", "_lab")


def feature_rows(all_loans: DataFrame) -> DataFrame:
    return all_loans.where("fate = 'row'").drop("fate", "missing_field")


def accounting(all_loans: DataFrame) -> DataFrame:
    """One row of counts over what joined() returns; labels without acquisition count by loan, the rest by row."""
    n = lambda *fates: F.count_if(F.col("fate").isin(*fates))
    used = ("censored", "missing", "row")
    return all_loans.agg(
        n("no_label", *used).alias("n_acquisitions"), n(*used).alias("n_joined"), n("row").alias("n_rows"), n("censored").alias("n_censored_excluded"),
        n("missing").alias("n_missing_required"), n("no_acquisition").alias("n_label_without_acq"), n("no_label").alias("n_acq_without_label"),
        F.count_distinct(F.when(F.col("fate") != "no_label", F.col("loan_id"))).alias("n_labels"),
    )


def missing_by_field(all_loans: DataFrame) -> DataFrame:
    return all_loans.where("missing_field is not null").groupBy("missing_field").agg(F.count(F.lit(1)).alias("n"))


def matrix(rows: DataFrame, features: list[Feature] | None = None, keep: tuple[str, ...] = ("state",)) -> DataFrame:
    """loan_id, vintage, y (0 or 1), the columns of columns(), and `keep`."""
    features = features or spec()
    numbers = [F.col(f.name).cast("double").alias(f.name) for f in features if not f.vocab]
    hot = [(F.col(f.name) == v).cast("double").alias(f"{f.name}={v}") for f in features if f.vocab for v in (*f.vocab, UNKNOWN)]
    return rows.select("loan_id", "vintage", F.col("y").cast("int").alias("y"), *numbers, *hot, *[k for k in keep if k in rows.columns])


def attach_groups(rows: DataFrame, acquisitions: DataFrame, field: str = "state", order: str | None = None) -> DataFrame:
    """Adds `grp` (replaces one there is), the loan's value of a field; UNKNOWN if null or absent.

    Of repeated loans the last in `order` counts, null or not; without it, what parsed() says of their places. Where there is
    neither, rows have no order, and the greatest value counts. Each loan is one group of rows; these fold before the shuffle.
    """
    order = order or ("place" if "place" in acquisitions.columns else None)
    value = F.col(field).cast("string")
    last = F.max(F.struct(F.col(order).alias("at"), value.alias("grp")))["grp"] if order else F.max(value)
    known = acquisitions.groupBy("loan_id").agg(last.alias("grp"))
    return rows.drop("grp").join(known, "loan_id", "left").withColumn("grp", F.coalesce("grp", F.lit("UNKNOWN")))
