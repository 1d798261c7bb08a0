"""Why a loan's risk is what it is: exact contributions and reason codes, all within the row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tranche.jobs.models import Logistic

PHRASES = {
    "fico": "Low credit score", "oltv": "High share of the property value borrowed", "ocltv": "High combined borrowing against the property",
    "dti": "High debt payments against income", "orig_rate": "High interest rate", "rate_spread": "Interest rate far above the market's",
    "log_upb": "Unusual loan size", "mi_pct": "Extent of mortgage insurance", "num_borrowers": "How many borrow together",
    "has_coborrower": "Whether somebody borrows along", "first_time_buyer": "Whether this is a first home",
}


def phrase(feature: str) -> str:
    name, _, value = feature.partition("=")
    return PHRASES.get(feature) or (f"{name} equals {value}" if value else f"Value of {feature}")


def contribution_array(model: Logistic) -> Column:
    parts = zip(model.features, model.parts(), strict=True)
    return F.array(*[F.struct(F.lit(i).alias("position"), F.lit(f).alias("feature"), c.alias("contribution"), F.col(f"`{f}`").cast("double").alias("value"), F.lit(phrase(f)).alias("phrase")) for i, (f, c) in enumerate(parts)])


def contributions(model: Logistic, matrix: DataFrame) -> DataFrame:
    """loan_id, position, feature, contribution: with the intercept a loan's contributions add up to its log-odds."""
    return matrix.select("loan_id", F.explode(contribution_array(model)).alias("c")).select("loan_id", "c.position", "c.feature", "c.contribution")


def explained(model: Logistic, matrix: DataFrame, top: int = 4) -> DataFrame:
    """loan_id, pd, log_odds, intercept, reasons: up to `top` contributions above 0, largest first, ties in feature order."""
    raising = F.filter(contribution_array(model), lambda c: c["contribution"] > 0)
    keyed = F.transform(raising, lambda c: F.struct((-c["contribution"]).alias("_k"), c["position"].alias("position"), c["feature"].alias("feature"), c["contribution"].alias("contribution"), c["value"].alias("value"), c["phrase"].alias("phrase")))
    reasons = F.transform(F.slice(F.array_sort(keyed), 1, top), lambda c: F.struct(c["feature"].alias("feature"), c["contribution"].alias("contribution"), c["value"].alias("value"), c["phrase"].alias("phrase")))
    return model.score(matrix).select("loan_id", "pd", model.log_odds().alias("log_odds"), F.lit(model.intercept).alias("intercept"), reasons.alias("reasons"))


def reason_rows(explanations: DataFrame) -> DataFrame:
    # the outer form: the plain one also becomes a filter that repeats the whole expression
    rows = explanations.select("loan_id", F.posexplode_outer("reasons").alias("rank", "r")).where("r is not null")
    return rows.select("loan_id", (F.col("rank") + 1).alias("rank"), "r.*")


def explain_one(model: Logistic, matrix: DataFrame, loan_id: str, top: int = 4) -> DataFrame:
    found = explained(model, matrix.where(F.col("loan_id") == loan_id), top)
    if found.isEmpty():
        raise KeyError(loan_id)
    return found
