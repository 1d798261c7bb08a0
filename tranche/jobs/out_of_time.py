"""Out-of-time validation: the same trainer judged on later vintages and, naively, on random rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tranche.operators.drift import feature_psi
from tranche.operators.metrics import SCORE_DIGITS, full_evaluation, united
from tranche.operators.splits import at_random, by_vintage

from .models import fit_logistic

HEADLINE = ("n", "realised", "mean_predicted", "ratio", "auc", "brier", "skill")
#: Gets rows and feature names, returns anything with score(rows) that adds pd.
Trainer = Callable[[DataFrame, list[str]], object]


@dataclass
class Report:
    metrics: DataFrame  # protocol (in_sample, oot, naive), metric, value
    curves: DataFrame  # protocol, part (reliability, decile), bin, metric, value
    score_psi: DataFrame
    feature_psi: DataFrame


def validate(matrix: DataFrame, features: list[str], last_train: int = 2006, trainer: Trainer = fit_logistic, share: float = 0.25, seed: int = 7) -> Report:
    late = by_vintage(matrix, last_train)
    naive = at_random(matrix, share, seed)
    model = trainer(late.where("not is_test"), features)
    other = trainer(naive.where("not is_test"), features)
    scored = model.score(late)
    full = united({"in_sample": full_evaluation(scored.where("not is_test")), "oot": full_evaluation(scored.where("is_test")), "naive": full_evaluation(other.score(naive.where("is_test")))})
    rounded = scored.select("is_test", F.round("pd", SCORE_DIGITS).alias("pd"))
    overall = F.col("part") == "overall"
    return Report(full.where(overall).drop("part", "bin"), full.where(~overall), feature_psi(rounded, ["pd"]).drop("position"), feature_psi(late, features))


def headline(metrics: DataFrame) -> DataFrame:
    """metric, naive, oot: the seven figures side by side."""
    order = F.create_map(*[x for i, m in enumerate(HEADLINE) for x in (F.lit(m), F.lit(i))])
    rows = metrics.where(F.col("protocol").isin("naive", "oot") & F.col("metric").isin(*HEADLINE)).groupBy("metric").pivot("protocol", ["naive", "oot"]).agg(F.first("value"))
    return rows.withColumn("position", order[F.col("metric")]).orderBy("position")
