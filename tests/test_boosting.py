"""Rounds of the boosted challenger."""

from __future__ import annotations

import inspect

from pyspark.sql import functions as F

from tranche.jobs import models, queries
from tranche.operators.splits import at_random

from .conftest import DATA


def test_queries_fit_all_rounds(spark, monkeypatch):
    given = {k: p.default for k, p in inspect.signature(models.fit_boosted).parameters.items()}
    assert (given["rounds"], given["patience"], given["rate"]) == (500, 20, 0.05)
    asked = []

    def note(df, features, **settings):
        asked.append(settings)
        return models.Boosted(features, None, 0)

    monkeypatch.setattr(models, "fit_boosted", note)
    monkeypatch.setattr(models.Boosted, "importances", lambda self: [(f, 0.0) for f in self.features])
    monkeypatch.setattr(models.Boosted, "score", lambda self, df: df.withColumn("pd", F.lit(0.5)))
    monkeypatch.setattr(models, "fit_logistic", lambda df, features: queries.FIXED)
    assert queries.gbt_importance(spark, DATA).count() == len(queries.COLUMNS) and queries.model_comparison(spark, DATA).count() == 8
    assert asked == [{}, {}]


def test_doubling_search_keeps_what_all_rounds_keep(spark):
    from pyspark.ml.classification import GBTClassifier

    names, rounds = ["fico", "oltv", "dti"], 12
    m = queries.matrix(spark, DATA).select("loan_id", "y", *names).cache()
    data = models.vectors(at_random(m, 0.15, 7).withColumnRenamed("is_test", "held"), [F.col(f).cast("double") for f in names]).cache()
    whole = GBTClassifier(maxIter=rounds, stepSize=0.05, maxDepth=4, minInstancesPerNode=20, seed=7).fit(data.where("not held"))
    want = models.patient(whole.evaluateEachIteration(data.where("held")), 1)
    got = models.fit_boosted(m, names, rounds=rounds, patience=1)
    assert got.rounds == want and got.model.getNumTrees == want
    assert [t.toDebugString.split("\n", 1)[1] for t in got.model.trees] == [t.toDebugString.split("\n", 1)[1] for t in whole.trees[:want]]
