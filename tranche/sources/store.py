"""Writing and reading datasets, models and reports."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tranche.jobs.ingest import Dataset
from tranche.jobs.models import Boosted, Logistic

from .versions import Version, current, publish


@dataclass
class Saved:
    """A whole version of a dataset."""

    matrix: DataFrame
    stats: DataFrame
    missing: DataFrame
    horizon_months: int
    models: dict[str, Logistic | Boosted]


def save_dataset(data: Dataset, path: str, horizon_months: int, models: dict[str, Logistic | Boosted] | None = None) -> Version:
    """Matrix partitioned by vintage, with the fields for grouping that it carries; accounting, missing fields and models beside
    it; horizon and kinds of models in the manifest. All become visible at once, as a new version. Rebalancing gives a large
    vintage several tasks and files of the advisory size, and small ones few."""
    models = models or {}
    spark = data.matrix.sparkSession

    def write(folder: str) -> None:
        data.matrix.hint("rebalance", "vintage").write.partitionBy("vintage").parquet(f"{folder}/matrix")
        data.stats.write.parquet(f"{folder}/stats")
        data.missing.write.parquet(f"{folder}/missing")
        for name, model in models.items():
            (save_logistic if isinstance(model, Logistic) else save_boosted)(spark, model, f"{folder}/models/{name}")

    kinds = {name: "logistic" if isinstance(m, Logistic) else "boosted" for name, m in models.items()}
    return publish(spark, path, write, {"horizon_months": horizon_months, "models": kinds})


def load_dataset(spark: SparkSession, path: str) -> Saved:
    version = current(spark, path)
    if version is None:
        raise FileNotFoundError(f"no whole dataset in {path}")
    read = lambda part: spark.read.parquet(f"{version.folder}/{part}")
    models = {name: (load_logistic if kind == "logistic" else load_boosted)(spark, f"{version.folder}/models/{name}") for name, kind in version.about["models"].items()}
    return Saved(read("matrix"), read("stats"), read("missing"), version.about["horizon_months"], models)


def save_logistic(spark: SparkSession, model: Logistic, path: str) -> None:
    rows = [(i, f, m, s, c) for i, (f, m, s, c) in enumerate(zip(model.features, model.means, model.stds, model.coefs, strict=True))]
    spark.createDataFrame([("logistic", json.dumps({"intercept": model.intercept, "rows": rows}))], "kind string, body string").coalesce(1).write.mode("overwrite").json(path)


def load_logistic(spark: SparkSession, path: str) -> Logistic:
    row = spark.read.schema("kind string, body string").json(path).first()
    if row is None or row["kind"] != "logistic":
        raise ValueError(f"no logistic model in {path}: {row and row['kind']}")
    body = json.loads(row["body"])
    _, features, means, stds, coefs = zip(*sorted(body["rows"]), strict=True)
    return Logistic(list(features), list(means), list(stds), list(coefs), body["intercept"])


def save_boosted(spark: SparkSession, model: Boosted, path: str) -> None:
    """The trees as Spark ML writes them; features and rounds beside them."""
    model.model.write().overwrite().save(f"{path}/trees")
    body = json.dumps({"features": model.features, "rounds": model.rounds})
    spark.createDataFrame([("boosted", body)], "kind string, body string").coalesce(1).write.mode("overwrite").json(f"{path}/about")


def load_boosted(spark: SparkSession, path: str) -> Boosted:
    from pyspark.errors import AnalysisException
    from pyspark.ml.classification import GBTClassificationModel

    try:
        row = spark.read.schema("kind string, body string").json(f"{path}/about").first()
    except AnalysisException as e:
        raise ValueError(f"no boosted model in {path}") from e
    if row is None or row["kind"] != "boosted":
        raise ValueError(f"no boosted model in {path}: {row and row['kind']}")
    body = json.loads(row["body"])
    return Boosted(body["features"], GBTClassificationModel.load(f"{path}/trees"), body["rounds"])


def save_report(report: DataFrame, path: str) -> None:
    """A long metric table as JSON lines."""
    report.coalesce(1).write.mode("overwrite").json(path)
