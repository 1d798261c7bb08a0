"""Probability-of-default models: a penalised logistic regression and a boosted challenger."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tranche.functions.scalars import logistic, seeded
from tranche.operators.splits import at_random
from tranche.sources.versions import workspace


def _col(name: str) -> Column:
    return F.col(f"`{name}`")


def _needs(df: DataFrame, features: list[str]) -> None:
    if lacking := [f for f in features if f not in df.columns]:
        raise ValueError(f"columns lacking: {lacking}")


@dataclass
class Logistic:
    features: list[str]
    means: list[float]
    stds: list[float]
    coefs: list[float]
    intercept: float

    def parts(self) -> list[Column]:
        """Contribution of each feature to the log-odds."""
        return [(_col(f) - m) / s * c for f, m, s, c in zip(self.features, self.means, self.stds, self.coefs, strict=True)]

    def log_odds(self) -> Column:
        return reduce(lambda a, b: a + b, self.parts(), F.lit(self.intercept))

    def score(self, df: DataFrame) -> DataFrame:
        """Adds pd; one generated expression, no Python in the tasks."""
        _needs(df, self.features)
        return df.withColumn("pd", logistic(self.log_odds()))


def _checked(df: DataFrame) -> int:
    n, classes = df.agg(F.count(F.lit(1)), F.count_distinct("y")).first()
    if not n or classes < 2:
        raise ValueError(f"training needs rows of both classes; {n} rows, {classes} classes")
    return n


def vectors(df: DataFrame, columns: list[Column]) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return df.select(array_to_vector(F.array(*columns)).alias("features"), F.col("y").cast("double").alias("label"), *[c for c in ("loan_id", "held") if c in df.columns])


def moments(df: DataFrame, features: list[str]) -> tuple[list[float], list[float]]:
    """Means and standard deviations of the features, 1 for one that doesn't vary."""
    row = df.agg(*[f(_col(x)).alias(f"{k}{i}") for i, x in enumerate(features) for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    return [row[f"m{i}"] for i in range(len(features))], [row[f"s{i}"] or 1.0 for i in range(len(features))]


def fit_logistic(df: DataFrame, features: list[str], c: float = 1.0, iterations: int = 1000) -> Logistic:
    """Minimises c * sum of log loss + |w|^2 / 2 over standardised features, intercept free."""
    from pyspark.ml.classification import LogisticRegression

    _needs(df, features)
    n = _checked(df)
    means, stds = moments(df, features)
    data = vectors(df, [(_col(f) - m) / s for f, m, s in zip(features, means, stds, strict=True)]).cache()
    try:
        fit = LogisticRegression(regParam=1 / (c * n), elasticNetParam=0, standardization=False, maxIter=iterations, tol=1e-9).fit(data)
    finally:
        data.unpersist()
    return Logistic(features, means, stds, [float(x) for x in fit.coefficients], float(fit.intercept))


def gradient(model: Logistic, df: DataFrame, c: float = 1.0) -> DataFrame:
    """parameter, gradient: of the loss that fit_logistic() minimises, divided by c and the rows; all zero where it is least.
    One aggregate over the rows, whatever fitted the model."""
    _needs(df, model.features)
    wrong = F.col("pd") - F.col("y")
    scaled = [(_col(f) - m) / s for f, m, s in zip(model.features, model.means, model.stds, strict=True)]
    row = model.score(df).agg(F.count(F.lit(1)), F.avg(wrong), *[F.avg(wrong * x) for x in scaled]).first()
    parts = [("(intercept)", row[1]), *((f, g + w / (c * row[0])) for f, g, w in zip(model.features, row[2:], model.coefs, strict=True))]
    return df.sparkSession.createDataFrame(parts, "parameter string, gradient double")


@dataclass
class Boosted:
    """A boosted model that scores like Logistic does."""

    features: list[str]
    model: object
    rounds: int

    def score(self, df: DataFrame) -> DataFrame:
        from pyspark.ml.functions import array_to_vector, vector_to_array

        _needs(df, self.features)
        ready = df.withColumn("features", array_to_vector(F.array(*[_col(f).cast("double") for f in self.features])))
        out = self.model.transform(ready)
        return out.withColumn("pd", vector_to_array("probability")[1]).select(*df.columns, "pd")

    def importances(self) -> list[tuple[str, float]]:
        """Shares of the gain, adding up to 1; all zero if there is none."""
        raw = [float(x) for x in self.model.featureImportances.toArray()]
        total = sum(raw)
        return [(f, x / total if total > 0 else 0.0) for f, x in zip(self.features, raw, strict=True)]


def patient(losses: list[float], patience: int) -> int:
    """Rounds to keep: those of the least loss, unless `patience` rounds without a better one end the search before."""
    best = 0
    for i, x in enumerate(losses):
        if x < losses[best]:
            best = i
        elif i - best >= patience:
            break
    return best + 1


#: Rounds after which the margins are written, which ends their lineage.
CUT = 10


def _ensemble(spark: SparkSession, trees: list, rate: float, features: int):
    """A Spark ML model of regression trees; the first counts whole, the others at the rate."""
    from pyspark.ml.classification import GBTClassificationModel

    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    kind = jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel
    held, weights = gateway.new_array(kind, len(trees)), gateway.new_array(jvm.double, len(trees))
    for i, tree in enumerate(trees):
        held[i], weights[i] = tree._java_obj, rate if i else 1.0
    uid = jvm.org.apache.spark.ml.util.Identifiable.randomUID("GBTClassifier")
    return GBTClassificationModel(jvm.org.apache.spark.ml.classification.GBTClassificationModel(uid, held, weights, features, 2))


def fit_boosted(df: DataFrame, features: list[str], rounds: int = 500, rate: float = 0.05, depth: int = 4, least: int = 20, held: float = 0.15, patience: int = 20, seed: int = 7) -> Boosted:
    """Boosted trees; the number of rounds, `rounds` at most, is the best on a held-out share of rows, found with patience.

    Each round is fitted once: a regression tree to the slope of the log loss at the rows' margins, which are a column that the
    tree then moves, for held-out rows too. The trees are those that Spark ML's boosting fits, and the first ones are kept. Margins
    are written every CUT rounds, so a lost executor costs a few rounds' margins.
    """
    from pyspark.ml.regression import DecisionTreeRegressor

    _needs(df, features)
    _checked(df)
    data = vectors(at_random(df, held, seed).withColumnRenamed("is_test", "held"), [_col(f).cast("double") for f in features])
    rows = data.select("features", (2 * F.col("label") - 1).alias("side"), "held", F.lit(0.0).alias("margin")).persist()
    learner = DecisionTreeRegressor(labelCol="slope", maxDepth=depth, minInstancesPerNode=least, seed=seed)
    side, margin = F.col("side"), F.col("margin")
    loss = F.avg(F.when(F.col("held"), 2 * F.log1p(F.exp(-2 * side * margin))))
    trees, losses = [], []
    try:
        while len(trees) < rounds and len(losses) - (patient(losses, rounds) if losses else 0) < patience:
            slope = 4 * side / (1 + F.exp(2 * side * margin)) if trees else side
            tree = learner.fit(rows.where("not held").select("features", slope.alias("slope")))
            moved = tree.transform(rows).select("features", "side", "held", (margin + (rate if trees else 1.0) * F.col("prediction")).alias("margin"))
            trees.append(tree)
            if len(trees) % CUT == 0:
                path = workspace(df.sparkSession)
                moved.write.parquet(path)
                moved = df.sparkSession.read.schema(moved.schema).parquet(path)
            moved.persist()
            losses.append(moved.agg(loss).first()[0])  # fills what is kept
            rows.unpersist()
            rows = moved
    finally:
        rows.unpersist()
    keep = patient(losses, patience)
    return Boosted(features, _ensemble(df.sparkSession, trees[:keep], rate, len(features)), keep)


#: Rows among which values are dealt anew, about.
BLOCK = 1 << 12


#: Parts of a log-odds below this take part in sums from which one is taken out again; rows with others are summed anew.
PLAIN = 1 << 10


def _dealt(parts: int, intercept: float, repeats: int) -> Callable[[pa.Table], pa.Table]:
    """Squared errors of a block whose features give the parts _p0, _p1 and so on of the log-odds: number and sum for the rows as
    they are (-1), for each feature number and what is added to that sum, exactly 0 where nothing changes. Rows that lack y or a
    part don't count."""

    def run(block: pa.Table) -> pa.Table:
        block = block.sort_by([("_mark", "ascending"), ("loan_id", "ascending")])
        own, none = (np.column_stack([f(block[f"_p{i}"]) for i in range(parts)]) for f in (lambda c: c.to_numpy(), lambda c: c.is_null().to_numpy()))
        y, known, lacking = block["y"].to_numpy(), ~block["y"].is_null().to_numpy(), none.sum(axis=1)
        odd = np.flatnonzero(~(np.abs(own) < PLAIN).all(axis=1))

        def summed(rows: np.ndarray) -> np.ndarray:
            total = np.full(len(rows), intercept)
            for part in rows.T:
                total += part
            return total

        def errors(z: np.ndarray, lacking: np.ndarray) -> tuple[float, int]:
            kept = known & (lacking == 0)
            off = 1.0 / (1.0 + np.exp(-z[kept])) - y[kept]
            return float(off @ off), len(off)

        with np.errstate(all="ignore"):
            z = summed(own)
            found = [(-1, *errors(z, lacking))]
            start = found[0][1]
            for f in range(parts):
                for r in range(1, repeats + 1):
                    given = np.roll(own[:, f], -r)
                    moved = z + (given - own[:, f])
                    if len(odd):
                        rows = own[odd]
                        rows[:, f] = given[odd]
                        moved[odd] = summed(rows)
                    off, n = errors(moved, lacking - none[:, f] + np.roll(none[:, f], -r))
                    found.append((f, off - start, n))
        return pa.table([pa.array(x, t) for x, t in zip(zip(*found, strict=True), (pa.int32(), pa.float64(), pa.int64()), strict=True)], ["_f", "off", "n"])

    return run


def permutation_importance(model, df: DataFrame, features: list[str], repeats: int = 3, seed: int = 7, block: int = BLOCK) -> list[tuple[str, float]]:
    """How much the Brier score suffers when a feature's values are dealt out anew, as shares of the whole; gains count 0.

    All rows count. They fall into blocks by a hash of the loan and stand there in a seeded order; the r-th time a row
    gets the values of the r-th row after it, round the block. The rows are read once and kept; one shuffle brings donors to
    their rows. A logistic model's log-odds are a sum, so a block's rows are scored by exchanging the feature's part, all rows of
    the block at once; other models score a row for each feature and repeat.
    """
    _needs(df, features)
    if additive := isinstance(model, Logistic):
        _needs(df.select(*[_col(f) for f in features]), model.features)
        shares = list(zip(model.features, model.parts(), strict=True))
        values = [reduce(lambda a, b: a + b, [p for g, p in shares if g == f] or [F.lit(0.0)]).alias(f"_p{i}") for i, f in enumerate(features)]
    else:
        values = [F.array(*[_col(f).cast("double") for f in features]).alias("_own")]
    kept = df.select("loan_id", F.col("y").cast("double").alias("y"), *values).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        blocks = -(-_checked(kept) // block)
        rows = kept.withColumn("_block", F.pmod(seeded(seed, F.col("loan_id")), F.lit(blocks)))
        if additive:
            marked = rows.withColumn("_mark", seeded(seed + 1, F.col("loan_id")))
            errors = marked.groupBy("_block").applyInArrow(_dealt(len(features), model.intercept, repeats), "_f int, off double, n long")
            sums = {r["_f"]: (r["off"], r["n"]) for r in errors.groupBy("_f").agg(F.sum("off").alias("off"), F.sum("n").alias("n")).collect()}
            off, n = sums[-1]
            gaps = [more / m if m == repeats * n else (repeats * off + more) / m - off / n for more, m in (sums[i] for i in range(len(features)))]
        else:
            loss = {r["_f"]: r["loss"] for r in _scored_anew(model, rows, features, repeats, seed).collect()}
            gaps = [loss[i] - loss[-1] for i in range(len(features))]
    finally:
        kept.unpersist()
    worse = [max(0.0, x) for x in gaps]
    total = sum(worse)
    return [(f, x / total if total > 0 else 0.0) for f, x in zip(features, worse, strict=True)]


def _scored_anew(model, rows: DataFrame, features: list[str], repeats: int, seed: int) -> DataFrame:
    """_f (-1: the rows as they are), loss: by a model of any kind, a row for each feature and repeat. rows: loan_id, y, _own, _block."""
    whole = Window.partitionBy("_block").orderBy(seeded(seed + 1, F.col("loan_id")), "loan_id")
    every = whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = F.array(*[F.nth_value("_own", i).over(every) for i in range(1, repeats + 1)])
    place = F.row_number().over(whole)
    donor = lambda r: F.coalesce(F.lead("_own", r).over(whole), F.element_at(first, ((place + r - 1) % F.count(F.lit(1)).over(every) + 1).cast("int")))
    met = rows.select("y", "_own", F.array(*[donor(r) for r in range(1, repeats + 1)]).alias("_donors"))
    # feature -1: the row as it is
    tries = met.withColumn("_f", F.explode(F.sequence(F.lit(-1), F.lit(len(features) - 1)))).withColumn("_r", F.explode(F.when(F.col("_f") < 0, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(repeats - 1)))))
    value = lambda i: F.when(F.col("_f") == i, F.get(F.get("_donors", F.col("_r")), F.lit(i))).otherwise(F.get("_own", F.lit(i)))
    scored = model.score(tries.select("_f", "y", *[value(i).alias(f) for i, f in enumerate(features)]))
    return scored.groupBy("_f").agg(F.avg((F.col("pd") - F.col("y")) ** 2).alias("loss"))


def top_importances(importances: list[tuple[str, float]], n: int = 5) -> list[tuple[str, float]]:
    """The n greatest, equal ones in the order of the features."""
    return sorted(importances, key=lambda x: -x[1])[:n]


def compare(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two evaluation() reports over the same rows: metric, first, second, delta (null if either is)."""
    both = first.withColumnRenamed("value", "first").join(second.withColumnRenamed("value", "second"), "metric")
    return both.withColumn("delta", F.col("second") - F.col("first"))
