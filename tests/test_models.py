"""Golden cases of metrics, drift, splits, models, reasons and fairness."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tranche.jobs import models, out_of_time, queries
from tranche.operators import drift, fairness, features, metrics, ranks, reasons, splits
from tranche.sources import store

from .conftest import DATA


def scored(spark, ps, ys):
    return spark.createDataFrame([(f"L{i:04d}", float(p), int(y)) for i, (p, y) in enumerate(zip(ps, ys, strict=True))], "loan_id string, pd double, y int")


@pytest.mark.parametrize(("y", "s", "want"), [([1, 0, 1, 0], [0.9, 0.8, 0.7, 0.1], 0.75), ([1, 0, 1, 0], [0.5] * 4, 0.5), ([1, 0, 0], [0.5, 0.5, 0.2], 0.75), ([1, 1], [0.1, 0.2], None)])
def test_auc(spark, y, s, want):
    assert metrics.auc(scored(spark, s, y)).first().auc == want


def test_auc_against_pairs(spark):
    rng = np.random.default_rng(1)
    s, y = np.round(rng.random(400), 2), rng.integers(0, 2, 400)
    pairs = [(a > b) + (a == b) / 2 for a in s[y == 1] for b in s[y == 0]]
    assert abs(metrics.auc(scored(spark, s, y)).first().auc - np.mean(pairs)) < 1e-12


def test_brier_and_skill(spark):
    got = metrics.brier(scored(spark, [0.9, 0.2, 0.6, 0.3], [1, 0, 1, 0])).first()
    assert abs(got.brier - (0.01 + 0.04 + 0.16 + 0.09) / 4) < 1e-12 and got.climatology == 0.25
    assert metrics.brier(scored(spark, [0.9, 0.2], [1, 1])).first().skill is None
    assert metrics.evaluation(scored(spark, [], [])).count() == 0


def test_reliability(spark):
    seven = scored(spark, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7], [0] * 7)
    assert [r.n for r in metrics.reliability(seven, 3).collect()] == [3, 2, 2]
    a, b = metrics.reliability(scored(spark, [0.1, 0.2, 0.7, 0.9], [0, 0, 1, 1]), 2).collect()
    assert (round(a.mean_predicted, 9), a.realised, round(b.mean_predicted, 9), b.realised) == (0.15, 0, 0.8, 1)
    two = scored(spark, [0.05, 0.95], [0, 1])
    assert metrics.reliability(two, 10).count() == 2
    first, last = metrics.reliability(two, 10, "uniform").collect()
    assert (first.p_lo, first.p_hi, last.bin) == (0.0, 0.1, 9)
    assert [r.bin for r in metrics.reliability(scored(spark, [1.0], [1]), 10, "uniform").collect()] == [9]
    with pytest.raises(ValueError, match="unknown strategy"):
        metrics.reliability(two, 10, "other")


def test_deciles(spark):
    rows = metrics.deciles(scored(spark, [0.95 - i / 20 for i in range(10)], [1] + [0] * 9)).collect()
    assert rows[0].lift == 10.0 and sum(r.n for r in rows) == 10
    assert metrics.deciles(scored(spark, [0.1, 0.2], [0, 0])).first().lift is None


@pytest.mark.parametrize("n", [1, 7, 10, 101, 1003])
def test_slices_are_ntile(spark, n):
    df = spark.range(n).select(F.col("id").cast("string").alias("loan_id"), (F.col("id") % 13).cast("double").alias("v"))
    got = ranks.global_rank(df, "v", ["loan_id"], per_bucket=max(1, n // 5)).withColumn("s", ranks.slice_of(F.col("rank"), F.lit(n), 10) + 1)
    from pyspark.sql import Window

    want = df.withColumn("s", F.ntile(10).over(Window.orderBy("v", "loan_id")))
    assert not got.select("loan_id", "s").exceptAll(want.select("loan_id", "s")).count()


@pytest.mark.parametrize(("n", "k"), [(1, 10), (5, 10), (10, 10), (997, 10), (1000, 4)])
def test_quantile_cuts(spark, n, k):
    values = [float((i * 37) % 61) for i in range(n)]
    got = sorted(r.cut for r in ranks.quantile_cuts(spark.createDataFrame([(v,) for v in values], "v double"), "v", k).collect())
    k2, ordered = max(1, min(k, n)), sorted(values)
    assert got == sorted({ordered[math.ceil(b * n / k2) - 1] for b in range(1, k2)})


def test_buckets_split_a_shared_value(spark):
    df = spark.range(20_000).select(F.format_string("L%06d", "id").alias("loan_id"), F.when(F.col("id") % 10 == 0, F.col("id") / 7).otherwise(0.5).alias("v"))
    sizes = [r["count"] for r in ranks.bucketed(df, ["v", "loan_id"], 1000).groupBy("_bucket").count().collect()]
    assert len(sizes) == 20 and max(sizes) < 2000
    ranked = ranks.global_rank(df, "v", ["loan_id"], per_bucket=1000).toPandas().sort_values(["v", "loan_id"])
    assert (ranked["rank"].to_numpy() == np.arange(20_000)).all()


def test_running_totals_by_group(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 5 == 0, "b").otherwise("a").alias("g"), (F.col("id") * 7919 % 3001).cast("double").alias("v"), (F.col("id") % 3).alias("n"))
    df = df.union(spark.createDataFrame([(None, None, 1), ("a", None, 2)], "g string, v double, n long"))
    got = ranks.running_before(df, "v", ["n"], ["g"], per_bucket=100).where("g is not null").toPandas()
    for _, part in got.groupby("g"):
        part = part.sort_values("v", na_position="first")
        assert (part["n_before"].to_numpy() == np.r_[0, part["n"].cumsum()[:-1]]).all()


def psi(spark, a, b, k=10):
    df = spark.createDataFrame([(False, float(x)) for x in a] + [(True, float(x)) for x in b], "is_test boolean, x double")
    return drift.psi(drift.long_counts(df, ["x"], ["is_test"]), k).first().psi


def test_psi(spark):
    assert psi(spark, range(100), range(100)) == 0
    assert psi(spark, [50] * 20, [50] * 9) == 0
    assert psi(spark, [50] * 20, [60] * 20) > 0.25
    half = psi(spark, [0] * 50 + [1] * 50, [0] * 25 + [1] * 75, 2)
    assert abs(half - (0.25 * math.log(1.5) + 0.25 * math.log(2))) < 1e-9


def test_splits(spark):
    m = queries.matrix(spark, DATA).select("loan_id", "vintage", "y")
    side = splits.at_random(m, 0.25, 7)
    n, test = side.agg(F.count(F.lit(1)), F.count_if("is_test")).first()
    assert n == m.count() and test == n // 4
    assert not side.exceptAll(splits.at_random(m, 0.25, 7)).count() and side.exceptAll(splits.at_random(m, 0.25, 8)).count()
    repeated = m.where("loan_id < 'L000000040'").select("loan_id", F.explode(F.array(*[F.lit(i) for i in range(50)])).alias("vintage"), "y")
    sides = splits.at_random(repeated.union(repeated.withColumn("loan_id", F.lit(None))), 0.3, 7)
    n, test = sides.agg(F.count(F.lit(1)), F.count_if("is_test")).first()
    assert test == int(n * 0.3) and not sides.exceptAll(splits.at_random(repeated.union(repeated.withColumn("loan_id", F.lit(None))).repartition(5), 0.3, 7)).count()
    assert splits.at_random(m.limit(1), 0.1).first().is_test and splits.at_random(m.where("false"), 0.1).count() == 0
    with pytest.raises(ValueError, match="side empty"):
        splits.by_vintage(m, 2050)
    with pytest.raises(ValueError):
        splits.at_random(m, 1.0)


def newton(x, y, c):
    x = np.hstack([(x - x.mean(0)) / np.where(x.std(0) == 0, 1, x.std(0)), np.ones((len(x), 1))])
    w, ridge = np.zeros(x.shape[1]), np.r_[np.ones(x.shape[1] - 1), 0]
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve(c * (x.T * (p * (1 - p))) @ x + np.diag(ridge), c * x.T @ (p - y) + ridge * w)
    return w


def test_logistic_matches_newton(spark, tmp_path):
    names = ["fico", "oltv", "dti", "purpose=P"]
    m = queries.matrix(spark, DATA).select("loan_id", "y", *[f"`{n}`" for n in names])
    model = models.fit_logistic(m, names)
    data = m.toPandas()
    want = newton(data[names].to_numpy(), data["y"].to_numpy(), 1.0)
    assert np.allclose([*model.coefs, model.intercept], want, atol=1e-5)
    store.save_logistic(spark, model, str(tmp_path / "m"))
    assert store.load_logistic(spark, str(tmp_path / "m")) == model
    spark.createDataFrame([("boosted", "{}")], "kind string, body string").write.json(str(tmp_path / "x"))
    with pytest.raises(ValueError, match="no logistic model"):
        store.load_logistic(spark, str(tmp_path / "x"))
    with pytest.raises(ValueError, match="lacking"):
        model.score(m.drop("fico"))
    with pytest.raises(ValueError, match="both classes"):
        models.fit_logistic(m.where("y = 1"), names)


def test_boosted(spark, tmp_path):
    names = ["fico", "oltv", "dti"]
    m = queries.matrix(spark, DATA).select("loan_id", "y", *names).cache()
    model = models.fit_boosted(m, names, rounds=3, patience=2)
    assert abs(sum(x for _, x in model.importances()) - 1) < 1e-9 and 1 <= model.rounds <= 3
    shares = models.permutation_importance(model, m, names, repeats=1)
    assert models.top_importances(shares, 1)[0][0] == "fico" and abs(sum(x for _, x in shares) - 1) < 1e-9
    assert models.patient([3, 2, 1, 2, 2, 0], 2) == 3 and models.patient([3, 2, 1, 2, 0], 3) == 5
    store.save_boosted(spark, model, str(tmp_path / "m"))
    again = store.load_boosted(spark, str(tmp_path / "m"))
    assert (again.features, again.rounds, again.importances()) == (model.features, model.rounds, model.importances())
    assert not model.score(m).exceptAll(again.score(m)).count()
    with pytest.raises(ValueError, match="no logistic model"):
        store.load_logistic(spark, str(tmp_path / "m" / "about"))
    store.save_logistic(spark, TOY, str(tmp_path / "t"))
    with pytest.raises(ValueError, match="no boosted model"):
        store.load_boosted(spark, str(tmp_path / "t"))


def test_importances_in_order():
    assert models.top_importances([("a", 0.2), ("b", 0.5), ("c", 0.2), ("d", 0.1)], 3) == [("b", 0.5), ("a", 0.2), ("c", 0.2)]


@pytest.mark.parametrize("block", [1, 2, 50, 1 << 12])
def test_permutation_deals_every_value_once(spark, block):
    """A model that is the feature itself: the losses are those of values dealt round each block."""
    df = spark.range(120).select(F.format_string("L%03d", "id").alias("loan_id"), (F.col("id") % 3 == 0).cast("int").alias("y"), ((F.col("id") * 37 % 101) / 101).alias("x"), F.lit(0.0).alias("z"))
    model = models.Logistic(["x", "z"], [0.0, 0.0], [1.0, 1.0], [1.0, 0.0], 0.0)
    from tranche.functions.scalars import seeded

    rows = df.select("y", "x", seeded(7, F.col("loan_id")).alias("a"), seeded(8, F.col("loan_id")).alias("b")).collect()
    blocks, parts = -(-120 // block), {}
    for r in sorted(rows, key=lambda r: r.b):
        parts.setdefault(r.a % blocks, []).append(r)
    p = lambda x: 1 / (1 + math.exp(-x))
    start = np.mean([(p(r.x) - r.y) ** 2 for r in rows])
    dealt = np.mean([(p(part[(i + k) % len(part)].x) - r.y) ** 2 for part in parts.values() for i, r in enumerate(part) for k in (1, 2, 3)])
    got = dict(models.permutation_importance(model, df, ["x", "z"], block=block))
    assert got == {"x": 1.0 if dealt > start + 1e-12 else 0.0, "z": 0.0}


TOY = models.Logistic(["fico", "oltv", "dti"], [0.0] * 3, [1.0] * 3, [-1.0, 0.5, 0.25], -2.0)


def test_reasons(spark):
    m = spark.createDataFrame([("A", -1.5, 2.0, 1.0), ("B", 1.0, -1.0, 0.0)], "loan_id string, fico double, oltv double, dti double")
    a = reasons.explain_one(TOY, m, "A").first()
    assert [(r.feature, r.contribution) for r in a.reasons] == [("fico", 1.5), ("oltv", 1.0), ("dti", 0.25)]
    assert abs(a.log_odds - 0.75) < 1e-12 and abs(a.pd - 1 / (1 + math.exp(-0.75))) < 1e-12
    assert reasons.explain_one(TOY, m, "B").first().reasons == []
    assert len(reasons.explain_one(TOY, m, "A", top=1).first().reasons) == 1
    with pytest.raises(KeyError):
        reasons.explain_one(TOY, m, "C")
    assert "PU" in reasons.phrase("property_type=PU") and "other" in reasons.phrase("other")
    total = reasons.contributions(TOY, m).groupBy("loan_id").agg(F.sum("contribution").alias("s")).where("loan_id = 'A'").first().s
    assert abs(total + TOY.intercept - a.log_odds) < 1e-12


def test_fairness(spark):
    rows = queries.grouped(spark, DATA)
    groups, power = fairness.audit(rows, ["fico"], least=10**9)
    only = groups.collect()
    assert [(g.grp, g.n) for g in only] == [("OTHER", rows.count())] and power.first().power == 0
    largest = rows.groupBy("grp").count().orderBy(F.desc("count"), "grp").first().grp
    planted = rows.withColumn("planted", F.when(F.col("grp") == largest, 100.0).otherwise(0.0))
    found = {r.feature for r in fairness.proxy_flags(fairness.proxy_power(fairness.pooled(planted), ["planted", *features.columns()])).collect()}
    assert "planted" in found


def test_out_of_time(spark):
    m = queries.matrix(spark, DATA).cache()
    report = out_of_time.validate(m, ["fico", "oltv", "dti", "orig_rate"], 1998)
    table = {r.metric: r for r in out_of_time.headline(report.metrics).collect()}
    assert list(table) == list(out_of_time.HEADLINE) and table["auc"].naive > 0.5
    curves = {(r.protocol, r.part) for r in report.curves.select("protocol", "part").distinct().collect()}
    assert len(curves) == 6 and report.curves.where("part = 'decile' and metric = 'n' and protocol = 'oot'").agg(F.sum("value")).first()[0] == report.metrics.where("metric = 'n' and protocol = 'oot'").first().value
    assert report.feature_psi.count() == 4 and report.score_psi.first().psi >= 0
    compared = models.compare(report.metrics.where("protocol = 'oot'").drop("protocol"), report.metrics.where("protocol = 'naive'").drop("protocol"))
    assert compared.count() == 8


class Generic:
    """A model that only scores."""

    def __init__(self, model):
        self.score = model.score


@pytest.mark.parametrize("odd", [None, 1e30, math.inf, -math.inf])
def test_permutation_scores_parts_as_it_scores_rows(spark, odd):
    """Exchanged parts of a sum give what rows scored anew give, also for values that swallow or lack the others."""
    df = spark.range(300).select(
        F.format_string("L%03d", "id").alias("loan_id"), F.when(F.col("id") % 40 != 5, (F.col("id") * 7 % 5 - 3 * (F.col("id") * 37 % 101) / 101 > 0.5).cast("int")).alias("y"), ((F.col("id") * 37 % 101) / 101).alias("x"),
        F.when(F.col("id") % 29 == 0, F.lit(odd).cast("double")).otherwise((F.col("id") * 7 % 5).cast("double")).alias("a.b"), F.lit(2.0).alias("same"), (F.col("id") % 3).cast("double").alias("unused"),
    )
    names = ["x", "a.b", "same", "unused"]
    model = models.Logistic(["a.b", "x", "same"], [2.0, 0.5, 0.0], [1.5, 0.3, 1.0], [0.4, -0.7, 0.3], -0.2)
    got, want = (models.permutation_importance(m, df, names, block=40) for m in (model, Generic(model)))
    assert got[2:] == [("same", 0.0), ("unused", 0.0)] and np.allclose([x for _, x in got], [x for _, x in want], atol=1e-9) and sum(x for _, x in got) > 0.99
    with pytest.raises(ValueError, match="lacking"):
        models.permutation_importance(model, df, ["x", "same"])


def test_permutation_reads_rows_once(spark):
    """The matrix behind the rows costs most: counting, checking and scoring go over rows that are kept, and no row is scored on its own."""
    seen = spark.sparkContext.accumulator(0)

    def look(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = spark.range(200).select(F.format_string("L%03d", "id").alias("loan_id"), (F.col("id") % 3 == 0).cast("int").alias("y"), (F.col("id") * 37 % 101).cast("double").alias("x"))
    df = df.mapInArrow(look, df.schema)
    models.permutation_importance(models.Logistic(["x"], [50.0], [30.0], [1.0], 0.0), df, ["x"], block=50)
    assert seen.value == 200
