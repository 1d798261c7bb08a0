"""Labels over deltas and over streams, whole versions of datasets."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tranche.jobs import ingest, label_deltas, models, queries
from tranche.operators import features, labels
from tranche.sources import store, versions
from tranche.sources import testtables as tt
from tranche.streaming import live_labels

from .conftest import DATA
from .test_models import TOY


def same(one, other):
    return not one.exceptAll(other).count() and not other.exceptAll(one).count()


def test_deltas_in_any_order_give_all_labels(spark, tmp_path):
    months = tt.performance(spark, DATA)
    part = F.pmod(F.xxhash64("loan_id", "loan_age"), F.lit(3))
    for i in (2, 0, 1):
        label_deltas.apply_delta(spark, str(tmp_path), months.where(part == i), f"d{i}", buckets=4)
        assert same(label_deltas.current_labels(spark, str(tmp_path)), labels.label_loans(months.where(part.isin(*{2: [2], 0: [2, 0], 1: [0, 1, 2]}[i]))))
    before = versions.current(spark, str(tmp_path))
    assert label_deltas.apply_delta(spark, str(tmp_path), months, "d1") == before  # known already
    assert before.about == {"buckets": 4, "deltas": ["d2", "d0", "d1"]}


def test_kept_states_are_not_shuffled(spark, tmp_path):
    months = tt.performance(spark, DATA)
    label_deltas.apply_delta(spark, str(tmp_path), months, "a", buckets=4)
    kept = label_deltas.states(spark, versions.current(spark, str(tmp_path)))
    new = labels.loan_states(months.repartition(4, "loan_id"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = kept.join(new, "loan_id", "full_outer")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    left = plan[: plan.index("Exchange")] if "Exchange" in plan else plan
    assert plan.count("Exchange hashpartitioning") == 1 and "SelectedBucketsCount: 4 out of 4" in plan or "Bucketed: true" in left


def test_a_killed_delta_changes_nothing(spark, tmp_path):
    months = tt.performance(spark, DATA)
    label_deltas.apply_delta(spark, str(tmp_path), months.where("loan_age < 12"), "a", buckets=4)
    want = label_deltas.current_labels(spark, str(tmp_path)).collect()
    broken = months.withColumn("loan_age", F.when(F.col("loan_age") > 20, F.raise_error(F.lit("lost"))).otherwise(F.col("loan_age")).cast("int"))
    with pytest.raises(Exception, match="lost"):
        label_deltas.apply_delta(spark, str(tmp_path), broken, "b")
    assert sorted(label_deltas.current_labels(spark, str(tmp_path)).collect()) == sorted(want)
    label_deltas.apply_delta(spark, str(tmp_path), months, "b")
    versions.prune(spark, str(tmp_path))
    assert same(label_deltas.current_labels(spark, str(tmp_path)), labels.label_loans(months))


def test_faulty_rows_fail_when_labels_are_asked(spark, tmp_path):
    rows = spark.createDataFrame([("A", dt.date(2000, 1, 1), 1, "0", None), (None, dt.date(2000, 1, 1), 1, "0", None)], "loan_id string, period date, loan_age int, dlq_status string, zb_code string")
    for name in ("a", "b"):
        label_deltas.apply_delta(spark, str(tmp_path), rows, name, buckets=2)
    with pytest.raises(Exception, match="can't label loan"):
        label_deltas.current_labels(spark, str(tmp_path)).collect()
    with pytest.raises(FileNotFoundError):
        label_deltas.current_labels(spark, str(tmp_path / "none"))


def test_two_writers_dont_both_win(spark, tmp_path):
    write = lambda n: lambda folder: spark.range(n).write.parquet(folder)
    first = versions.publish(spark, str(tmp_path), write(1))
    second = versions.publish(spark, str(tmp_path), write(2), {"x": 1}, after=first)
    with pytest.raises(versions.Conflict):
        versions.publish(spark, str(tmp_path), write(3), after=first)
    assert versions.current(spark, str(tmp_path)) == second and spark.read.parquet(second.folder).count() == 2


def by_quarter(months, folder):
    """A file for each quarter, in order, as they would come in."""
    quarter = F.year("period") * 4 + F.quarter("period")
    dealt = months.withColumn("q", quarter)
    for q in sorted(r["q"] for r in dealt.select("q").distinct().collect()):
        dealt.where(F.col("q") == q).drop("q").coalesce(1).write.mode("append").parquet(str(folder))


def generated(spark, years=9, horizon=12):
    """Five loans a month for years; they go on well beyond the horizon, are paid off, go bad, or stop reporting."""
    loans = spark.range(years * 12 * 5).select(F.col("id"), F.floor(F.col("id") / 5).cast("int").alias("m"))
    last = F.when(F.col("id") % 5 == 1, 4).when(F.col("id") % 5 == 2, 7).when(F.col("id") % 5 == 3, 9).otherwise(2 * horizon)
    rows = loans.select("*", F.explode(F.sequence(F.lit(1), last)).alias("loan_age"))
    period = F.add_months(F.lit("2000-01-01").cast("date"), F.col("m") + F.col("loan_age"))
    status = F.when((F.col("id") % 5 == 2) & (F.col("loan_age") > 3), (F.col("loan_age") - 3).cast("string")).otherwise("0")
    code = F.when((F.col("id") % 5 == 1) & (F.col("loan_age") == 4), "01")
    return rows.select(F.format_string("L%05d", "id").alias("loan_id"), period.alias("period"), F.col("loan_age").cast("int").alias("loan_age"), status.alias("dlq_status"), code.alias("zb_code"))


def test_stream_state_ends_with_the_horizon(spark, tmp_path):
    months = generated(spark).cache()
    by_quarter(months, tmp_path / "in")
    stream = spark.readStream.schema(months.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = live_labels.final_labels(stream, 12).format("memory").queryName("final").start()
    query.processAllAvailable()
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    query.stop()
    total = months.select("loan_id").distinct().count()
    # 12 months of horizon, 3 of lateness, a quarter a file; intervals count months as 31 days
    assert len(held) > 30 and max(held) <= 5 * 30 < total / 3 and held[-1] <= 5 * 30
    final = spark.table("final")
    assert final.count() == final.select("loan_id").distinct().count() > 0.6 * total
    want = labels.label_loans(months.where("loan_age <= 12"), 12)
    assert not final.select("loan_id", "vintage", "d90", "d180", "prepaid").exceptAll(want.select("loan_id", "vintage", "d90", "d180", "prepaid")).count()


def test_live_labels_end_as_the_label_job_has_them(spark, tmp_path):
    months = generated(spark, years=2)
    by_quarter(months, tmp_path / "in")
    stream = spark.readStream.schema(months.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = live_labels.live_labels(stream, 12, late=3).format("memory").queryName("live2").start()
    query.processAllAvailable()
    query.stop()
    last = {r["loan_id"]: (r["d90"], r["d180"], r["prepaid"]) for r in spark.table("live2").collect()}
    assert last == {r["loan_id"]: (r["d90"], r["d180"], r["prepaid"]) for r in labels.label_loans(months, 12).collect()}


def test_saved_versions_are_whole(spark, tmp_path, monkeypatch):
    every = features.joined(tt.acquisitions(spark, DATA), queries.loans(spark, DATA), keep=("state", "occupancy2"))
    data = ingest.Dataset(features.matrix(features.feature_rows(every)), features.accounting(every), features.missing_by_field(every))
    store.save_dataset(data, str(tmp_path), 36, {"toy": TOY})
    saved = store.load_dataset(spark, str(tmp_path))
    assert saved.horizon_months == 36 and saved.models == {"toy": TOY} and same(saved.matrix.select(data.matrix.columns), data.matrix) and same(saved.missing, data.missing) and same(saved.stats, data.stats)
    monkeypatch.setattr(store, "save_logistic", lambda *a: (_ for _ in ()).throw(OSError("killed")))
    with pytest.raises(OSError, match="killed"):  # matrix and accounting are written by then
        store.save_dataset(ingest.Dataset(data.matrix.limit(1), data.stats, data.missing), str(tmp_path), 12, {"toy": TOY})
    again = store.load_dataset(spark, str(tmp_path))
    assert again.horizon_months == 36 and again.matrix.count() == data.matrix.count()
    monkeypatch.undo()
    store.save_dataset(data, str(tmp_path), 24)
    assert store.load_dataset(spark, str(tmp_path)).horizon_months == 24 and again.matrix.count() == data.matrix.count()


def test_groups_of_any_field_ride_along(spark):
    built = ingest.build(tt.acquisition_lines(spark, DATA), tt.performance_lines(spark, DATA), keep=("state", "seller", "zip3"))
    assert {"state", "seller", "zip3"} <= set(built.matrix.columns)


def test_gradient_is_zero_only_where_the_loss_is_least(spark):
    names = ["fico", "oltv", "purpose=P"]
    m = queries.matrix(spark, DATA).select("loan_id", "y", *[f"`{n}`" for n in names]).cache()
    model = models.fit_logistic(m, names)
    assert all(abs(r["gradient"]) < 1e-6 for r in models.gradient(model, m).collect())
    off = models.Logistic(model.features, model.means, model.stds, [model.coefs[0] + 0.01, *model.coefs[1:]], model.intercept)
    assert max(abs(r["gradient"]) for r in models.gradient(off, m).collect()) > 1e-4
