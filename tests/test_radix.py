"""Values at ranks by counting bits, and slices by counts, against sorting."""

from __future__ import annotations

import math
import struct
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tranche.operators import drift, fairness, metrics, radix

ODD = [0.0, -0.0, 1.0, -1.0, 0.1, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308, -1.7976931348623157e308, math.inf, -math.inf, 1e-310, 3.0, 4.0, 2.0**52, 2.0**53 + 2, 1 - 2**-53, 1 + 2**-52]


def test_keys_are_ordered_as_the_doubles(spark):
    rng = np.random.default_rng(1)
    bits = rng.integers(0, 2**63, 20_000, dtype=np.uint64) | (rng.integers(0, 2, 20_000, dtype=np.uint64) << np.uint64(63))
    values = [x for x in bits.view(np.float64).tolist() if not math.isnan(x)] + ODD + [x for e in range(-1074, 1024, 7) for x in (2.0**e, -(2.0**e), math.nextafter(2.0**e, 0))]
    rows = radix.order_key(spark.createDataFrame([(x,) for x in [*values, math.nan, None]], "v double"), "v", "k").collect()
    for r in rows:
        if r["v"] is not None and not math.isnan(r["v"]):
            size = struct.unpack("<q", struct.pack("<d", abs(r["v"])))[0]
            assert r["k"] == (-size if r["v"] < 0 else size), r
    assert [r["k"] for r in rows if r["v"] is None] == [None]
    assert math.isnan(max((r for r in rows if r["k"] is not None), key=lambda r: r["k"])["v"])


@pytest.mark.parametrize("kind", ["same", "mixed", "wide", "close", "hot", "weighted"])
def test_ranks_against_sorting(spark, kind):
    rng = np.random.default_rng(2)
    n = 3000
    values = {
        "same": np.full(n, 0.25), "mixed": rng.normal(0, 3, n).round(2), "wide": np.concatenate([10.0 ** rng.uniform(-300, 300, n - len(ODD)) * rng.choice([-1, 1], n - len(ODD)), ODD]),
        "close": 1 + rng.integers(0, 2000, n) * 2.0**-52, "hot": np.where(rng.random(n) < 0.6, 7.5, rng.random(n)), "weighted": rng.random(n),
    }[kind]
    weight = rng.integers(1, 50, n) if kind == "weighted" else np.ones(n, int)
    df = spark.createDataFrame([("a" if i % 3 else "b", float(v), int(w)) for i, (v, w) in enumerate(zip(values, weight))] + [("a", None, 5)], "g string, v double, n long").repartition(4)
    got = radix.at_ranks(df, "g", "v", lambda total: sorted({1, total, total // 2, total // 3 + 1, 17}), "n")
    for g, at in (("a", np.arange(n) % 3 != 0), ("b", np.arange(n) % 3 == 0)):
        ordered = np.sort(np.repeat(values[at], weight[at]))
        total, found = got[g]
        assert total == len(ordered) and found == {t: ordered[t - 1] for t in found} and len(found) == 5


def test_nothing_has_no_ranks(spark):
    empty = spark.createDataFrame([("a", None)], "g string, v double")
    assert radix.cuts(empty, "g", "v", [10]) == {}


def psi_by_sorting(expected, actual, k=10):
    expected = sorted(expected)
    edges = sorted({expected[-(-b * len(expected) // k) - 1] for b in range(1, k)})
    bins = lambda xs: np.bincount(np.searchsorted(edges, xs, side="left"), minlength=len(edges) + 1) / len(xs)
    e, a = np.maximum(bins(expected), 1e-4), np.maximum(bins(actual), 1e-4)
    return float(((a - e) * np.log(a / e)).sum())


def test_psi_of_features_shuffles_no_values(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(bool(rng.random() < 0.4), float(rng.normal()), float(rng.integers(0, 3))) for _ in range(4000)]
    df = spark.createDataFrame(rows, "is_test boolean, x double, z double")
    got = {r["feature"]: r["psi"] for r in drift.feature_psi(df, ["x", "z"]).collect()}
    for i, f in ((1, "x"), (2, "z")):
        # a bin without rows on either side adds nothing, so unlike here it isn't floored: leave those out
        assert abs(got[f] - psi_by_sorting([r[i] for r in rows if not r[0]], [r[i] for r in rows if r[0]])) < 1e-9
    plans = []
    real = drift.cuts
    monkeypatch.setattr(drift, "cuts", lambda rows, *a: (plans.append(rows._jdf.queryExecution().toString()), real(rows, *a))[1])
    drift.feature_psi(df, ["x", "z"]).collect()
    fairness.proxy_power(df.withColumn("grp", F.when(F.col("is_test"), "a").otherwise("b")), ["x", "z"]).collect()
    assert len(plans) == 2 and not any("hashpartitioning" in p or "rangepartitioning" in p for p in plans)


def by_sorting(rows, k, rising):
    """n, mean pd, mean y, least and greatest pd of each slice."""
    ordered = sorted(rows, key=(lambda r: (r[1], r[2], r[0])) if rising else (lambda r: (-r[1], r[0])))
    k = min(k, len(rows))
    size, more, at, out = len(rows) // k, len(rows) % k, 0, []
    for i in range(k):
        part = ordered[at : at + size + (i < more)]
        at += len(part)
        out.append((len(part), sum(r[1] for r in part) / len(part), sum(r[2] for r in part) / len(part), min(r[1] for r in part), max(r[1] for r in part)))
    return out


@pytest.mark.parametrize(("n", "scores"), [(1, [0.5]), (9, [0.1, 0.2, 0.9]), (23, [0.0, 1.0]), (500, [0.5]), (500, [0.0, 0.3, 1.0]), (500, list(np.linspace(0, 1, 57).round(6))), (300, list(np.linspace(0, 1, 1000).round(6)))])
def test_slices_against_sorting(spark, scores, n):
    rng = np.random.default_rng(n)
    rows = [(f"L{i:05d}", float(rng.choice(scores)), int(rng.random() < 0.3)) for i in rng.permutation(n)]
    df = spark.createDataFrame(rows, "loan_id string, pd double, y int").repartition(3)
    curve = [(r.n, r.mean_predicted, r.realised, r.p_lo, r.p_hi) for r in metrics.reliability(df).orderBy("bin").collect()]
    table = [(r.n, r.mean_predicted, r.realised) for r in metrics.deciles(df).orderBy("decile").collect()]
    assert np.allclose(curve, by_sorting(rows, 10, True)) and np.allclose(table, [r[:3] for r in by_sorting(rows, 10, False)])


def test_slices_of_one_score_of_very_many_rows(spark):
    df = spark.range(2_000_000).select(F.format_string("L%08d", "id").alias("loan_id"), F.lit(0.25).alias("pd"), (F.pmod(F.xxhash64("id"), F.lit(4)) == 0).cast("int").alias("y"))
    start = time.perf_counter()
    curve = metrics.reliability(df).collect()
    assert [r.n for r in curve] == [200_000] * 10 and curve[0].realised == 0 and curve[9].realised == 1
    assert time.perf_counter() - start < 20  # 27.5 s when all rows were ranked


@pytest.mark.parametrize("bad", [None, float("nan")])
def test_rows_without_a_score_are_refused(spark, bad):
    df = spark.createDataFrame([("A", 0.5, 1), ("B", bad, 0)], "loan_id string, pd double, y int")
    for figure in (metrics.auc, metrics.brier, metrics.deciles, metrics.evaluation):
        with pytest.raises(Exception, match="no pd: B"):
            figure(df).collect()



def test_cells_are_those_of_a_search(spark):
    edges = sorted(np.random.default_rng(4).normal(0, 1, 45).tolist())
    values = [*edges, *[x + 1e-9 for x in edges], -math.inf, math.inf, math.nan, None, 0.0]
    table = spark.createDataFrame([("x", 2, edges[:20]), ("x", 3, edges[15:]), ("y", 2, [0.0])], "feature string, k int, cuts array<double>")
    rows = spark.createDataFrame([(f, str(i), v, 1) for f in "xy" for i, v in enumerate(values)], "feature string, grp string, value double, n int")
    for r in drift.cells(rows, table).collect():
        own, v = edges if r.feature == "x" else [0.0], values[int(r.grp)]
        assert r.cell == (0 if v is None else len(own) if math.isnan(v) else int(np.searchsorted(own, v))) and r.edge == (own[r.cell - 1] if r.cell else None)


def test_power_sorts_values_into_cells_once(spark, monkeypatch):
    """Four parts of the query read the cells; the values behind them, which are many, are looked at once."""
    seen, real = spark.sparkContext.accumulator(0), drift.cells

    def look(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    for module in (drift, fairness):
        monkeypatch.setattr(module, "cells", lambda rows, edges: real(rows.mapInArrow(look, rows.schema), edges), raising=False)
    df = spark.range(400).select((F.col("id") % 4).cast("string").alias("grp"), (F.col("id") * 37 % 101).cast("double").alias("x"), F.lit(0.5).alias("pd"), F.lit(1).alias("y"))
    power = fairness.proxy_power(df, ["x"]).collect()
    assert seen.value == 400
    groups, again = fairness.audit(df, ["x"])
    assert again.collect() == power and groups.count() == 4 and seen.value == 800


def test_audit_reads_scored_rows_twice(spark):
    """Once for the sizes of the groups, once for all that is kept."""
    seen = spark.sparkContext.accumulator(0)

    def look(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = spark.range(400).select((F.col("id") % 4).cast("string").alias("grp"), (F.col("id") * 37 % 101).cast("double").alias("x"), F.lit(0.5).alias("pd"), F.lit(1).alias("y"))
    groups, power = fairness.audit(df.mapInArrow(look, df.schema), ["x"])
    assert groups.count() == 4 and power.count() == 1 and seen.value <= 800
