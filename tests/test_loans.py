"""Golden cases of files, labels and features."""

from __future__ import annotations

import datetime as dt
import gzip

import pytest

from tranche.jobs import ingest
from tranche.operators import features, labels
from tranche.sources import testtables as tt
from tranche.sources.loan_files import RejectedRows, load_stats, parsed, read_lines, rejected
from tranche.sources.schemas import ACQUISITION, PERFORMANCE

from .conftest import DATA

MONTHS = "loan_id string, period date, loan_age int, dlq_status string, zb_code string"


def history(spark, rows, loan="A"):
    """rows: (age, status, code)."""
    day = lambda age: dt.date(2005 + (age + 2) // 12, (age + 2) % 12 + 1, 1)  # noqa: E731  age 0 is March 2005
    return spark.createDataFrame([(loan, day(a), a, s, c) for a, s, c in rows], MONTHS)


def label(spark, rows, horizon=36):
    return labels.label_loans(history(spark, rows), horizon).first()


def clean(ages):
    return [(a, "0", None) for a in ages]


def test_d90_at_three_months(spark):
    got = label(spark, [(a, str(a - 1), None) for a in range(1, 6)])
    assert (got.d90, got.d180, got.default_month, got.defaulted) == (True, None, 4, False)


def test_credit_event_counts_for_both(spark):
    got = label(spark, [(1, "1", None), (2, "2", None), (3, "3", None), (4, "4", None), (5, "", "09")])
    assert (got.d90, got.d180, got.default_month, got.defaulted) == (True, True, 3, True)


def test_prepaid_is_known_and_short_history_is_censored(spark):
    assert label(spark, [(1, "0", None), (3, "0", "01")]).d90 is False
    assert label(spark, clean(range(1, 11))).d90 is None
    assert label(spark, clean(range(1, 11)), horizon=10).d90 is False


def test_event_after_horizon(spark):
    got = label(spark, [*clean(range(1, 40)), (40, "3", None), (41, "", "09")])
    assert (got.d90, got.defaulted, got.default_month) == (False, True, 40)


def test_order_repeats_and_origin(spark):
    rows = [(a, str(max(0, a - 3)), None) for a in range(2, 8)]
    assert label(spark, rows[::-1] + rows) == label(spark, rows)
    assert label(spark, rows).orig_date == dt.date(2005, 3, 1)


def test_blip_and_unknown_status(spark):
    assert label(spark, [(1, "1", None), (2, "X", None), *clean(range(3, 40))]).d90 is False


def test_unlabelable_rows(spark):
    bad = spark.createDataFrame([("A", dt.date(2005, 3, 1), 1, "R", None), ("B", dt.date(2005, 3, 1), None, "0", None)], MONTHS)
    assert {r.reason for r in labels.faults(bad).collect()} == {"unknown dlq_status", "no loan_age"}
    with pytest.raises(Exception, match="can't label loan A"):
        labels.label_loans(bad.where("loan_id = 'A'")).collect()


def test_cohorts(spark):
    df = spark.createDataFrame([(2006, True, True, False), (2006, False, False, True), (2006, False, None, False), (2006, False, False, False), (2006, None, None, False), (2007, None, None, False)], "vintage int, d90 boolean, d180 boolean, prepaid boolean")
    a, b = labels.cohorts(df).collect()
    assert (a.n_loans, a.n_d90, a.n_d180, a.n_prepaid, a.n_censored, a.n_determinable, a.d90_rate) == (5, 1, 1, 1, 1, 4, 0.25)
    assert (b.n_censored, b.d90_rate) == (1, None)


def test_parse_rejects_and_counts(spark, tmp_path):
    good = tt.lines(spark.createDataFrame([("L1", 700), ("L2", None)], "loan_id string, fico int"), ACQUISITION)
    text = [r.value for r in good.collect()]
    wrong = [text[0].replace("700", "70x"), "a|b|c", "", " "]
    with gzip.open(tmp_path / "acq.txt.gz", "wt") as f:
        f.write("\n".join(text + wrong) + "\n")
    lines = read_lines(spark, str(tmp_path / "acq.txt.gz"))
    assert load_stats(lines, ACQUISITION).first() == (5, 2, 3)
    assert {r.reason for r in rejected(lines, ACQUISITION).collect()} == {"fico: no int: 70x", "expected 25 fields, found 3", "expected 25 fields, found 1"}
    assert {(r.loan_id, r.fico) for r in parsed(lines, ACQUISITION).collect()} == {("L1", 700), ("L2", None)}
    with pytest.raises(RejectedRows, match="fico"):
        parsed(lines, ACQUISITION, strict=True)


@pytest.mark.parametrize(("column", "token", "ok"), [("orig_date", "02/2006", True), ("orig_date", "13/2006", False), ("orig_rate", "1.0f", False), ("orig_rate", "nan", True), ("fico", "1.5", False), ("fico", "+5", True), ("orig_rate", " 6.5 ", True)])
def test_tokens(spark, column, token, ok):
    at = [n for n, _ in ACQUISITION].index(column)
    tokens = [""] * len(ACQUISITION)
    tokens[at] = token
    assert parsed(spark.createDataFrame([("|".join(tokens),)], "value string"), ACQUISITION).count() == ok


ACQ = dict(loan_id="A", channel="R", orig_rate=6.5, orig_upb=300000.0, orig_date=dt.date(2006, 3, 1), oltv=80.0, ocltv=None, num_borrowers=None, dti=35.0, fico=700, first_time_buyer="Y", purpose="P", property_type=None, occupancy="Z", state=None, mi_pct=None, co_fico=0)
ACQ_TYPES = "loan_id string, channel string, orig_rate double, orig_upb double, orig_date date, oltv double, ocltv double, num_borrowers int, dti double, fico int, first_time_buyer string, purpose string, property_type string, occupancy string, state string, mi_pct double, co_fico int"
LAB_TYPES = "loan_id string, vintage int, d90 boolean, d180 boolean"


def join(spark, changes=({},), labs=(("A", 2006, True, None),), target="d90"):
    acq = spark.createDataFrame([tuple((ACQ | c).values()) for c in changes], ACQ_TYPES)
    return features.joined(acq, spark.createDataFrame(list(labs), LAB_TYPES), target=target)


def test_feature_rules(spark):
    m = features.matrix(features.feature_rows(join(spark))).first().asDict()
    assert abs(m["rate_spread"] - 0.09) < 1e-9 and m["ocltv"] == 80.0 and m["num_borrowers"] == 1.0 and m["has_coborrower"] == 0.0
    assert m["purpose=P"] == 1.0 and m["occupancy=UNK"] == 1.0 and m["property_type=UNK"] == 1.0 and m["channel=R"] == 1.0
    assert len(features.columns()) == 30 and sum(m[c] for c in features.columns() if "=" in c) == 4


def test_accounting_adds_up(spark):
    every = join(spark, [{}, {"fico": None, "dti": None}, {"loan_id": "B"}, {"loan_id": "C"}, {"orig_upb": 0.0}], [("A", 2006, True, None), ("B", 2006, None, None), ("D", 2006, True, None)])
    s = features.accounting(every).first()
    assert (s.n_acquisitions, s.n_labels, s.n_joined, s.n_rows, s.n_censored_excluded, s.n_missing_required, s.n_label_without_acq, s.n_acq_without_label) == (5, 3, 4, 1, 1, 2, 1, 1)
    assert {tuple(r) for r in features.missing_by_field(every).collect()} == {("fico", 1), ("log_upb", 1)}


def test_targets_and_audit(spark):
    assert join(spark, target="d180").first().fate == "censored"
    with pytest.raises(ValueError, match="unknown target"):
        join(spark, target="d30")
    with pytest.raises(features.Leak):
        features.audit([features.Feature("x", ("zb_code",), lambda: None)])
    with pytest.raises(features.Leak):
        features.audit([features.Feature("x", (), lambda: None)])


@pytest.mark.parametrize(("year", "rate"), [(1990, 7.44), (2030, 6.70), (2006, 6.41)])
def test_benchmark(spark, year, rate):
    from pyspark.sql import functions as F

    assert spark.range(1).select(features.benchmark_rate(F.lit(year))).first()[0] == rate
    assert spark.range(1).select(features.benchmark_rate(F.lit(2003), {2000: 1.0, 2006: 2.0})).first()[0] == 1.0


def test_ingest_end_to_end(spark, tmp_path):
    from tranche.sources import store

    built = ingest.build(tt.acquisition_lines(spark, DATA), tt.performance_lines(spark, DATA))
    s = built.stats.first()
    assert s.n_rows + s.n_censored_excluded + s.n_missing_required == s.n_joined
    store.save_dataset(built, str(tmp_path / "d"), 36)
    saved = store.load_dataset(spark, str(tmp_path / "d"))
    assert saved.matrix.count() == s.n_rows and saved.stats.first() == s and saved.horizon_months == 36


def test_groups(spark):
    rows = spark.createDataFrame([("A",), ("B",), ("C",)], "loan_id string")
    acq = spark.createDataFrame([("A", "x"), ("A", "y"), ("B", None)], "loan_id string, state string")
    assert {tuple(r) for r in features.attach_groups(rows, acq).collect()} == {("A", "y"), ("B", "UNKNOWN"), ("C", "UNKNOWN")}


def test_live_labels(spark, tmp_path):
    from tranche.streaming.live_labels import live_labels

    whole = tt.performance(spark, DATA)
    whole.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = live_labels(stream).format("memory").queryName("live").start()
    query.processAllAvailable()
    query.stop()
    seen = {r.loan_id for r in spark.table("live").collect()}
    assert seen == {r.loan_id for r in labels.label_loans(whole).collect()}


def test_performance_layout():
    assert len(ACQUISITION) == 25 and len(PERFORMANCE) == 31
