"""Loan files of many gzip members, and where their lines stand."""

from __future__ import annotations

import gzip
import random

import pytest
from pyspark.sql import functions as F

from tranche.operators import features
from tranche.sources import gzip_lines
from tranche.sources import testtables as tt
from tranche.sources.loan_files import RejectedRows, parsed, read_lines, rejected
from tranche.sources.schemas import ACQUISITION

from .conftest import DATA


def members(kind, rnd):
    """Bytes of a file, and its lines."""
    lines = ["".join(rnd.choices("abc|é0 ", k=rnd.randrange(0, 60))) for _ in range(400)]
    text = "\n".join(lines).encode() + (b"" if kind == "open end" else b"\n")
    if kind == "one member":
        return gzip.compress(text), lines
    if kind == "stored":  # members whose bytes hold gzip's magic
        text = b"\n".join([b"x" * 40 + b"~\x1f\x8b\x08~" + str(i).encode() for i in range(300)]) + b"\n"
        cuts = sorted(rnd.sample(range(len(text)), 30))
        return b"".join(gzip.compress(text[a:b], 0) for a, b in zip([0, *cuts], [*cuts, None])), [x.decode("utf-8", "replace") for x in text.split(b"\n")[:-1]]
    cuts = sorted(rnd.choices(range(len(text)), k=60))  # some members hold nothing, some no whole line
    if kind == "at line ends":
        cuts = [text.index(b"\n", c) + 1 for c in cuts]
    pad = b"\0" * 100 if kind == "padded" else b""
    return b"".join(gzip.compress(text[a:b]) + pad for a, b in zip([0, *cuts], [*cuts, None])), lines


@pytest.mark.parametrize("kind", ["cut anywhere", "at line ends", "open end", "one member", "padded", "stored"])
def test_lines_at_every_split(tmp_path, kind):
    data, want = members(kind, random.Random(kind))
    path = tmp_path / "x.gz"
    path.write_bytes(data)
    for split in (37, 64, 500, 4096, 1 << 20):
        got = []
        for i in range(0, len(data), split):
            with open(path, "rb") as f:
                got += [x.decode("utf-8", "replace") for x in gzip_lines.lines(f, i, min(i + split, len(data)))]
        assert got == want, split


def test_broken_file_is_an_error(tmp_path):
    path = tmp_path / "x.gz"
    path.write_bytes(gzip.compress(b"a\n" * 1000) + gzip.compress(bytes(random.Random(1).randbytes(5000)))[:-100])
    with open(path, "rb") as f, pytest.raises(gzip_lines.Broken, match="ends early"):
        list(gzip_lines.lines(f, 0, path.stat().st_size))


@pytest.mark.parametrize("split", [300, 1 << 14, 1 << 26])
def test_written_files_are_read_as_spark_reads_them(spark, tmp_path, split):
    lines = tt.acquisition_lines(spark, DATA, planted=True)
    path = str(tmp_path / "gz")
    gzip_lines.write_gzip_lines(lines.repartition(3), path, member=100)
    own, plain = gzip_lines.read_gzip_lines(spark, path, split), spark.read.text(path)
    assert sorted(r.value for r in own.collect()) == sorted(r.value for r in plain.collect()) == sorted(r.value for r in lines.collect())
    # lines of a file stay in order, and bad ones know their numbers
    order = own.orderBy("file", "piece", "n").collect()
    files = {}
    for r in order:
        files.setdefault(r.file, []).append(r.value)
    for file, got in files.items():
        assert got == gzip.open(file, "rt").read().split("\n")[:-1]
    bad = rejected(own, ACQUISITION).collect()
    assert len(bad) == rejected(lines, ACQUISITION).count() > 0 and all(files[r.file][r.line - 1] == r.value for r in bad)


def test_line_numbers_over_splits(spark, tmp_path):
    text = ["a|b", ""] * 300 + ["|".join(["x"] * 25)] * 5 + ["c|d|e"]
    for name in ("one.txt", "two.txt"):
        (tmp_path / name).write_text("\n".join(text) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    try:
        bad = rejected(read_lines(spark, str(tmp_path)), ACQUISITION).collect()
        assert sorted(r.line for r in bad if r.file.endswith("one.txt")) == [i for i, x in enumerate(text, 1) if x] and len(bad) == 2 * (300 + 6)
        with pytest.raises(RejectedRows, match=r"two.txt \| \d+"):
            parsed(read_lines(spark, str(tmp_path / "two.txt")), ACQUISITION, strict=True)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_last_line_of_a_loan_gives_its_group(spark, tmp_path):
    rows = [("A", "x"), ("B", "z"), ("A", "a"), ("C", "c"), ("C", None), ("B", "y")]
    given = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "loan_id string, state string, i int").coalesce(1).orderBy("i")
    (tmp_path / "acq.txt").write_text("".join(r.value + "\n" for r in tt.lines(given.select("loan_id", "state", F.lit(700).alias("fico")), ACQUISITION).collect()))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    try:
        acq = parsed(read_lines(spark, str(tmp_path / "acq.txt")), ACQUISITION, place=True)
        loans = spark.createDataFrame([("A", "old"), ("B", "old"), ("C", "old"), ("D", "old")], "loan_id string, grp string")
        assert {(r.loan_id, r.grp) for r in features.attach_groups(loans, acq).collect()} == {("A", "a"), ("B", "y"), ("C", "UNKNOWN"), ("D", "UNKNOWN")}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert features.attach_groups(loans, given, order="i").where("grp = 'a'").count() == 1 and features.attach_groups(loans, given.withColumn("grp", F.lit(1))).count() == 4


def test_plan_converts_each_field_once(spark):
    """A filter on the reason must not carry copies of the conversions: over a layout of 31 fields they filled the driver."""
    layout = [("a", "text"), ("b", "double"), ("c", "int"), ("d", "month"), ("e", "day")]
    lines = spark.createDataFrame([("x|1.5|2|03/2001|04/05/2001",), ("x|1.5|no|03/2001|04/05/2001",), ("x|1",), ("",)], "value string")
    good, bad = parsed(lines, layout), rejected(lines, layout)
    for df in (good, bad):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("RLIKE") == 1 and plan.count("split(") == 1, plan
    assert [r.b for r in good.collect()] == [1.5]
    assert sorted(r.reason for r in bad.collect()) == ["c: no int: no", "expected 5 fields, found 2"]
