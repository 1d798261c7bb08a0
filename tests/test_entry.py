"""The driver contract, with and without the llm parts."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from tranche.jobs.oracle import oracle
from tranche.jobs.queries import QUERIES

from .conftest import DATA, ROOT

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def rows(df):
    cell = lambda x: f"{x:.6g}" if isinstance(x, float) else "None" if x is None or x != x else str(x)
    return sorted(tuple(map(cell, r)) for r in df[sorted(df.columns)].astype(object).where(df.notna(), None).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", ["parse_acquisition", "load_stats", "rejected_rows", "loan_labels", "vintage_cohorts", "join_accounting", "evaluation_report", "evaluation_full", "hash_split", "psi_features", "reason_codes", "proxy_power", "permutation_importance", "custom_benchmark", "group_attach"])
def test_queries_match_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    assert rows(entry.queries()[name](spark, DATA).toPandas()) == rows(con.sql(oracle()[name]).df())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(oracle()) < set(QUERIES) <= set(entry.queries())


def test_without_llm(tmp_path):
    shutil.copytree(f"{ROOT}/tranche", tmp_path / "tranche", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert 'auc' in e.queries() and 'auc' in e.oracle_sql(); assert not [x for x in e.queries() if x.startswith('op') or x == 'pipeline']"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
