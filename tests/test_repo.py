"""Guards on the code base and a sample of the registered queries against their SQL."""

import re
from pathlib import Path

import duckdb
import pytest

import check
from __spark_entry__ import entry, oracle_sql, queries

ROOT = Path(__file__).resolve().parent.parent
SOURCES = sorted((ROOT / "predaudit").rglob("*.py"))


@pytest.mark.parametrize("banned", [r"F\.corr\(", r"crossJoin", r"localCheckpoint", r"\.rdd\b", r"F\.broadcast\(", r"toPandas"])
def test_banned_calls(banned):
    assert not [p.name for p in SOURCES if re.search(banned, p.read_text())]


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_flagship_query(spark):
    assert entry(spark).count() > 0


@pytest.fixture(scope="module")
def tables():
    folder = "/root/testdata/sf0.001"
    if not Path(folder).exists():
        pytest.skip("test tables are not here")
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for t in check.TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return con, folder


@pytest.mark.parametrize(
    "name",
    "clf_metrics confusion_matrix class_report roc_points reg_metrics quartile_perf fairness_metrics fairness_regression "
    "intersectional column_profile quality_metrics validation_issues importance_stats windowed_metrics drift_psi".split(),
)
def test_query_matches_sql(spark, tables, name):
    con, folder = tables
    assert check.compare(spark, con, folder, name).startswith("ok")
