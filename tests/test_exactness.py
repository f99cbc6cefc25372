"""Inputs on which shortcuts once gave wrong or missing rows."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from predaudit.operators import charts, explain, quality, roles
from predaudit.operators.classification import performance
from predaudit.spec import MULTICLASS, AuditSpec
from predaudit.streaming.monitor import windowed_metrics


def _copies(df):
    return quality.duplicates(df).first()["duplicate_rows"], quality.duplicates(df, digest=False).first()["duplicate_rows"]


def test_digest_tells_apart_what_grouping_does(spark):
    t = dt.datetime(2024, 1, 1)
    times = spark.createDataFrame([(t,), (t + dt.timedelta(microseconds=1),), (t,), (None,), (None,)], "t timestamp")
    assert _copies(times) == (2, 2)
    numbers = spark.createDataFrame([(0.0, "a", "b"), (-0.0, "a", "b"), (math.nan, "ab", ""), (math.nan, "ab", ""), (1.0, "", "ab"), (1.0, "a", "b"), (1.0, None, "-")], "x double, a string, b string")
    assert _copies(numbers) == (2, 2)
    nested = spark.createDataFrame([(["a, b"], (1, t)), (["a", "b"], (1, t)), (["a", "b"], (1, t + dt.timedelta(microseconds=1)))], "a array<string>, s struct<i: int, t: timestamp>")
    assert _copies(nested) == (0, 0)


def test_multiclass_windows_equal_performance(spark):
    rows = [(f"2024-01-0{1 + i % 3} 10:00:00", i % 4, (i * 7) % 4 if i % 5 else i % 4) for i in range(90)]
    df = spark.createDataFrame(rows, "ts string, y int, p int")
    spec = AuditSpec("p", "y", timestamp="ts", problem=MULTICLASS)
    for window in windowed_metrics(df, spec).collect():
        day = df.where(f"to_date(ts) = date'{window['window_start'].date()}'")
        for r in performance(day, spec).collect():
            assert window[r["metric"]] == pytest.approx(r["value"])


def test_text_truth_and_empty_feature(spark):
    rows = [("yes" if i % 2 else "no", "no" if i % 3 else "yes", float(i % 2) + i / 1000, None) for i in range(60)]
    df = spark.createDataFrame(rows, "y string, p string, a double, b double")
    spec = AuditSpec("p", "y")
    metrics = {(r["attribute"], r["metric"]): r["value"] for r in explain.explain_metrics(df, spec, importance="forest").collect()}
    assert metrics["a", "feature_importance"] > 0.9 and metrics["b", "feature_importance"] == 0
    assert not [k for k in metrics if k[1] == "target_correlation"]
    plain = explain.explain_metrics(df, spec).where("metric = 'feature_importance'")
    assert plain.collect() == []


def test_no_column_is_cut_off(spark):
    df = spark.range(50).select(*[(F.col("id").cast("double") * (i + 1)).alias(f"c{i}") for i in range(9)])
    assert charts.column_boxes(df).count() == 9
    assert charts.feature_histograms(df).select("column").distinct().count() == 9
    facts = {r["column"]: r["distinct"] for r in roles.column_facts(df).collect()}
    assert set(facts.values()) == {50}


def test_correlation_plan_does_not_grow_with_the_pairs(spark):
    wide = spark.range(30).select(*[((F.col("id") * F.col("id") * (i + 1)) % 17).cast("double").alias(f"c{i}") for i in range(60)])
    found = quality.correlations(wide)
    assert found.count() == 60 * 59 // 2
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Range (") == 1 and len(plan) < 40_000
    some = wide.select(*wide.columns[:14]).withColumns({"y": F.lit(1), "p": F.lit(1)})
    metrics = {r["metric"]: r["value"] for r in quality.quality_metrics(some, AuditSpec("p", "y")).collect() if r["attribute"] is None}
    assert metrics["numeric_columns"] == 16 and metrics["total_columns"] == 16 and metrics["completeness_rate"] == 1
