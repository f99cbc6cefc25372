import json
import math

import pytest
from conftest import metrics
from pyspark.sql import functions as F

from predaudit.plans import report as P
from predaudit.plans import rules
from predaudit.sources import load as L
from predaudit.sources import sinks as S
from predaudit.spec import REGRESSION, AuditSpec
from predaudit.streaming import monitor as M

SPEC = AuditSpec("p", "y", "s", protected=("g",), features=("x",))


@pytest.fixture(scope="module")
def scored(spark):
    return spark.range(300).select(
        (F.col("id") % 2).cast("int").alias("y"),
        F.when(F.col("id") % 5 == 0, 1 - F.col("id") % 2).otherwise(F.col("id") % 2).cast("int").alias("p"),
        ((F.col("id") % 2) * 0.5 + (F.col("id") % 7) / 20.0).alias("s"),
        F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("g"),
        (F.col("id") % 2 + (F.col("id") % 3) / 4.0).alias("x"),
        F.when(F.col("id") < 150, "m1").otherwise("m2").alias("model"),
    )


@pytest.fixture(scope="module")
def audited(scored):
    return P.audit(scored, SPEC, ["model"])


def test_overall_score_is_the_weighted_mean(audited):
    parts = audited.metrics.where("model = 'm1'")
    found = metrics(parts.where("`group` is null"))
    wanted = (
        0.4 * found[None, "accuracy"]
        + 0.3 * (1 - found[None, "overall_bias_score"])
        + 0.2 * found[None, "confidence_score"]
        + 0.1 * found[None, "feature_diversity"]
    )
    assert audited.scores.where("model = 'm1'").first()["overall_score"] == pytest.approx(wanted)


def test_one_key_equals_its_subset(scored, audited):
    alone = P.audit(scored.where("model = 'm2'").drop("model"), SPEC)
    mine = audited.metrics.where("model = 'm2'")
    assert metrics(mine) == pytest.approx(metrics(alone.metrics))
    keep = ["analysis", "kind", "rule", "tag", "text"]
    left = audited.findings.where("model = 'm2'").select(*keep).collect()
    assert sorted(left) == sorted(alone.findings.select(*keep).collect())


def test_findings_are_capped_and_ordered(audited):
    for r in audited.insights.groupBy("model").agg(F.count("*").alias("n"), F.min("rank").alias("first")).collect():
        assert r["n"] <= 6 and r["first"] == 1
    first = audited.insights.where("rank = 1").select("analysis").distinct().collect()
    assert [r["analysis"] for r in first] == ["overall"]
    assert audited.recommendations.groupBy("model").count().agg(F.max("count")).first()[0] <= 5


def test_missing_analyses_are_left_out(scored):
    only = P.audit(scored, SPEC.with_(protected=()), analyses=["performance", "bias"])
    assert {r["analysis"] for r in only.metrics.select("analysis").distinct().collect()} == {"performance"}
    accuracy = metrics(only.metrics)[None, "accuracy"]
    assert only.scores.first()["overall_score"] == pytest.approx(accuracy)
    with pytest.raises(ValueError):
        P.audit(scored, SPEC, analyses=["drift"])


def test_rules_fire_by_threshold(spark):
    rows = [
        ("performance", None, "accuracy", 0.45),
        ("performance", None, "precision", 0.9),
        ("performance", None, "recall", 0.5),
        ("bias", "g", "disparate_impact_ratio", 0.5),
        ("bias", "g", "tpr_difference", 0.2),
        ("bias", None, "overall_bias_score", 0.35),
        ("quality", None, "missing_percentage", 30.0),
    ]
    df = spark.createDataFrame(rows, "analysis string, attribute string, metric string, value double")
    df = df.withColumn("group", F.lit(None).cast("string"))
    found = {(r["kind"], r["rule"]): r["tag"] for r in rules.findings(df, AuditSpec("p", "y", protected=("g",))).collect()}
    assert found["insight", "accuracy_low"] == rules.WARN
    assert ("insight", "conservative") in found and ("insight", "accuracy_moderate") not in found
    assert found["insight", "disparate_impact"] == rules.CRITICAL
    assert found["insight", "bias_high"] == rules.CRITICAL
    assert ("recommendation", "mitigate_bias") in found and ("recommendation", "equalise_odds") in found
    assert found["insight", "missing_high"] == rules.CRITICAL
    assert found["recommendation", "impute"] == rules.FIX
    assert not [k for k in found if k[1] == "fairness_good"]


def test_regression_without_truth(spark):
    df = spark.range(50).select(F.col("id").cast("double").alias("p"))
    audit = P.audit(df, AuditSpec("p", problem=REGRESSION))
    found = metrics(audit.metrics)
    assert found[None, "prediction_median"] == 24.5
    assert {"no_truth", "needs_truth"} <= {r["rule"] for r in audit.findings.collect()}


def test_report_and_sinks(spark, audited, tmp_path):
    row = audited.report.where("model = 'm1'").first()
    assert row["sample_size"] == 150 and row["feature_count"] == 5
    assert "accuracy" in row["performance_metrics"] and "g_tpr_difference" in row["bias_metrics"]
    S.write_report(audited, str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).count() == 2
    S.write_report(audited, str(tmp_path / "flat"), "csv")
    flat = spark.read.csv(str(tmp_path / "flat"), header=True, inferSchema=True)
    assert flat.count() == 2 and "performance_accuracy" in flat.columns
    assert "bias_g_disparate_impact_ratio" in flat.columns and "explainability_feature_importance_x" in flat.columns
    for fmt in ("json", "csv", "parquet"):
        S.write_metrics(audited.metrics, str(tmp_path / fmt), fmt)
    assert spark.read.parquet(str(tmp_path / "parquet")).count() == audited.metrics.count()
    with pytest.raises(ValueError):
        S.write_metrics(audited.metrics, str(tmp_path / "x"), "xml")
    document = json.loads(S.report_json(audited.report, ["model"]).first()["report"])
    assert document["problem_type"] == "binary"
    summary = P.quick_summary(audited.report, SPEC, ["model"]).first()
    assert len(summary["key_insights"]) <= 3 and summary["accuracy"] == round(summary["accuracy"], 3)
    names = {r["name"] for r in S.flatten_maps(audited.report, ["model"]).collect()}
    assert "performance_metrics_accuracy" in names


def test_flatten_structs(spark):
    df = spark.range(1).select(F.struct(F.lit(1).alias("b"), F.struct(F.lit(2).alias("d")).alias("c")).alias("a"))
    assert S.flatten(df).columns == ["a_b", "a_c_d"]


def test_load_formats_and_prepare(spark, tmp_path):
    (tmp_path / "a.csv").write_text("p,y,t\n1,x,2024-01-01\n0,3,2024-01-02\n")
    (tmp_path / "a.tsv").write_text("p\ty\n1\t2\n")
    (tmp_path / "a.json").write_text('[{"p": "1", "y": 2}, {"p": "0", "y": null}]')
    (tmp_path / "a.jsonl").write_text('{"p": 1}\n{"p": 0}\n')
    csv = L.load(spark, str(tmp_path / "a.csv"), schema="p string, y string, t string")
    assert csv.count() == 2
    assert L.load(spark, str(tmp_path / "a.tsv")).first()["y"] == 2
    records = L.load(spark, str(tmp_path / "a.json"))
    assert records.count() == 2 and L.load(spark, str(tmp_path / "a.jsonl")).count() == 2
    with pytest.raises(ValueError):
        L.file_format("x.bin")
    ready = L.prepare(csv, AuditSpec("p", "y", timestamp="t"))
    assert ready.dtypes["p"] == "double" and ready.dtypes["y"] == "string" and ready.dtypes["t"] == "timestamp"
    assert ready.has_temporal_data and not ready.timestamp_conversion_failed
    broken = L.prepare(csv, AuditSpec("p", timestamp="y"))
    assert broken.timestamp_conversion_failed and broken.dtypes["y"] == "string"
    assert [tuple(r) for r in L.prepare(records, AuditSpec("p", "y")).missing.collect()] == [("y", 1, 50.0)]
    assert L.preview(csv, 1).count() == 1


@pytest.fixture(scope="module")
def timed(spark):
    return spark.range(2000).select(
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 300).alias("ts"),
        (F.col("id") % 2).cast("int").alias("y"),
        (F.col("id") % 3 % 2).cast("int").alias("p"),
        F.col("id").cast("double").alias("v"),
    )


TIMED = AuditSpec("p", "y", timestamp="ts")


def test_stream_equals_batch(spark, timed, tmp_path):
    timed.orderBy("ts").repartitionByRange(4, "ts").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(timed.schema).parquet(str(tmp_path / "in"))
    live = M.windowed_metrics(stream, TIMED, watermark="1 hour")
    query = M.write_windows(live, str(tmp_path / "out"), str(tmp_path / "checkpoint"), once=True)
    query.awaitTermination()
    assert query.exception() is None
    streamed = {r["window_start"]: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = {r["window_start"]: r for r in M.windowed_metrics(timed, TIMED).collect()}
    closed = sorted(batch)[:-1]  # the last window stays open until the watermark passes it
    assert closed and {k: streamed[k] for k in closed} == {k: batch[k] for k in closed}


def test_sliding_and_session_windows(timed):
    sliding = M.windowed_metrics(timed, TIMED, every="1 day", slide="12 hours")
    assert sliding.agg(F.sum("n")).first()[0] == 2 * 2000
    assert M.windowed_metrics(timed, TIMED, session_gap="10 minutes").first()["n"] == 2000
    spec = AuditSpec("p", "y", timestamp="ts", problem=REGRESSION)
    assert M.windowed_metrics(timed, spec).agg(F.sum("n")).first()[0] == 2000


def test_drift_is_zero_for_equal_halves_and_large_for_shifted(timed):
    same = M.population_stability(timed, F.col("v") % 2 == 0, ["p"]).first()["psi"]
    moved = M.population_stability(timed, F.col("v") >= 1000, ["v"]).first()["psi"]
    assert same < 0.01 and moved > 1 and not math.isnan(moved)
