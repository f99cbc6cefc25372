import pytest
from conftest import metrics
from pyspark.sql import functions as F

from predaudit.functions.values import few_values
from predaudit.operators import charts
from predaudit.operators import quality as Q
from predaudit.operators import validation as V
from predaudit.spec import AuditSpec


@pytest.fixture(scope="module")
def h4(spark):
    return spark.createDataFrame([(1, "x"), (1, "x"), (2, "X"), (None, None)], "a int, b string")


def test_hand_worked_quality(h4):
    row = Q.completeness(h4).first()
    assert row["completeness_rate"] == 0.75 and row["percentage_rows_with_missing"] == 25.0
    assert row["percentage_columns_with_missing"] == 100.0
    for digest in (False, True):
        copies = Q.duplicates(h4, digest=digest).first()
        assert (copies["duplicate_rows"], copies["duplicate_percentage"]) == (1, 25.0)
    assert Q.consistency(h4).first()["consistency"] == 1.0


def test_mixed_case_costs_consistency(spark):
    df = spark.createDataFrame([("x",), ("x",), ("X",), ("x",), ("x",), ("y",), ("y",)], "b string")
    assert Q.consistency(df).first()["consistency"] == pytest.approx(0.9)


def test_profile_ties_and_big_integers(spark):
    big = 2**53
    df = spark.createDataFrame([(big, "b", 1.0), (big + 1, "a", float("nan")), (None, None, 1.0)], "i long, t string, d double")
    rows = {r["column"]: r for r in Q.column_profile(df).collect()}
    assert rows["i"]["unique_values"] == 2 and rows["i"]["most_frequent"] == str(big)
    assert rows["t"]["most_frequent"] == "a" and rows["t"]["mean"] is None
    assert rows["d"]["missing_count"] == 1 and rows["d"]["unique_values"] == 1 and rows["d"]["skewness"] is None


def test_nested_columns_are_only_null_counted(spark):
    df = spark.createDataFrame([([1], 1), (None, 2)], "v array<int>, i int")
    rows = {r["column"]: r for r in Q.column_profile(df).collect()}
    assert rows["v"]["missing_count"] == 1 and rows["v"]["unique_values"] == 0
    assert Q.duplicates(df).first()["duplicate_rows"] == 0


def test_quality_metrics_agree_with_the_single_operators(spark):
    df = spark.range(500).select(
        (F.col("id") % 7).cast("double").alias("p"),
        (F.col("id") % 3).cast("int").alias("y"),
        F.when(F.col("id") % 10 > 0, F.col("id") * F.col("id")).alias("sq"),
        F.lit(1.0).alias("one"),
        F.concat(F.lit("t"), F.col("id") % 2).alias("t"),
    )
    spec = AuditSpec("p", "y")
    found = metrics(Q.quality_metrics(df, spec))
    outliers = Q.outlier_summary(Q.iqr_outliers(df)).first()
    assert found[None, "outlier_percentage"] == pytest.approx(outliers["outlier_percentage"])
    vector = Q.vector_quality(df, "p").first()
    assert found[None, "prediction_diversity"] == vector["diversity"]
    assert found[None, "class_balance_ratio"] == Q.class_balance(df, "y").first()["class_balance_ratio"]
    high = Q.correlations(df).where("abs(corr) > 0.95").count()
    assert found[None, "highly_correlated_features"] == high
    assert found["one", "zero_variance"] == 1.0
    by = {r["t"]: r["value"] for r in Q.quality_metrics(df, spec, ["t"]).where("metric = 'completeness_rate'").collect()}
    for t in ("t0", "t1"):
        alone = metrics(Q.quality_metrics(df.where(F.col("t") == t).drop("t"), spec))
        assert by[t] == pytest.approx(alone[None, "completeness_rate"])


def test_broken_predictions(spark):
    rows = [(float("nan"), 1), (float("inf"), 0), (float("-inf"), 1), (0.5, 0), (None, 1)]
    df = spark.createDataFrame(rows, "p double, y int")
    spec = AuditSpec("p", "y")
    row = Q.vector_quality(df, "p").first()
    assert (row["missing"], row["infinite"]) == (2, 2)
    assert Q.validity(df, spec).first()["validity"] == pytest.approx(0.7)
    found = metrics(Q.quality_metrics(df.select("p", "y"), spec))
    assert found[None, "predictions_missing"] == 2 and found[None, "predictions_infinite"] == 2
    rules = {(r["rule"], r["severity"]) for r in V.validation_issues(df, spec).collect()}
    assert {("prediction_nan", "error"), ("prediction_infinite", "error"), ("sample_size", "error")} <= rules


def test_few_values_skips_high_cardinality(spark):
    df = spark.range(5000).select(F.col("id"), (F.col("id") % 4).alias("k"))
    assert few_values(df, F.col("id"), [], 20).count() == 0
    assert few_values(df, F.col("k"), [], 20).count() == 4
    assert few_values(df, F.col("id") % 21, [], 20).count() == 0


def test_validation_of_good_empty_and_constant_tables(spark):
    good = spark.range(200).select((F.col("id") % 2).alias("p"), (F.col("id") % 3 % 2).alias("y"), F.col("id").alias("x"))
    spec = AuditSpec("p", "y")
    assert V.validation_summary(V.validation_issues(good, spec)).first()["is_valid"]
    empty = {r["rule"] for r in V.validation_issues(good.where("false"), spec).collect()}
    assert {"empty_data", "sample_size"} <= empty
    constant = V.validation_issues(good.withColumn("p", F.lit(1)), spec.with_(protected=("nope",)))
    rules = {r["rule"] for r in constant.collect()}
    assert {"prediction_constant", "zero_variance", "protected_absent"} <= rules


def test_match_of_separate_predictions(spark):
    data = spark.createDataFrame([(1,), (2,), (2,), (None,)], "k int")
    scored = spark.createDataFrame([(2,), (3,)], "k int")
    assert tuple(V.prediction_match(data, scored, "k").first()) == (4, 2, 2, 1)


def test_histogram_keeps_every_row(spark):
    df = spark.range(1001).select(F.col("id").cast("double").alias("x"), F.lit(5.0).alias("c"))
    bins = charts.histogram(df, {"x": F.col("x"), "c": F.col("c")}, bins=10)
    sums = {r["column"]: (r["n"], r["b"]) for r in bins.groupBy("column").agg(F.sum("n").alias("n"), F.max("bin").alias("b")).collect()}
    assert sums == {"x": (1001, 10), "c": (1001, 1)}


def test_metric_categories_and_matrix(spark):
    rows = [("a", "accuracy", 0.5), ("a", "overall_bias_score", 0.1), ("b", "accuracy", 1.0)]
    df = spark.createDataFrame(rows, "`group` string, metric string, value double")
    kinds = {r["metric"]: r["category"] for r in charts.metric_categories(df).collect()}
    assert kinds == {"accuracy": "Performance", "overall_bias_score": "Bias"}
    matrix = {r["group"]: r for r in charts.group_matrix(df, ["accuracy", "overall_bias_score"]).collect()}
    assert matrix["b"]["overall_bias_score"] == 0.0
