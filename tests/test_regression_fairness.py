import pytest
from conftest import metrics
from pyspark.sql import functions as F

from predaudit.operators import fairness as B
from predaudit.operators import regression as R
from predaudit.spec import MULTICLASS, REGRESSION, AuditSpec

SPEC = AuditSpec("p", "y", problem=REGRESSION)
CLASS = AuditSpec("p", "y", "s", protected=("g",))


def test_hand_worked_regression(h2):
    found = {m: v for (_, m), v in metrics(R.performance(h2, SPEC)).items()}
    wanted = {
        "r2_score": -2.2,
        "mean_squared_error": 4,
        "root_mean_squared_error": 2,
        "mean_absolute_error": 1,
        "mean_absolute_percentage_error": 0.25,
        "explained_variance_score": -1.4,
        "residual_mean": -1,
        "residual_std": 1.7320508,
        "relative_mae": 0.4,
        "max_error": 4,
    }
    assert {k: found[k] for k in wanted} == pytest.approx(wanted)


def test_closed_quartile_bins(spark):
    df = spark.createDataFrame([(float(i), float(i)) for i in range(1, 6)], "y double, p double")
    counts = {r["bin"]: r["sample_count"] for r in R.quartile_performance(df, SPEC).collect()}
    assert counts == {f"quartile_{i}": 2 for i in range(1, 5)}


def test_constant_truth(spark):
    same = spark.createDataFrame([(1.0, 1.0), (1.0, 1.0)], "y double, p double")
    found = metrics(R.performance(same, SPEC))
    assert found[None, "r2_score"] == 1.0 and (None, "pearson_correlation") not in found
    off = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0)], "y double, p double")
    assert metrics(R.performance(off, SPEC))[None, "r2_score"] == 0.0


def test_empty_regression_says_so(h2):
    row = R.regression_metrics(h2.where("false"), SPEC).first()
    assert row["n"] == 0 and row["r2_score"] is None


def test_outliers_bands_and_normality(h2):
    row = R.residual_outliers(h2, SPEC).first()
    assert (row["q25"], row["q75"], row["outlier_count"], row["outlier_percentage"]) == (-1.0, 0.0, 1, 25.0)
    bands = R.error_bands(h2, SPEC).first()
    assert tuple(bands) == (0.75, 0.75, 1.0)
    jb = R.jarque_bera(h2, SPEC).first()
    assert jb["statistic"] == pytest.approx(4 / 6 * (1.1547005383792515**2 + (2 / 3) ** 2 / 4))
    assert R.ks_normality(h2, SPEC).first()["p_value"] is None  # too few residuals


def test_qq_points_use_normal_quantiles(h2):
    points = {round(r["prob"], 3): (r["theoretical"], r["sample"]) for r in R.qq_points(h2, SPEC, points=3).collect()}
    assert points[0.5] == pytest.approx((0.0, 0.0)) and points[0.25][0] == pytest.approx(-0.6744897)


def test_hand_worked_fairness(h1):
    found = metrics(B.fairness_metrics(h1, CLASS))
    wanted = {
        ("g", "disparate_impact_ratio"): 4 / 9,
        ("g", "demographic_parity_diff"): 5 / 12,
        ("g", "tpr_difference"): 0.5,
        ("g", "fpr_difference"): 0.5,
        ("g", "accuracy_difference"): 1 / 12,
        (None, "overall_bias_score"): 0.4111111,
    }
    assert found == pytest.approx(wanted)


def test_null_group_is_optional(h1):
    groups = B.group_metrics(h1, CLASS.with_(null_group=True)).collect()
    assert {r["group"] for r in groups} == {"A", "B", "null"}
    assert {r["group"] for r in B.group_metrics(h1, CLASS).collect()} == {"A", "B"}


def test_single_group_has_no_bias(h1):
    found = metrics(B.fairness_metrics(h1.where("g = 'A'"), CLASS))
    assert found == {(None, "overall_bias_score"): 0.0}


def test_missing_attributes(h1):
    with pytest.raises(ValueError):
        B.group_metrics(h1, CLASS.with_(protected=("nope",)))
    assert B.present_attributes(h1, CLASS.with_(protected=("nope", "g"))) == ["g"]


def test_multiclass_rate_is_mean_code_unless_two_labels(spark):
    rows = [(0, 0, "a"), (1, 2, "a"), (2, 1, "b"), (1, 1, "b")]
    df = spark.createDataFrame(rows, "y int, p int, g string")
    spec = AuditSpec("p", "y", protected=("g",), problem=MULTICLASS)
    rates = {r["group"]: r["positive_rate"] for r in B.group_metrics(df, spec).collect()}
    assert rates == {"a": 1.0, "b": 1.0}
    two = df.where("p in (1, 2)")
    rates = {r["group"]: r["positive_rate"] for r in B.group_metrics(two, spec).collect()}
    assert rates == {"a": 0.0, "b": 1.0}


def test_intersections(h1):
    df = h1.withColumn("h", F.when(F.col("s") > 0.5, "hi").otherwise("lo"))
    spec = CLASS.with_(protected=("g", "h"))
    cells = {(r["g"], r["h"], r["level"]): r["n"] for r in B.intersectional(df, spec).collect()}
    assert cells[None, None, 0] == 7 and cells["A", None, 1] == 4 and cells["B", "lo", 2] == 2
    pairs = B.intersectional(df, spec, cube=False)
    assert pairs.count() == 4
    everything = B.intersectional(df, spec.with_(null_group=True)).where("level = 0").first()
    assert everything["n"] == 8


def test_regression_groups_and_boxes(spark):
    rows = [(1.0, 1.0, "a"), (2.0, 2.0, "a"), (3.0, 3.0, "b"), (4.0, 8.0, "b")]
    df = spark.createDataFrame(rows, "y double, p double, g string")
    spec = AuditSpec("p", "y", protected=("g",), problem=REGRESSION)
    groups = {r["group"]: r for r in B.group_statistics(df, spec).collect()}
    assert groups["b"]["mae"] == 2.0 and groups["b"]["r2"] == -31.0 and groups["a"]["median_prediction"] == 1.5
    assert metrics(B.fairness_metrics(df, spec))[None, "overall_bias_score"] == 1.0
    scaled = metrics(B.fairness_metrics(df, spec, normalised=True))
    assert scaled["g", "mae_difference"] == pytest.approx(2.0 / 2.5)
    boxes = {r["group"]: r for r in B.group_boxes(df, spec).collect()}
    assert (boxes["b"]["min"], boxes["b"]["median"], boxes["b"]["outliers"]) == (3.0, 5.5, 0)
