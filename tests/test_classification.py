import math

import pytest
from conftest import metrics
from pyspark.sql import functions as F

from predaudit.operators import classification as C
from predaudit.spec import MULTICLASS, AuditSpec

SPEC = AuditSpec("p", "y", "s", protected=("g",))


def test_hand_worked_binary(h1):
    found = metrics(C.performance(h1, SPEC))
    for name in ("accuracy", "precision", "recall", "f1_score"):
        assert found[None, name] == 0.75
    assert found[None, "matthews_corr"] == pytest.approx(0.5)
    assert found[None, "cohen_kappa"] == pytest.approx(0.5)
    assert found[None, "roc_auc"] == 0.84375
    assert found[None, "log_loss"] == pytest.approx(C.log_loss(h1, SPEC).first()["log_loss"])


def test_auc_turns_around_with_the_score(h1):
    flipped = h1.withColumn("s", -F.col("s"))
    assert C.roc_auc(flipped, SPEC).first()["roc_auc"] == pytest.approx(1 - 0.84375)


def test_keys_equal_filtered_subsets(h1):
    by = {r["g"]: r["value"] for r in C.performance(h1, SPEC, ["g"]).where("metric = 'accuracy'").collect()}
    for g in ("A", "B", None):
        mine = h1.where(F.col("g").eqNullSafe(g))
        assert by[g] == metrics(C.performance(mine, SPEC))[None, "accuracy"]


def test_confusion_counts_add_up(h1):
    parts = [C.confusion_counts(h1.where(c), SPEC) for c in ("s > 0.5", "s <= 0.5")]
    both = parts[0].unionByName(parts[1]).groupBy("truth", "prediction").agg(F.sum("n").alias("n"))
    assert sorted(both.collect()) == sorted(C.confusion_counts(h1, SPEC).collect())


def test_dense_matrix_has_zero_cells(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("c", "a")], "y string, p string")
    spec = AuditSpec("p", "y", problem=MULTICLASS)
    cells = {(r["truth"], r["prediction"]): r["n"] for r in C.confusion_matrix(df, spec).collect()}
    assert len(cells) == 9 and cells["b", "b"] == 0 and cells["a", "b"] == 1
    confused = {r["label"]: r["most_confused_with"] for r in C.most_confused(df, spec).collect()}
    assert confused == {"a": "b", "c": "a"}


def test_weighted_f1_is_not_f1_of_weighted_averages(spark):
    rows = [(0, 0)] * 5 + [(0, 1)] * 3 + [(1, 1)] * 2 + [(2, 0)] * 2
    found = metrics(C.performance(spark.createDataFrame(rows, "y int, p int"), AuditSpec("p", "y", problem=MULTICLASS)))
    f1 = (8 * (10 / 15) + 2 * (4 / 7)) / 12
    assert found[None, "f1_score"] == pytest.approx(f1)
    assert found[None, "recall"] == pytest.approx(7 / 12)


def test_one_class_has_no_auc_and_zero_mcc(spark):
    df = spark.createDataFrame([(1, 1, 0.5), (1, 1, 0.7)], "y int, p int, s double")
    found = metrics(C.performance(df, SPEC))
    assert (None, "roc_auc") not in found and (None, "cohen_kappa") not in found
    assert found[None, "matthews_corr"] == 0.0 and found[None, "accuracy"] == 1.0


def test_nan_and_null_labels_are_left_out(spark):
    df = spark.createDataFrame([(1.0, 1.0), (float("nan"), 1.0), (0.0, None)], "y double, p double")
    assert C.confusion_counts(df, AuditSpec("p", "y")).collect() == [(1.0, 1.0, 1)]


def test_empty_table_has_no_metrics(h1):
    assert C.performance(h1.where("false"), SPEC).count() == 0


def test_curves_have_their_end_points(h1):
    roc = {r["threshold"]: (r["fpr"], r["tpr"]) for r in C.roc_points(h1, SPEC).collect()}
    assert roc[math.inf] == (0.0, 0.0) and roc[0.1] == (1.0, 1.0) and roc[0.4] == (0.5, 1.0)
    pr = {r["threshold"]: (r["precision"], r["recall"]) for r in C.pr_points(h1, SPEC).collect()}
    assert pr[None] == (1.0, 0.0) and pr[0.1] == (0.5, 1.0)


def test_predictions_without_truth(h1):
    found = metrics(C.performance(h1, SPEC.with_(truth=None)).where("`group` is null"))
    assert found[None, "unique_predictions"] == 2 and found[None, "most_common_prediction"] == 0
    assert found[None, "prediction_entropy"] == pytest.approx(1.0)


def test_mixed_label_types_compare_as_numbers(spark):
    df = spark.createDataFrame([(1, 1.0), (0, 1.0)], "y int, p double")
    assert metrics(C.performance(df, AuditSpec("p", "y")))[None, "accuracy"] == 0.5
