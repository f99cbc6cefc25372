import pytest
from conftest import metrics
from pyspark.sql import functions as F

from predaudit.operators import explain as E
from predaudit.operators import roles as O
from predaudit.spec import BIAS, BINARY, EXPLAINABILITY, MULTICLASS, REGRESSION, AuditSpec


@pytest.fixture(scope="module")
def people(spark):
    rows = [(i % 2, (i // 2) % 2, "MF"[i % 2], 20 + i, i / 40.0, f"2024-01-{i % 28 + 1:02d}", f"k{i}") for i in range(40)]
    return spark.createDataFrame(
        rows, "prediction int, target int, gender string, years int, prob double, day string, code string"
    )


def test_roles_by_name_and_data(people):
    found = {r["column"]: (r["role"], r["confidence"]) for r in O.column_roles(people).collect()}
    assert found["prediction"] == ("prediction", 0.7)
    assert found["target"] == ("prediction", 0.7)  # two integer values score as prediction first
    assert found["gender"] == ("protected_attribute", 0.4)
    assert found["prob"] == ("probability", 0.8)
    assert found["day"] == ("timestamp", 0.9)
    assert found["code"] == ("identifier", 0.8)
    assert found["years"] == ("identifier", 0.8)


def test_name_scores(spark):
    names = [("score",), ("my_score",), ("xscorex",), ("other",), ("location",), ("data_at",)]
    df = spark.createDataFrame(names, "c string")
    scores = {r["c"]: r["s"] for r in df.select("c", O.name_score(F.col("c"), ["score"]).alias("s")).collect()}
    assert scores == {"score": 1.0, "my_score": 0.8, "xscorex": 0.6, "other": 0, "location": 0, "data_at": 0}
    whole = {r["c"]: r["s"] for r in df.select("c", O.name_score(F.col("c"), ["at"], True).alias("s")).collect()}
    assert whole["location"] == 0 and whole["data_at"] == 0.8


def test_configuration(people):
    roles = O.column_roles(people)
    config = O.smart_config(people, {"truth": "target", "protected": ["gender"]}, roles)
    row = config.first()
    assert row["prediction"] == "prediction" and row["truth"] == "target" and row["protected"] == ["gender"]
    assert row["features"] == []  # every numeric column has a role
    assert O.suggested_analyses(people, config).first()["analyses"] == [
        "quality", "performance", "bias", "explainability",
    ]
    sure = O.config_confidence(people, config, roles).first()
    assert sure["prediction_column"] == 0.7 and 0 < sure["overall"] < 1
    spec = O.to_spec(config, BINARY)
    assert spec.score == "prob" and spec.timestamp == "day"
    issues = {r["issue"] for r in O.configuration_issues(people, spec.with_(problem=REGRESSION), [BIAS]).collect()}
    assert issues == {"regression_with_few_predictions"}


@pytest.mark.parametrize(
    ("values", "mode", "wanted"),
    [
        ([0.0, 1.0, 0.0], "engine", BINARY),
        ([1.2, 2.3, 3.4, 4.5, 5.6], "engine", REGRESSION),
        ([1.2, 2.3, 3.4, 4.5, 5.6], "analyzer", MULTICLASS),
        ([1.0, 2.0, 3.0], "config", MULTICLASS),
        ([float(i) for i in range(300)], "engine", REGRESSION),
        ([float(i) for i in range(21)], "config", REGRESSION),
    ],
)
def test_problem_type(spark, values, mode, wanted):
    df = spark.createDataFrame([(v,) for v in values], "p double")
    assert O.problem_type(df, AuditSpec("p"), mode=mode).first()["problem"] == wanted


def test_truth_decides_when_predictions_are_continuous(spark):
    df = spark.createDataFrame([(0.1 * i, i % 2) for i in range(50)], "p double, y int")
    assert O.problem_type(df, AuditSpec("p", "y")).first()["problem"] == BINARY


@pytest.fixture(scope="module")
def numbers(spark):
    return spark.range(400).select(
        F.col("id").alias("key"),
        (F.col("id") % 20).cast("double").alias("a"),
        F.when(F.col("id") % 9 > 0, (F.col("id") * 7 % 11).cast("double")).alias("b"),
        F.lit(3.0).alias("flat"),
        ((F.col("id") % 20) * (F.col("id") * 7 % 11) + (F.col("id") % 20) * 5).cast("double").alias("y"),
        F.lit(0.0).alias("p"),
    )


SPEC = AuditSpec("p", "y", features=("a", "b", "flat"), identifier="key", problem=REGRESSION)


def test_correlations_against_numpy(numbers):
    import numpy as np

    frame, names = E.feature_frame(numbers, SPEC)
    pdf = numbers.toPandas()
    pdf["b"] = pdf["b"].fillna(pdf["b"].mean())
    found = {r["feature"]: r["corr"] for r in E.target_correlation(frame, names).collect()}
    assert found["flat"] == 0.0
    for c in ("a", "b"):
        assert found[c] == pytest.approx(np.corrcoef(pdf[c], pdf["y"])[0, 1])
    pairs = {(r["feature_a"], r["feature_b"]): r["strength"] for r in E.interactions(frame, names).collect()}
    best = max(abs(found["a"]), abs(found["b"]))
    assert pairs == {("a", "b"): pytest.approx(max(0, abs(np.corrcoef(pdf.a * pdf.b, pdf.y)[0, 1]) - best))}
    single = {r["feature_a"]: r["value"] for r in E.feature_effects(frame, names).where("feature_b is null").collect()}
    assert single == pytest.approx(found)


def test_all_pairs_of_many_features_and_those_of_the_best(spark):
    import numpy as np

    cols = [((F.col("id") * (i + 3)) % (i + 13)).cast("double").alias(f"f{i:02d}") for i in range(13)]
    df = spark.range(300).select((F.col("id") % 2).alias("g"), F.col("id").cast("double").alias("y"), *cols)
    spec = AuditSpec(None, "y", features=tuple(f"f{i:02d}" for i in range(13)), problem=REGRESSION)
    frame, names = E.feature_frame(df, spec, ["g"])
    by = E.interactions(frame, names, ["g"])
    assert {r["count"] for r in by.groupBy("g").count().collect()} == {66}  # one of the features is constant in either group
    pdf = df.where("g = 1").toPandas()
    names = [c for c in names if pdf[c].std() > 0]
    single = {c: abs(np.corrcoef(pdf[c], pdf.y)[0, 1]) for c in names}
    want = {
        (a, b): max(0.0, abs(np.corrcoef(pdf[a] * pdf[b], pdf.y)[0, 1]) - max(single[a], single[b]))
        for i, a in enumerate(names) for b in names[i + 1 :]
    }
    assert {(r["feature_a"], r["feature_b"]): r["strength"] for r in by.where("g = 1").collect()} == pytest.approx(want)
    best = sorted(names, key=lambda c: -single[c])[:10]
    top = {(r["feature_a"], r["feature_b"]) for r in E.interactions(frame, names, ["g"], top=10).where("g = 1").collect()}
    assert top == {(a, b) for a, b in want if a in best and b in best} and len(top) == 45
    half, every = E.feature_frame(df.where("g = 1").drop("g"), spec)
    assert {(r["feature_a"], r["feature_b"]) for r in E.interactions(half, every, top=10).collect()} == top


def test_importance_statistics(spark):
    df = spark.createDataFrame([("a", 0.6), ("b", 0.3), ("c", 0.1), ("d", 0.0)], "feature string, importance double")
    row = E.importance_statistics(df).first()
    assert row["top_3_importance_sum"] == pytest.approx(1.0) and row["importance_concentration"] == pytest.approx(1.0)
    # sorted 0, .1, .3, .6: (5 - 2 (4*0 + 3*.1 + 2*.3 + 1*.6)) / 4 = .5
    assert row["importance_gini"] == pytest.approx(0.5)
    assert row["feature_diversity"] == 0.75 and row["median_importance"] == pytest.approx(0.2)
    assert row["importance_entropy"] == pytest.approx(1.2954618)
    levels = {r["feature"]: (r["rank"], r["level"]) for r in E.feature_ranking(df).collect()}
    assert levels == {"a": (1, "high"), "b": (2, "medium"), "c": (3, "medium"), "d": (4, "low")}


def test_text_features_become_codes(spark):
    df = spark.createDataFrame([("x", 1.0), ("y", 2.0), (None, 1.5), ("x", 1.0)], "t string, y double")
    frame, names = E.feature_frame(df, AuditSpec(None, "y", problem=REGRESSION))
    assert names == ["t"] and sorted(r["t"] for r in frame.collect()) == pytest.approx([0.0, 0.0, 1 / 3, 1.0])
    nothing = df.select("y", F.col("t").alias("w"))
    empty = metrics(E.explain_metrics(nothing.drop("w").withColumn("v", F.array("y")), AuditSpec(None, "y")))
    assert empty == {(None, "no_numeric_features"): 1.0}


def test_forest_and_permutation_find_the_signal(numbers):
    frame, names = E.feature_frame(numbers, SPEC)
    forest = {r["feature"]: r["importance"] for r in E.forest_importance(frame, names, REGRESSION, trees=5).collect()}
    assert sum(forest.values()) == pytest.approx(1.0) and forest["flat"] == 0.0

    def model(rows):
        return rows.withColumn("prediction", F.col("a") * F.coalesce("b", F.lit(5.0)) + F.col("a") * 5)

    for bucket_rows in (100_000, 50):
        lost = E.permutation_importance(numbers, ["a", "b", "flat"], "y", "key", model, REGRESSION, bucket_rows=bucket_rows)
        found = {r["feature"]: r["importance"] for r in lost.collect()}
        assert found["a"] > found["b"] > 0 and found["flat"] == 0.0


def test_explanations_need_truth(numbers):
    found = metrics(E.explain_metrics(numbers, SPEC.with_(truth=None)))
    assert found == {(None, "analysis_skipped"): 1.0}
    assert EXPLAINABILITY == "explainability"
