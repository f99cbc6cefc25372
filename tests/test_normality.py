"""Normality tests against published values and plain Python."""

import math
import random

import pytest

from predaudit.functions.normal import fitted_ks_p_value, normal_cdf, shapiro_wilk
from predaudit.operators import regression as R
from predaudit.spec import REGRESSION, AuditSpec

SPEC = AuditSpec("p", "y", problem=REGRESSION)


def test_normal_distribution_function(spark):
    rows = spark.range(-4000, 4000).selectExpr("id / 100D as z")
    for r in rows.select("z", normal_cdf(rows["z"]).alias("p")).collect():
        assert r["p"] == pytest.approx(0.5 * math.erfc(-r["z"] / math.sqrt(2)), rel=1e-9, abs=1e-15)


# published critical values of the statistic with fitted mean and deviation: rows, statistic, level
CRITICAL = [(10, 0.262, 0.05), (20, 0.192, 0.05), (30, 0.159, 0.05), (20, 0.223, 0.01), (30, 0.187, 0.01), (400, 0.895 / 20, 0.05), (400, 1.035 / 20, 0.01)]


def test_critical_values_with_fitted_parameters(spark):
    rows = spark.createDataFrame([(n, d, level) for n, d, level in CRITICAL], "n long, d double, level double")
    for r in rows.select("n", "level", fitted_ks_p_value(rows["d"], rows["n"]).alias("p")).collect():
        assert r["p"] == pytest.approx(r["level"], rel=0.25), r


def _ks(values):
    x, n = sorted(values), len(values)
    mean = sum(x) / n
    std = math.sqrt(sum((v - mean) ** 2 for v in x) / (n - 1))
    at = [0.5 * math.erfc(-(v - mean) / std / math.sqrt(2)) for v in x]
    return max(max((i + 1) / n - f, f - i / n) for i, f in enumerate(at))


def test_ks_by_key_equals_brute_force(spark):
    rng = random.Random(4)
    data = {None: [rng.gauss(3, 2) for _ in range(300)], "ties": [float(rng.randrange(5)) for _ in range(200)], "few": [1.0, 2.0, 4.0], "flat": [2.0] * 9}
    rows = [(k, v, 0.0) for k, values in data.items() for v in values]
    got = {r["k"]: r for r in R.ks_normality(spark.createDataFrame(rows, "k string, y double, p double"), SPEC, ["k"]).collect()}
    assert got.keys() == {None, "ties", "few"}
    for k, r in got.items():
        assert r["n"] == len(data[k]) and r["statistic"] == pytest.approx(_ks(data[k]))
    assert got[None]["p_value"] > 0.05 > 0.001 > got["ties"]["p_value"] and got["few"]["p_value"] is None
    assert R.ks_normality(spark.createDataFrame([], "k string, y double, p double"), SPEC).collect() == []


def test_fitted_p_values_are_uniform_under_the_null(spark):
    rng = random.Random(9)
    rows = [(k, rng.gauss(0, 1), 0.0) for k in range(300) for _ in range(50)]
    found = [r["p_value"] for r in R.ks_normality(spark.createDataFrame(rows, "k int, y double, p double"), SPEC, ["k"]).collect()]
    assert len(found) == 300 and 0.01 < sum(p < 0.05 for p in found) / 300 < 0.1 and 0.35 < sum(p < 0.5 for p in found) / 300 < 0.65


def test_shapiro_wilk_of_published_samples():
    weights = [148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]
    assert shapiro_wilk(weights) == pytest.approx((0.78881, 0.0067038), rel=1e-4)
    rng = random.Random(2)
    normal, skewed = [rng.gauss(5, 2) for _ in range(2000)], [rng.expovariate(1) for _ in range(2000)]
    assert shapiro_wilk(normal)[0] > 0.998 and shapiro_wilk(normal)[1] > 0.05 and shapiro_wilk(skewed)[1] < 1e-10
    assert shapiro_wilk([1.0, 1.0, 1.0]) is None and shapiro_wilk([1.0, 2.0]) is None and shapiro_wilk([1.0, 2.0, 3.0])[0] == pytest.approx(1.0)


def test_shapiro_by_key_draws_the_same_bounded_sample(spark):
    rng = random.Random(6)
    rows = [(i, i % 2, rng.gauss(0, 1) if i % 2 else rng.random() ** 3, 0.0) for i in range(6000)] + [(9000, 7, 1.0, 0.0)]
    df = spark.createDataFrame(rows, "id long, k int, y double, p double")
    spec = SPEC.with_(identifier="id")
    for partitions in (1, 8):
        got = {r["k"]: r for r in R.shapiro_normality(df.repartition(partitions), spec, ["k"], rows=500).collect()}
        assert got.keys() == {0, 1} and {r["n"] for r in got.values()} == {500}
        assert got[0]["p_value"] < 1e-10 < 0.001 < got[1]["p_value"]
        first = first if partitions > 1 else got  # noqa: F821
        assert got == first
    alone = R.shapiro_normality(df.where("k = 1").drop("k"), SPEC.with_(identifier="id"), rows=500).first()
    assert alone["statistic"] == pytest.approx(got[1]["statistic"])
