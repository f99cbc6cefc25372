"""Moments of pairs by matrix products against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from predaudit.functions import gram
from predaudit.functions.gram import merged, pair_correlations, pair_moments, product_correlations, product_moments

NAN = float("nan")


def _columns(df, names):
    return {c: F.col(c) for c in names}


def _table(n=400):
    random = np.random.RandomState(3)
    x = random.normal(size=(n, 5))
    x[:, 1] = 1e9 + x[:, 0] + 0.5 * x[:, 1]  # a large mean
    x[:, 2] = 0.1  # constant
    x[random.rand(n) < 0.3, 3] = NAN
    x[:, 4] = np.where(random.rand(n) < 0.5, NAN, x[:, 3] * 2 + random.normal(size=n))
    return x


def _frame(spark, x, keys=None):
    rows = [(keys[i] if keys else 0, *[None if v != v else float(v) for v in row]) for i, row in enumerate(x)]
    return spark.createDataFrame(rows, "k int, " + ", ".join(f"c{i} double" for i in range(x.shape[1]))).repartition(7)


def _want(x):
    out = {}
    for i in range(x.shape[1]):
        for j in range(i + 1, x.shape[1]):
            both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            a, b = x[both, i], x[both, j]
            out[i, j] = (both.sum(), np.corrcoef(a, b)[0, 1] if both.sum() > 1 and a.std() > 1e-12 and b.std() > 1e-12 else None)
    return out


def _same(got, want):
    assert got.keys() == want.keys()
    for pair, (n, c) in want.items():
        assert got[pair][0] == n and (got[pair][1] is None) == (c is None), pair
        if c is not None:
            assert got[pair][1] == pytest.approx(c, abs=1e-7)


def test_pairs_with_gaps_constants_and_large_means(spark):
    x = _table()
    rows = pair_correlations(_frame(spark, x), _columns(None, [f"c{i}" for i in range(5)])).collect()
    _same({(r["i"], r["j"]): (r["n"], r["corr"]) for r in rows}, _want(x))


@pytest.mark.parametrize("held", [gram.HELD, 1])  # 1: handed on after every batch
def test_pairs_by_key_with_a_null_key(spark, monkeypatch, held):
    monkeypatch.setattr(gram, "HELD", held)
    x, keys = _table(), [None if i % 3 == 0 else i % 3 for i in range(400)]
    rows = pair_correlations(_frame(spark, x, keys), _columns(None, [f"c{i}" for i in range(5)]), ["k"]).collect()
    for key in (None, 1, 2):
        mine = np.array([k == key for k in keys])
        _same({(r["i"], r["j"]): (r["n"], r["corr"]) for r in rows if r["k"] == key}, _want(x[mine]))


def test_moments_merge_as_if_they_were_one():
    x = _table()
    for function, y in ((pair_moments, None), (product_moments, np.arange(400.0))):
        whole = function(x, y)
        parts = merged(function(x[:150], None if y is None else y[:150]), function(x[150:], None if y is None else y[150:]))
        for a, b in zip(whole, parts):
            np.testing.assert_allclose(a, b, rtol=1e-6, atol=1e-6 * np.nanmax(np.abs(a)))


def test_products_with_a_target(spark):
    x = _table()[:, [0, 3, 4, 2]] + np.array([1000.0, 5.0, 0.0, 0.0])
    y = np.where(np.isnan(x[:, 1]), 0.0, x[:, 1]) * x[:, 0] + np.arange(400) / 100
    df = _frame(spark, np.column_stack([x, y]))
    got = {(r["i"], r["j"]): r["corr"] for r in product_correlations(df, ["c0", "c1", "c2", "c3"], "c4").collect()}
    full = np.column_stack([x, np.ones(400)])
    for i in range(4):
        for j in range(i + 1, 5):
            p = full[:, i] * full[:, j]
            both = ~np.isnan(p)
            if p[both].std() < 1e-12:
                assert got[i, j] is None
            else:
                assert got[i, j] == pytest.approx(np.corrcoef(p[both], y[both])[0, 1], abs=1e-9)


def test_infinite_values_spoil_only_their_pairs_and_empty_tables_have_none(spark):
    rows = [(0, 1.0, 1.0, 2.0), (0, 2.0, float("inf"), 1.0), (0, 3.0, 2.0, 5.0), (0, 4.0, None, 4.0)]
    df = spark.createDataFrame(rows, "k int, c0 double, c1 double, c2 double")
    got = {(r["i"], r["j"]): r["corr"] for r in pair_correlations(df, _columns(df, ["c0", "c1", "c2"])).collect()}
    assert got[0, 1] is None and got[1, 2] is None and got[0, 2] == pytest.approx(np.corrcoef([1, 2, 3, 4], [2, 1, 5, 4])[0, 1])
    assert pair_correlations(df.where("k > 0"), _columns(df, ["c0", "c1"])).collect() == []
    nothing = spark.createDataFrame([(1, 1.0, None), (1, 2.0, None)], "k int, c0 double, c1 double")
    assert [(r["n"], r["corr"]) for r in pair_correlations(nothing, _columns(None, ["c0", "c1"]), ["k"]).collect()] == [(0, None)]
