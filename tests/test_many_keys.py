"""Keyed statistics give the same rows whether quartiles are broadcast or, as with very many keys, values are summed up between marks."""

import random

import pytest

from predaudit.functions import keys
from predaudit.operators import quality as Q
from predaudit.operators import regression as R
from predaudit.spec import REGRESSION, AuditSpec

SPEC = AuditSpec("p", "y", problem=REGRESSION)


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(12)
    data = [("hot", rng.choice([1.0, 2.0, rng.gauss(0, 3)]), rng.gauss(0, 3)) for _ in range(1800)]  # one key with nine tenths of the rows
    data += [(k, 4.0 if k == "flat" else round(rng.expovariate(1), 1), rng.random()) for k in ("flat", None, "x") for _ in range(60)]
    data += [("one", 1.0, 2.0), ("x", None, 1.0)]
    return spark.createDataFrame(data, "k string, y double, p double").repartition(5)


def _table(df, *ids):
    return {tuple(r[i] for i in ids): {c: r[c] for c in df.columns if c not in ids} for r in df.collect()}


@pytest.mark.parametrize(
    "run,ids",
    [
        (lambda df, by: R.residual_outliers(df, SPEC, by), []),
        (lambda df, by: R.error_bands(df, SPEC, by), []),
        (lambda df, by: R.quartile_performance(df, SPEC, by), ["bin"]),
        (lambda df, by: Q.iqr_outliers(df, by, ["y", "p"]), ["column"]),
    ],
)
def test_marks_equal_broadcast(rows, monkeypatch, run, ids):
    few = _table(run(rows, ["k"]), "k", *ids)
    monkeypatch.setattr(keys, "FEW_KEYS", 0)
    many = _table(run(rows, ["k"]), "k", *ids)
    assert many.keys() == few.keys() and len(few) >= 5
    for key, row in few.items():
        assert many[key] == pytest.approx(row, nan_ok=True), key
    alone = _table(run(rows.where("k = 'hot'").drop("k"), []), *ids)
    assert {("hot", *key): pytest.approx(row) for key, row in alone.items()} == {key: row for key, row in few.items() if key[0] == "hot"}


def test_outliers_from_a_sketch(rows):
    exact, sketch = (_table(Q.iqr_outliers(rows, ["k"], ["y", "p"], accuracy=a), "k", "column") for a in (None, 10_000))
    assert exact.keys() == sketch.keys()
    assert all(abs(exact[k]["q1"] - sketch[k]["q1"]) < 0.2 and exact[k]["n"] == sketch[k]["n"] for k in exact)


def test_outliers_of_few_keys_count_no_values(rows, monkeypatch):
    exact = _table(Q.iqr_outliers(rows, ["k"], ["y", "p"]), "k", "column")

    def refused(*_):
        raise AssertionError("values of all cells were counted")

    monkeypatch.setattr(Q, "value_table", refused)
    assert _table(Q.iqr_outliers(rows, ["k"], ["y", "p"]), "k", "column") == exact
    monkeypatch.setattr(Q, "CHUNK_COLUMNS", 1)
    assert _table(Q.iqr_outliers(rows, ["k"], ["y", "p"]), "k", "column") == exact
