"""Keyed surrogate trees against plain Python and the library's forest."""

import random

import pytest
from pyspark.sql import functions as F

from predaudit.operators import explain as E
from predaudit.operators import surrogate as S
from predaudit.spec import BINARY, REGRESSION, AuditSpec

NAMES = ["a", "b", "c"]


def _rows(n, keys, seed=1):
    rng, rows = random.Random(seed), []
    for i in range(n):
        a, b, c = rng.randrange(10), rng.randrange(6), rng.randrange(8)
        k = keys[i % len(keys)]
        y = (a > 5) + 0.5 * (b > 2) if k != keys[0] else (c > 3) + 0.3 * (a > 2)
        rows.append((k, round(y + rng.random() / 10, 6), float(a), float(b), float(c)))
    return rows


def _gini(labels):
    n = len(labels)
    return n - sum(labels.count(x) ** 2 for x in set(labels)) / n if n else 0.0


def _squares(ys):
    return sum((y - sum(ys) / len(ys)) ** 2 for y in ys) if ys else 0.0


def _tree(rows, impurity, depth, node=1):
    """Splits ``{node: (feature, value, gain)}`` of a greedy tree; rows are (y, a, b, c)."""
    if not depth:
        return {}
    best = None
    for f in range(3):
        for cut in sorted({r[f + 1] for r in rows})[:-1]:
            left, right = [r[0] for r in rows if r[f + 1] <= cut], [r[0] for r in rows if r[f + 1] > cut]
            gain = impurity([r[0] for r in rows]) - impurity(left) - impurity(right)
            if best is None or gain > best[2] + 1e-9:
                best = (f, cut, gain)
    if best is None or best[2] < 1e-9:
        return {}
    f, cut, _ = best
    out = {node: best}
    out |= _tree([r for r in rows if r[f + 1] <= cut], impurity, depth - 1, 2 * node)
    return out | _tree([r for r in rows if r[f + 1] > cut], impurity, depth - 1, 2 * node + 1)


@pytest.mark.parametrize("problem", [REGRESSION, BINARY])
@pytest.mark.parametrize("dense", [S.DENSE, 0])
def test_single_trees_of_all_keys_equal_plain_python(spark, monkeypatch, problem, dense):
    monkeypatch.setattr(S, "DENSE", dense)
    keys = ["x", None, "z"]
    rows = _rows(900, keys)
    if problem == BINARY:
        rows = [(k, float(int(y * 2)), *x) for k, y, *x in rows]
    frame = spark.createDataFrame(rows, "k string, _target double, a double, b double, c double").repartition(5)
    splits, names = S.forest_splits(frame, NAMES, problem, ["k"], trees=1, depth=3, bins=100)
    key = {r["key"]: r["k"] for r in names.collect()}
    got = {k: {} for k in keys}
    for r in splits.collect():
        got[key[r["key"]]][r["node"]] = r
    for k in keys:
        mine = [r[1:] for r in rows if r[0] == k]
        want = _tree(mine, _squares if problem == REGRESSION else _gini, 3)
        assert got[k].keys() == want.keys()
        for node, (f, cut, gain) in want.items():
            r = got[k][node]
            values = sorted({x[f + 1] for x in mine})
            assert (r["feature"], values[r["bin"]]) == (f, cut) and r["gain"] == pytest.approx(gain, abs=1e-6)


def test_importances_of_a_thousand_keys_in_a_fixed_number_of_passes(spark, monkeypatch):
    passes = []
    monkeypatch.setattr(S, "store", lambda df, name, whole=S.store: passes.append(name) or whole(df, name))
    df = spark.range(60_000).select(
        (F.col("id") % 1000).alias("k"), *[(F.xxhash64("id", F.lit(i)) % 20).cast("double").alias(c) for i, c in enumerate(NAMES)]
    )
    signal = F.when(F.col("k") % 2 == 0, F.col("a")).otherwise(F.col("b"))
    frame = df.withColumn("_target", signal * signal + F.col("c") / 100)
    rows = S.surrogate_importance(frame, NAMES, REGRESSION, ["k"], trees=12, depth=2).collect()
    assert len(rows) == 3000 and len(passes) == 2 + 2  # rows, keys, levels
    found = {(r["k"], r["feature"]): r["importance"] for r in rows}
    right = sum(found[k, "b" if k % 2 else "a"] == max(found[k, f] for f in NAMES) for k in range(1000))
    assert right > 850, right
    assert all(sum(found[k, f] for f in NAMES) == pytest.approx(1) for k in range(1000))


def test_groups_of_keys_give_the_same_trees(spark, monkeypatch):
    frame = spark.createDataFrame(_rows(400, ["x", "y", None, "z"]), "k string, _target double, a double, b double, c double")
    whole = sorted(map(tuple, S.surrogate_importance(frame, NAMES, REGRESSION, ["k"], trees=4, depth=3).collect()), key=str)
    monkeypatch.setattr(S, "MODEL_SPLITS", 40)
    assert sorted(map(tuple, S.surrogate_importance(frame.repartition(6), NAMES, REGRESSION, ["k"], trees=4, depth=3).collect()), key=str) == [
        (k, f, pytest.approx(v)) for k, f, v in whole
    ]


def test_ranks_features_as_the_library_does(spark):
    rng = random.Random(8)
    rows = []
    for _ in range(1500):
        x = [rng.random() for _ in range(4)]
        rows.append((3 * x[0] + x[1] + 0.3 * x[2] + 0.01 * rng.random(), *x))
    frame = spark.createDataFrame(rows, "_target double, a double, b double, c double, d double")
    names = ["a", "b", "c", "d"]

    def ranking(table):
        return [r["feature"] for r in table.orderBy(F.desc("importance")).collect()][:3]

    assert ranking(S.surrogate_importance(frame, names, REGRESSION)) == ranking(E.forest_importance(frame, names, REGRESSION, max_depth=5)) == ["a", "b", "c"]


def test_audit_metrics_with_surrogate_importance_by_key(spark):
    rows = [(k, i, "yes" if a > 5 else "no", a, b) for k, i, (_, _, a, b, _) in ((i % 2, i, r) for i, r in enumerate(_rows(600, ["x", "y"])))]
    df = spark.createDataFrame(rows, "k int, id int, y string, a double, b double")
    spec = AuditSpec(None, "y", features=("a", "b"), identifier="id")
    metrics = E.explain_metrics(df, spec, ["k"], importance="surrogate").where("metric = 'feature_importance'").collect()
    assert {(r["k"], r["attribute"]): r["value"] > 0.8 for r in metrics} == {(k, f): f == "a" for k in (0, 1) for f in ("a", "b")}


def test_frames_without_rows_or_signal(spark):
    empty = spark.createDataFrame([], "k int, _target double, a double")
    assert S.surrogate_importance(empty, ["a"], REGRESSION, ["k"]).collect() == []
    flat = spark.createDataFrame([(1, 2.0, None), (1, 2.0, None)], "k int, _target double, a double")
    assert [tuple(r) for r in S.surrogate_importance(flat, ["a"], REGRESSION, ["k"]).collect()] == [(1, "a", 0.0)]
