"""Exact quantiles and running totals against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from predaudit.functions import keys, ordered
from predaudit.functions.ordered import coded, column_quantiles, near_quantiles, quantiles, running_totals, segments

random.seed(7)
HARD = (
    [0.0, -0.0, 1.0, 2.0, 4.0, 8.0, 3.0, -3.0, 2.0**29, 2.0**29 + 1, 5e-324, 1e-310, 1e308, -1e308]
    + [random.uniform(-1, 1) for _ in range(300)]
    + [1e9 + random.random() for _ in range(300)]
    + [random.choice([0.5, 0.25, 7.0]) for _ in range(400)]
    + [np.nextafter(2.0**k, s) for k in range(-5, 40) for s in (-1e9, 1e9)]
    + [float(2**k) for k in range(-5, 40)]
)


@pytest.fixture(scope="module")
def counts(spark):
    rows = [(k, float(v)) for k, v in zip(["a", "b", None] * 1000, HARD)]
    return spark.createDataFrame(rows, "k string, v double").groupBy("k", "v").agg(F.count("*").alias("n"))


def test_codes_follow_the_order_of_values(counts):
    rows = sorted(coded(counts, "v").select("v", "_c1", "_c2").collect(), key=lambda r: r["v"])
    codes = [(r["_c1"], r["_c2"]) for r in rows]
    assert codes == sorted(codes)
    assert len(set(codes)) > 300


def test_infinities_take_the_ends(spark):
    df = spark.createDataFrame([(float("inf"), 1), (float("-inf"), 1), (0.0, 1), (1e308, 1)], "v double, n int")
    rows = sorted(coded(df, "v").collect(), key=lambda r: r["v"])
    assert [r["_c1"] for r in rows] == sorted(r["_c1"] for r in rows)
    assert len({r["_c1"] for r in rows}) == 4


def test_quantiles_match_brute_force(counts):
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
    found = {r["k"]: r for r in quantiles(counts, ["k"], "v", "n", probs).collect()}
    for key in ("a", "b", None):
        mine = [float(v) for k, v in zip(["a", "b", None] * 1000, HARD) if k == key]
        assert found[key]["n"] == len(mine)
        np.testing.assert_allclose(found[key]["q"], np.percentile(mine, [100 * p for p in probs]), rtol=1e-12)


def test_quantiles_without_keys_and_of_nothing(spark, counts):
    total = counts.groupBy("v").agg(F.sum("n").alias("n"))
    row = quantiles(total, [], "v", "n", [0.5]).first()
    assert row["n"] == len(HARD)
    assert row["q"][0] == pytest.approx(float(np.median(HARD)))
    assert quantiles(total.where("false"), [], "v", "n", [0.5]).count() == 0


def test_running_totals_match_brute_force(counts):
    for r in running_totals(counts, ["k"], "v", ["n"]).collect():
        mine = [float(v) for k, v in zip(["a", "b", None] * 1000, HARD) if k == r["k"]]
        assert r["n_below"] == sum(v < r["v"] for v in mine)
        assert r["n_total"] == len(mine)


def test_partition_count_does_not_change_results(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 1009).cast("double").alias("x"))
    one = column_quantiles(df.repartition(1), {"x": F.col("x")}, [], [0.1, 0.5]).first()
    many = column_quantiles(df.repartition(13), {"x": F.col("x")}, [], [0.1, 0.5]).first()
    assert one == many


def test_sketch_option_is_close(spark):
    df = spark.range(10001).select(F.col("id").cast("double").alias("x"))
    row = column_quantiles(df, {"x": F.col("x")}, [], [0.5], accuracy=10000).first()
    assert abs(row["q"][0] - 5000) <= 5


def test_segments_between_marks(counts):
    cuts = {"a": [-1.0, 0.0, 0.5, 1e9], "b": [0.25], None: [float("-inf"), 7.0, 7.0, float("inf")], "gone": [1.0]}
    marked = counts.sparkSession.createDataFrame(
        [(k, [(at, tie) for at in sorted(set(c)) for tie in (-1, 1)]) for k, c in cuts.items()], "k string, marks array<struct<at:double,tie:int>>"
    )
    got = {(r["k"], r["segment"]): r["n"] for r in segments(counts, ["k"], "v", ["n"], marked).collect()}
    want = {}
    for r in counts.collect():
        edges = sorted(set(cuts[r["k"]]))
        at = sum((r["v"] >= e) + (r["v"] > e) for e in edges)
        want[r["k"], at] = want.get((r["k"], at), 0) + r["n"]
    assert got == want


@pytest.mark.parametrize("width", [1, 5])
def test_quantiles_of_rows_match_brute_force(spark, width):
    inf = float("inf")
    rows = [(k, float(v), None if i % 3 else -float(v)) for i, (k, v) in enumerate(zip(["a", "b", None] * 1000, [*HARD, inf, -inf, inf, -inf]))]
    df = spark.createDataFrame([*rows, ("one", 4.0, None), ("none", None, None)], "k string, x double, y double").repartition(3)
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999]
    for by in (["k"], []):
        found = {(r["k"] if by else 0, r["column"]): r for r in near_quantiles(df, ["x", "y"], by, probs, width).collect()}
        expected = {}
        for r in df.collect():
            for c in "xy":
                if r[c] is not None:
                    expected.setdefault((r["k"] if by else 0, c), []).append(r[c])
        assert found.keys() == expected.keys()
        for key, values in expected.items():
            values, places = sorted(values), [p * (len(values) - 1) for p in probs]
            low, high = ([values[f(h)] for h in places] for f in (math.floor, math.ceil))
            assert found[key]["n"] == len(values)
            assert found[key]["q"] == pytest.approx([a if a == b else a + (b - a) * (h % 1) for a, b, h in zip(low, high, places)], rel=1e-12)


def test_quantiles_of_rows_count_only_values_near_them(spark, monkeypatch):
    sizes, store = {}, ordered.store

    def kept(df, name):
        stored = store(df, name)
        sizes[name] = stored.count()
        return stored

    monkeypatch.setattr(ordered, "store", kept)
    df = spark.range(40_000).select((1000 + F.col("id") / 7).alias("x"))
    assert near_quantiles(df, ["x"], [], [0.25, 0.75], 5).first()["q"] == pytest.approx([1000 + 9999.75 / 7, 1000 + 29999.25 / 7])
    assert sizes["near-quantiles"] < 400
    monkeypatch.setattr(keys, "FEW_KEYS", 0)
    assert near_quantiles(df, ["x"], [], [0.25, 0.75], 5) is None
