"""Work that must not grow with the rows, or with the rows of one key."""

import hashlib
import random
import time

import pytest
from pyspark.sql import functions as F

from predaudit.operators import charts as C
from predaudit.operators import explain as E
from predaudit.operators import regression as R
from predaudit.operators import surrogate as S
from predaudit.plans import report as P
from predaudit.spec import REGRESSION, AuditSpec

SPEC = AuditSpec("p", "y", problem=REGRESSION)


def _frame(spark, copies=1):
    rng = random.Random(3)
    rows = [(float(a > 4) * 3 + (b > 2) + rng.random() / 100, float(a), float(b)) for a in range(8) for b in range(5)]
    return spark.createDataFrame(rows * copies, "_target double, a double, b double").repartition(3)


def _sizes(monkeypatch):
    sizes = {}

    def store(df, name, whole=S.store):
        found = whole(df, name)
        sizes.setdefault(name, []).append(found.count())
        return found

    monkeypatch.setattr(S, "store", store)
    return sizes


def test_levels_of_a_deep_forest_read_sums_and_not_rows(spark, monkeypatch):
    sizes = _sizes(monkeypatch)
    found = {r["feature"]: r["importance"] for r in E.forest_importance(_frame(spark, 50), ["a", "b"], REGRESSION, trees=3).collect()}
    assert found["a"] > found["b"] > 0 and sum(found.values()) == pytest.approx(1)
    assert max(sizes["forest-cells"]) <= 3 * 40  # trees, combinations of codes


def test_levels_of_forests_by_key_read_sums_and_not_rows(spark, monkeypatch):
    sizes = _sizes(monkeypatch)
    frame = _frame(spark, 50).withColumn("k", F.lit("x")).coalesce(1)
    S.surrogate_importance(frame, ["a", "b"], REGRESSION, ["k"], trees=3, depth=2).collect()
    assert sizes["surrogate-rows"] == [40]


def test_codes_by_cuts_sent_and_joined_are_the_same(spark, monkeypatch):
    frame = _frame(spark, 2).withColumn("k", F.when(F.col("a") > 3, "x")).withColumn("b", F.when(F.col("a") != 2, F.col("b")))
    sent = sorted(map(tuple, S.binned(frame, ["a", "b"], ["k"], 4).collect()))
    monkeypatch.setattr(S, "MODEL_SPLITS", 1)
    assert sent == sorted(map(tuple, S.binned(frame, ["a", "b"], ["k"], 4).collect()))


def test_sample_of_a_key_is_cut_down_before_it_is_ordered(spark):
    rows = spark.range(20_000).select((F.col("id") % 2).alias("k"), "id", F.xxhash64("id").alias("y"), F.lit(0.0).alias("p"))
    drawn = R.residuals(rows.withColumn("_pick", F.xxhash64("id")).withColumn("y", F.col("y") / 1e18), SPEC, ["k", "_pick"])
    got = sorted((r["k"], r["r"]) for r in R._first(drawn, ["k"], 300).collect())
    ranked = {k: sorted((r["_pick"], r["r"]) for r in drawn.where(F.col("k") == k).collect())[:300] for k in (0, 1)}
    assert got == sorted((k, r) for k, picked in ranked.items() for _, r in picked)
    same = rows.limit(1).select(F.lit(None).cast("int").alias("k"), "y", "p", F.lit(7).cast("long").alias("_pick"), F.explode(F.sequence(F.lit(1), F.lit(50))))
    assert R._first(R.residuals(same, SPEC, ["k", "_pick"]), ["k"], 20).count() == 20


def _joins(df):
    plan = df._jdf.queryExecution().sparkPlan().toString()
    return "BroadcastHashJoin" in plan, "SortMergeJoin" in plan


def test_rows_meet_statistics_of_few_keys_without_a_shuffle(spark, tmp_path):
    spark.range(3000).select((F.col("id") % 3).alias("k"), F.rand(1).alias("y"), F.rand(2).alias("p")).write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1")  # as if the tables were large
    try:
        assert _joins(C.residual_histograms(df, SPEC, ["k"])) == (True, False)
        assert _joins(E.feature_frame(df, SPEC.with_(features=("p",)), ["k"])[0]) == (True, False)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_an_audit_computes_its_table_once(spark, monkeypatch):
    reads = spark.sparkContext.accumulator(0)

    def noted(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    df = spark.range(200).selectExpr("id % 2 as y", "id % 3 % 2 as p", "id % 5 as a").mapInArrow(noted, "y long, p long, a long")
    assert P.audit(df, AuditSpec("p", "y", protected=("a",))).report.first()["sample_size"] == 200
    assert reads.value == 200


def _shuffled(spark):
    """Bytes of the shuffle files that lie on the disk."""
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    files = [blocks.apply(i) for i in range(blocks.size())]
    return sum(f.length() for f in files if f.getName().startswith("shuffle_"))


def test_repeats_of_permutations_do_not_pile_up_on_the_disk(spark):
    rows = spark.range(0, 30_000, 1, 3).select("id", (F.col("id") % 17).cast("double").alias("a"), F.rand(1).alias("b"), F.rand(2).alias("y"))
    before = _shuffled(spark)
    lost = E.permutation_importance(rows, ["a", "b"], "y", "id", lambda r: r.withColumn("prediction", F.col("a") + F.col("b")), REGRESSION, bucket_rows=10_000)
    assert lost.count() == 2
    for _ in range(50):  # files go in the background
        if (left := _shuffled(spark) - before) < 200_000:
            break
        time.sleep(0.1)
    assert left < 200_000  # one repeat alone shuffles over a megabyte


def test_permuted_rows_take_the_features_of_the_next_row_of_their_bucket(spark):
    rng = random.Random(7)
    data = [(None if i % 9 == 0 else str(i % 70), "u" if i % 2 else None, rng.randrange(5) / 4, rng.random(), rng.random()) for i in range(120)]
    df = spark.createDataFrame(data, "id string, k string, a double, b double, y double").repartition(3)
    values = {tuple(r)[:5]: r["h"] for r in df.withColumn("h", F.xxhash64("y", "a", "b")).collect()}

    def digest(row, repeat, seed):
        return hashlib.md5(f"{row[0] if row[0] is not None else values[row]}:{repeat}:{seed}".encode()).hexdigest()

    wanted = {}
    for key in ("u", None):
        mine = [r for r in data if r[1] == key]
        plain = sum((y - a - 2 * b) ** 2 for *_, a, b, y in mine) / len(mine)
        rise = {"a": 0.0, "b": 0.0}
        for repeat in range(E.REPEATS):
            buckets = {}
            for r in mine:
                buckets.setdefault(int(digest(r, repeat, E.SEED)[:12], 16) % 6, []).append(r)
            for rows in buckets.values():
                rows.sort(key=lambda r: (digest(r, repeat, E.SEED + 1), values[r]))
                for r, o in zip(rows, rows[1:] + rows[:1]):
                    rise["a"] += (r[4] - o[2] - 2 * r[3]) ** 2
                    rise["b"] += (r[4] - r[2] - 2 * o[3]) ** 2
        wanted |= {(key, f): v / len(mine) / E.REPEATS - plain for f, v in rise.items()}
    lost = E.permutation_importance(df, ["a", "b"], "y", "id", lambda r: r.withColumn("prediction", F.col("a") + 2 * F.col("b")), REGRESSION, bucket_rows=20, by=["k"])
    assert {(r["k"], r["feature"]): r["importance"] for r in lost.collect()} == pytest.approx(wanted)
